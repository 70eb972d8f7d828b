"""Hash trees over groups that partitions cut where they like: range-sorted rows, offsets of the groups, ragged nodes.

Rows are dealt by ranges of (group, order), so a partition holds one stretch of each group that touches it. Only its
first and last group can go on elsewhere; spans has a row for each such stretch (and for groups of over BLOCK rows),
two and a few for a partition, and is all that is broadcast. A node of level L covers FAN ** L places of a group; a
partition builds the nodes whose places it holds alone, and only the largest of these leave it. finish puts the rest
together, STEP levels a round, keyed by coordinate, so no task ever holds more than FAN ** STEP nodes of a level.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.llm.shared import shared_dir, written

FAN, STEP = 8, 4
BITS = FAN.bit_length() - 1
BLOCK = FAN**STEP

Combine = Callable[[list[bytes]], bytes]


def count_at(total: int, level: int) -> int:
    return -(-total // FAN**level)


def height(total: int) -> int:
    level = 0
    while count_at(total, level) > 1:
        level += 1
    return level


def range_sorted(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows sorted by order over all partitions, with their partition's number (part), in the shared folder.

    A checkpoint, not a written table: it keeps the partitions, and a lost executor costs a read.
    """
    spark = rows.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).checkpoint()


def with_spans(dealt: DataFrame, **more) -> DataFrame:
    """Adds start (rows of the group before this partition) and total (rows of the group) where a group is cut or
    larger than a block, else null, in the order that dealt has. more: sums over the whole group, under their names."""
    counts = dealt.groupBy("part", "grp").agg(F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in more.items()))
    group = Window.partitionBy("grp")
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = counts.select(
        F.col("part").alias("_part"), F.col("grp").alias("_grp"), F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("start"), F.sum("n").over(group).cast("long").alias("total"),
        F.count(F.lit(1)).over(group).alias("_parts"), *(F.sum(k).over(group).cast("long").alias(k) for k in more),
    ).where((F.col("_parts") > 1) | (F.col("total") > BLOCK)).drop("_parts")
    return dealt.join(F.broadcast(spans), (F.col("part") == F.col("_part")) & F.col("grp").eqNullSafe(F.col("_grp")), "left").drop("_part", "_grp")


def stretches(batches: Iterator[pa.RecordBatch], columns: list[str], aside: Callable | None = None) -> Iterator[tuple]:
    """(group, first place, total, rows) for rows of one group and one block of it; columns begin with grp, start, total.

    rows are lists of the other columns. A stretch ends where the group, the block or the partition does. With aside,
    rows whose first other column is 0 have no place; they are given to it, and come before the rows of their group.
    """
    grp, at, first, total, held = object(), 0, 0, None, []
    for b in batches:
        for g, start, n, *row in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
            apart = aside is not None and row[0] == 0
            if held and (apart or g != grp or at % BLOCK == 0):
                yield grp, first, total, held
                held = []
            if apart:
                aside(g, row)
                grp = object()
                continue
            if g != grp:
                grp, at, total = g, start or 0, n
            if not held:
                first = at
            held.append(row)
            at += 1
    if held:
        yield grp, first, total, held


def climb(nodes: list[bytes], lo: int, total: int | None, combine: Combine) -> list[tuple[int, list[bytes]]]:
    """(first index, nodes) of each level up to STEP that the places from lo on give alone. A last run is whole if total says so."""
    out = [(lo, nodes)]
    for level in range(STEP):
        hi = lo + len(nodes)
        ends = total is not None and hi == count_at(total, level)
        if ends and hi == 1:
            break
        first, last = -(-lo // FAN), -(-hi // FAN) if ends else hi // FAN
        if first >= last:
            break
        nodes = [combine(nodes[max(0, FAN * i - lo) : FAN * i + FAN - lo]) for i in range(first, last)]
        lo = first
        out.append((lo, nodes))
    return out


def largest(levels: list[tuple[int, list[bytes]]]) -> Iterator[tuple[int, int, bytes]]:
    """(level, index, node) of the nodes whose parents are not among levels."""
    for level, (lo, nodes) in enumerate(levels):
        up_lo, up = levels[level + 1] if level + 1 < len(levels) else (0, [])
        for i, x in enumerate(nodes, lo):
            if not up_lo <= i // FAN < up_lo + len(up):
                yield level, i, x


def steps(kids: list[bytes], k: int) -> bytes:
    """One level of a path: how many siblings stand before and after, then the siblings."""
    return bytes([k, len(kids) - k - 1]) + b"".join(kids[:k]) + b"".join(kids[k + 1 :])


def packed(pairs: list[tuple[bytes, bytes]]) -> bytes:
    return b"".join(bytes([len(a) // 32, len(z) // 32]) + a + z for a, z in pairs)


def unpacked(path: bytes) -> list[tuple[bytes, bytes]]:
    """The siblings before and after, level by level."""
    out, at = [], 0
    while at < len(path):
        k, m = path[at], path[at + 1]
        at += 2
        out.append((path[at : at + 32 * k], path[at + 32 * k : at + 32 * (k + m)]))
        at += 32 * (k + m)
    return out


def _solved(table: pa.Table, base: int, combine: Combine, ragged_end: bool) -> pa.Table:
    rows = table.to_pylist()
    grp, total, made = rows[0]["grp"], rows[0]["total"], {(r["level"], r["idx"]): r["part"] for r in rows}
    at: dict[int, dict[int, bytes]] = defaultdict(dict)
    for r in rows:
        at[r["level"]][r["idx"]] = r["hash"]
    for level in range(base, base + STEP):
        end = count_at(total, level) if ragged_end else None
        if end == 1:
            break
        for p in {i // FAN for i in at[level]}:
            kids = [at[level].get(i) for i in range(FAN * p, FAN * p + FAN) if end is None or i < end]
            if None not in kids:
                at[level + 1][p] = combine(kids)
    path: dict[tuple[int, int], bytes] = {}
    for level in range(base + STEP - 1, base - 1, -1):
        for i in at[level]:
            p = i // FAN
            if p in at[level + 1]:
                kids = [at[level][j] for j in range(FAN * p, FAN * p + FAN) if j in at[level]]
                path[level, i] = steps(kids, i - FAN * p) + path.get((level + 1, p), b"")
    out = [(level, i, x) for level in range(base, base + STEP + 1) for i, x in at[level].items()]
    kinds = table.schema
    return pa.Table.from_arrays(
        [
            pa.array([grp] * len(out), kinds.field("grp").type), pa.array([total] * len(out), pa.int64()), pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()),
            pa.array([x[2] for x in out], pa.binary()), pa.array([path.get(x[:2], b"") for x in out], pa.binary()), pa.array([made.get(x[:2]) for x in out], pa.int32()),
            pa.array([ragged_end and x[0] < base + STEP and count_at(total, x[0]) == 1 for x in out], pa.bool_()),
        ],
        names=["grp", "total", "level", "idx", "hash", "path", "part", "top"],
    )


def _solver(base: int, combine: Combine, ragged_end: bool):
    def solve(table: pa.Table) -> pa.Table:  # applyInArrow counts its arguments
        return _solved(table, base, combine, ragged_end)

    return solve


def _above(level: int) -> F.Column:
    """The index of the ancestor at level."""
    return F.expr(f"shiftright(idx, {BITS} * ({level} - level))")


def finish(ragged: DataFrame, most: int, combine: Combine, ragged_end: bool = True) -> DataFrame:
    """All nodes above those that the partitions sent (grp, total, level, idx, hash, part), and these, with the path of
    each to its group's top, whether it is the top, and part where a partition sent it.

    most: the largest total. ragged_end: the last run of a level may be short; else only whole runs make nodes.
    """
    kind = ragged.schema["grp"].dataType
    schema = T.StructType(
        [T.StructField("grp", kind), T.StructField("total", T.LongType()), T.StructField("level", T.IntegerType()), T.StructField("idx", T.LongType()), T.StructField("hash", T.BinaryType()), T.StructField("path", T.BinaryType()), T.StructField("part", T.IntegerType()), T.StructField("top", T.BooleanType())]
    )
    ragged = written(ragged.select("grp", "total", "level", "idx", "hash", "part"), "ragged")
    rounds, below = [], None
    for base in range(0, height(max(1, most)) + 1, STEP):
        rows = ragged.where((F.col("level") >= base) & (F.col("level") < base + STEP))
        if below is not None:
            rows = rows.unionByName(below.where((F.col("level") == base) & F.col("part").isNull()).select(*rows.columns))
        solved = rows.groupBy("grp", _above(base + STEP).alias("_block")).applyInArrow(_solver(base, combine, ragged_end), schema)
        below = written(solved, "tree")
        rounds.append(below)
    out = full = rounds[-1]
    for k in range(len(rounds) - 2, -1, -1):
        level = (k + 1) * STEP
        up = full.where(F.col("level") == level).select(F.col("grp").alias("_grp"), F.col("idx").alias("_idx"), F.col("path").alias("_path"))
        own = rounds[k].where(F.col("level") < level)  # those of this level are rows of the next round
        full = own.join(up, own["grp"].eqNullSafe(up["_grp"]) & (_above(level) == up["_idx"]), "left").withColumn("path", F.concat("path", F.coalesce("_path", F.lit(b"")))).drop("_grp", "_idx", "_path")
        out = out.unionByName(full)
    return out
