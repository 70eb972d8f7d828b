"""Order over all rows without one task for all: places, exact quantiles, digests of ordered lines."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.sources.files import written

#: Bins of a round of selection; rows of a bin that are few enough to be put in order.
BINS, FEW = 4096, 10_000
#: Characters of lines that travel as one row.
PIECE = 65_536


def numbered(rows: DataFrame, order: list, name: str = "place") -> DataFrame:
    """rows with their place in order, gapless from 1: dealt by ranges of order, each range put in order by itself.

    A row's number in its range is kept with it; a range begins where the counts of those before it end, and these
    counts, a row for each range, are all that one task sees. Rows that tie in order get places of their own.
    """
    mask = (1 << 33) - 1
    put = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id__", F.monotonically_increasing_id())
    held = written(put, "ordered").withColumn("__part__", F.shiftright("__id__", 33))
    before = Window.orderBy("__part__").rowsBetween(Window.unboundedPreceding, -1)
    counts = held.groupBy("__part__").agg(F.count("*").alias("_n")).select(F.col("__part__").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    out = held.join(F.broadcast(counts), F.col("__part__") == F.col("_p"))
    return out.withColumn(name, F.col("_start") + F.col("__id__").bitwiseAND(F.lit(mask)) + 1).drop("__id__", "__part__", "_p", "_start")


def quantiles(rows: DataFrame, group: list[str], value: str, shares: list[float], floor: bool = False) -> DataFrame:
    """group, p, n, value: for each share p the value at place ceil(p n) of a group (floor: at place floor(p n) counted from 0), exactly.

    Selection in rounds, not sorting: a group's range of values is cut into BINS, which are counted where the rows
    lie; the bin that holds the place is the next range, between the least and the largest value that is in it. It ends
    when a bin holds one value, or few rows. Nulls and NaN take no part; a group without values has no rows.
    """
    v = F.col(value).cast("double")
    base = rows.select(*group, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    share = F.explode(F.array(*(F.lit(float(p)) for p in shares)))
    about = base.groupBy(*group).agg(F.count("*").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).withColumn("p", share)
    scaled = F.round(F.col("p") * F.col("n"), 9)
    at = F.least(F.floor(scaled), F.col("n") - 1) if floor else F.greatest(F.ceil(scaled) - 1, F.lit(0))
    open_ = written(about.withColumn("_t", at.cast("long")).withColumn("_c", F.col("n")), "targets")
    keys, out = [*group, "p"], []

    def met(targets: DataFrame) -> DataFrame:
        t = targets.select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(group)), "p", "n", "_t", "_c", "_lo", "_hi")
        on = F.lit(True)
        for i, c in enumerate(group):
            on = on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
        return base.join(t, on & (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))).drop(*(f"_g{i}" for i in range(len(group))))

    while True:
        out.append(open_.where("_lo = _hi").select(*keys, "n", F.col("_lo").alias("value")))
        few = open_.where(f"_lo < _hi AND _c <= {FEW}")
        own = Window.partitionBy(*keys).orderBy("_v")
        picked = met(few).withColumn("_r", F.row_number().over(own) - 1).where("_r = _t")
        out.append(picked.select(*keys, "n", F.col("_v").alias("value")))
        many = open_.where(f"_lo < _hi AND _c > {FEW}")
        if many.isEmpty():
            break
        part = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)  # halves, so that no difference overflows
        cells = met(many).groupBy(*keys, "n", "_t", F.least(F.floor(part * BINS), F.lit(BINS - 1)).alias("_b")).agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_b"))
        found = cells.withColumn("_u", upto).where((F.col("_u") - F.col("_c") <= F.col("_t")) & (F.col("_t") < F.col("_u")))
        open_ = written(found.withColumn("_t", F.col("_t") - (F.col("_u") - F.col("_c"))).drop("_u", "_b"), "targets")
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def ordered_digest(rows: DataFrame, group: str, order: list, line: Column, separator: str = "\n", method: str = "sha256") -> DataFrame:
    """group, digest (hex) and n: of each group's lines in order, with separator between them, as if joined to one text.

    Ranges of (group, order) join their lines to pieces; a group's pieces then pass one task in their order, which
    hashes them as they come and holds one. Null lines are empty ones.
    """
    from pyspark import TaskContext

    kind = rows.schema[group].dataType.simpleString()
    own = rows.select(group, *order, F.coalesce(line.cast("string"), F.lit("")).alias("__line__"))
    # order beside the group, and the line last, so that ranges and ties do not depend on where a row lay
    put = own.repartitionByRange(group, *order, "__line__").sortWithinPartitions(group, *order, "__line__").select(group, "__line__")

    def join(batches):
        part, seq = TaskContext.get().partitionId(), 0
        key, held, size, type_ = None, [], 0, None
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([key], type_), pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([separator.join(held)]), pa.array([len(held)], pa.int64())], [group, "part", "seq", "piece", "n"])
        for b in batches:
            type_ = b.schema.field(group).type
            for g, text in zip(b.column(group).to_pylist(), b.column("__line__").to_pylist(), strict=True):
                if held and (g != key or size >= PIECE):
                    yield batch()
                    held, size, seq = [], 0, seq + 1
                key = g
                held.append(text)
                size += len(text) + 1
        if held:
            yield batch()

    pieces = put.mapInArrow(join, f"`{group}` {kind}, part int, seq bigint, piece string, n bigint")

    def digest(batches):
        key, h, n, type_ = None, None, 0, None
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([key], type_), pa.array([h.hexdigest()]), pa.array([n], pa.int64())], [group, "digest", "n"])
        for b in batches:
            type_ = b.schema.field(group).type
            for g, piece, m in zip(b.column(group).to_pylist(), b.column("piece").to_pylist(), b.column("n").to_pylist(), strict=True):
                if h is not None and g == key:
                    h.update((separator + piece).encode())
                    n += m
                    continue
                if h is not None:
                    yield batch()
                key, h, n = g, hashlib.new(method, piece.encode()), m
        if h is not None:
            yield batch()

    return pieces.repartition(group).sortWithinPartitions(group, "part", "seq").mapInArrow(digest, f"`{group}` {kind}, digest string, n bigint")
