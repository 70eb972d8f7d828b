"""Merkle manifest of a dataset: a tree for each group, a root over the groups, and a proof for each row.

Rows are range-sorted by (group, id). A partition builds the complete aligned subtrees of its stretch; its ragged
nodes are finished by coordinate (ragged.py) and come back to their partition with their path to the root, where each
row's own path is put before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.llm.ragged import FAN, climb, finish, largest, packed, range_sorted, stretches, unpacked, with_spans
from trawl.llm.shared import lean, small_batches, written

Pairs = list[tuple[bytes, bytes]]


def combine(kids: list[bytes]) -> bytes:
    """The digest of digests, concatenated as hex text."""
    return hashlib.sha256(b"".join(kids).hex().encode()).digest()


def fold(leaf: bytes, path: Pairs) -> bytes:
    """The root that a leaf and the siblings of its path give."""
    for before, after in path:
        leaf = hashlib.sha256((before + leaf + after).hex().encode()).digest()
    return leaf


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    """sha256 of the values, each - if null, else its length in UTF-8 bytes, a colon and itself."""
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass
class Forest:
    rows: DataFrame  # range-sorted: grp, hash, the columns of order and any others, part, start, total
    nodes: DataFrame  # of ragged.finish
    parts: int
    order: list[str]

    @property
    def tops(self) -> DataFrame:
        return self.nodes.where("top").select("grp", "hash")


def forest(rows: DataFrame, order: list[str]) -> Forest:
    """A tree for each grp over rows (grp, hash and others); leaves stand by order, then by hash."""
    dealt = range_sorted(rows, ["grp", *order, "hash"])
    spanned = with_spans(dealt)

    @lean
    def local(batches):
        for grp, first, total, held in stretches(batches, ["grp", "start", "total", "hash", "part"]):
            n = first + len(held) if total is None else total
            out = list(largest(climb([r[0] for r in held], first, n, combine)))
            made = {"grp": pa.array([grp] * len(out), pa.string()), "total": pa.array([n] * len(out), pa.int64()), "part": pa.array([held[0][1]] * len(out), pa.int32())}
            yield pa.RecordBatch.from_pydict(made | {k: pa.array([x[i] for x in out], t) for i, (k, t) in enumerate((("level", pa.int32()), ("idx", pa.int64()), ("hash", pa.binary())))})

    ragged = written(spanned.select("grp", "start", "total", "hash", "part").mapInArrow(local, "grp string, total bigint, part int, level int, idx bigint, hash binary"), "nodes")
    most = ragged.agg(F.max("total")).first()[0] or 1
    return Forest(spanned, finish(ragged, most, combine), max(1, dealt.rdd.getNumPartitions()), order)


def with_paths(built: Forest, above: DataFrame, carry: list[str], give: Callable, schema: str) -> DataFrame:
    """give over the rows of a stretch, each as (columns of carry, hash, place, path in its group, columns of above).

    above has a row for each grp. Rows are dealt by the partition that held them, where its nodes join them.
    """
    more = [c for c in above.columns if c != "grp"]
    up = above.withColumnRenamed("grp", "_grp")
    sent = built.nodes.where(F.col("part").isNotNull()).join(up, F.col("grp").eqNullSafe(F.col("_grp"))).select("part", "grp", F.lit(0).alias("kind"), "level", "idx", "path", *more)
    rows = built.rows.select("part", "grp", F.lit(1).alias("kind"), "start", "total", "hash", *dict.fromkeys([*built.order, *carry]))
    both = sent.unionByName(rows, allowMissingColumns=True).repartitionById(built.parts, "part").sortWithinPartitions("part", "grp", "kind", *built.order, "hash")
    columns, n = ["grp", "start", "total", "kind", "hash", *carry, "level", "idx", "path", *more], len(carry) + 2

    @lean
    def walk(batches):
        held: dict[tuple, tuple] = {}

        def keep(grp, row):
            level, idx, path, *rest = row[n:]
            held[grp, level, idx] = path, rest

        for grp, first, total, rows in stretches(batches, columns, keep):
            levels = climb([r[1] for r in rows], first, first + len(rows) if total is None else total, combine)
            paths: dict[tuple[int, int], tuple[Pairs, list]] = {}
            for level in range(len(levels) - 1, -1, -1):
                lo, nodes = levels[level]
                for i in range(lo, lo + len(nodes)):
                    p = i // FAN
                    if (level + 1, p) in paths:
                        a, z = FAN * p - lo, min(FAN * p + FAN - lo, len(nodes))
                        rest, extra = paths[level + 1, p]
                        paths[level, i] = [(b"".join(nodes[a : i - lo]), b"".join(nodes[i + 1 - lo : z])), *rest], extra
                    else:
                        path, extra = held.pop((grp, level, i))
                        paths[level, i] = unpacked(path), extra
            yield give([(r[2:n], r[1], first + k, *paths[0, first + k]) for k, r in enumerate(rows)])

    return both.select(*columns).mapInArrow(walk, schema)


def dataset_manifest(docs: DataFrame, columns: list[str], id_col: str = "doc_id", group_col: str = "lang", other: dict[str, Column] | None = None, when: Column | None = None, proofs: bool = False) -> DataFrame:
    """One row per input row: doc_id, lang, place (in its group, from 0), leaf, subroot, root, proof_sha256, folded_root, verified.

    columns: what a leaf's digest is made of, in this order. The groups' roots, ordered by group, give the root. other
    and when: another version of some columns, for the rows where when is true; folded_root is then what that version
    gives with the row's own proof. proofs: also proof, the siblings (hex) level by level, left to right.

    Nulls: a null group is a group and comes first; a null id comes first in its group; any other null is a field of
    its own kind. Rows with the same id stand by their leaves' digests; rows that are equal throughout have leaves of
    their own. Very long texts are read once, by the JVM's digest, and never shuffled. An empty table gives no rows.
    Other columns are not read.
    """
    small_batches(docs.sparkSession, 4096)
    changed = [(other or {}).get(c, F.col(c)) for c in columns]
    rows = docs.select(
        F.col(group_col).cast("string").alias("grp"),
        F.col(id_col).cast("long").alias("doc_id"),
        leaf_hash(*map(F.col, columns)).alias("hash"),
        (F.when(when, leaf_hash(*changed)) if when is not None else F.lit(None).cast("binary")).alias("other"),
    )
    groups = forest(rows, ["doc_id"])
    outer = forest(groups.tops.select(F.lit("").alias("grp"), "hash", F.col("grp").alias("name")), ["name"])

    def up(rows):
        return pa.RecordBatch.from_pydict({"grp": pa.array([r[0][0] for r in rows], pa.string()), "subroot": pa.array([r[1] for r in rows], pa.binary()), "above": pa.array([packed(r[3]) for r in rows], pa.binary()), "root": pa.array([r[4][0] for r in rows], pa.binary())})

    above = written(with_paths(outer, outer.tops.select("grp", F.col("hash").alias("root")), ["name"], up, "grp string, subroot binary, above binary, root binary"), "groups")

    def give(rows):
        out: dict[str, list] = {k: [] for k in names}
        for (grp, doc, changed), leaf, place, own, (subroot, above, root) in rows:
            path = [*own, *unpacked(above)]
            proof = b"".join(a + z for a, z in path).hex()
            folded = fold(leaf if changed is None else changed, path)
            values = (doc, grp, place, leaf.hex(), subroot.hex(), root.hex(), hashlib.sha256(proof.encode()).hexdigest(), folded.hex(), folded == root, [proof[i : i + 64] for i in range(0, len(proof), 64)])
            for k, v in zip(names, values, strict=False):
                out[k].append(v)
        return pa.RecordBatch.from_pydict({k: pa.array(out[k], t) for k, t in names.items()})

    text = pa.string()
    names = {"doc_id": pa.int64(), "lang": text, "place": pa.int64(), "leaf": text, "subroot": text, "root": text, "proof_sha256": text, "folded_root": text, "verified": pa.bool_()}
    schema = "doc_id bigint, lang string, place bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if proofs:
        names["proof"], schema = pa.list_(text), schema + ", proof array<string>"
    rows = Forest(groups.rows.withColumn("lang", F.col("grp")), groups.nodes, groups.parts, groups.order)
    return with_paths(rows, above, ["lang", "doc_id", "other"], give, schema)


def brute_manifest(rows: list[dict], columns: list[str], tampered: Callable[[dict], dict]) -> dict:
    """(leaf, subroot, root, proof digest, folded root, verified) by (doc_id, leaf), in plain Python, for tests."""
    text = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: hashlib.sha256("".join(text(r[c]) for c in columns).encode()).hexdigest()
    h = lambda x: hashlib.sha256("".join(x).encode()).hexdigest()

    def grow(nodes: list[str]) -> tuple[str, list[list[tuple[list[str], list[str]]]]]:
        paths, mine = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for leaf_no, i in enumerate(mine):
                a = i // 8 * 8
                paths[leaf_no].append((nodes[a:i], nodes[i + 1 : a + 8]))
            nodes, mine = [h(nodes[a : a + 8]) for a in range(0, len(nodes), 8)], [i // 8 for i in mine]
        return nodes[0], paths

    order = lambda v: (v is not None, v if v is not None else 0)
    groups: dict = {}
    for r in sorted(rows, key=lambda r: (order(r["doc_id"]), leaf(r))):
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    grown = {g: grow([leaf(r) for r in groups[g]]) for g in names}
    root, ups = grow([grown[g][0] for g in names]) if names else ("", [])
    out = {}
    for g, up in zip(names, ups, strict=True):
        for r, own in zip(groups[g], grown[g][1], strict=True):
            path, x = [*own, *up], leaf(tampered(r))
            for a, z in path:
                x = h([*a, x, *z])
            out[r["doc_id"], leaf(r)] = (grown[g][0], root, h([s for a, z in path for s in (*a, *z)]), x, x == root)
    return out
