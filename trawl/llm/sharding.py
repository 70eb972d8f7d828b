"""Hierarchical weighted hash tree: region, then rack, then shard, each level by weighted hash draws.

At a node each child draws -ln(u) / weight, where u in (0, 1) is a hash of the key and the child's name; the
smallest draw wins. A child's draw depends on its own name and weight alone. So if one weight changes, rows move
only into or out of the subtrees above that leaf, and a tree that gains a region moves rows only into that region.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """A leaf (shard set, no children) or an inner node; an inner node weighs what its children weigh."""

    name: str
    leaf_weight: float = 0.0
    shard: int | None = None
    children: tuple[Node, ...] = ()

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.leaf_weight

    def leaves(self) -> list[Node]:
        return [x for c in self.children for x in c.leaves()] if self.children else [self]


def regular_tree(shards: int, racks_per_region: int = 2, shards_per_rack: int = 2, weights: dict[int, float] | None = None) -> Node:
    """Shards 0..n-1 filled into racks and regions in order; weights default to 1."""
    if shards < 1:
        raise ValueError("a tree needs a shard")
    weights = weights or {}
    leaf = [Node(f"s{i}", float(weights.get(i, 1.0)), i) for i in range(shards)]
    racks = [Node(f"k{i // shards_per_rack}", children=tuple(leaf[i : i + shards_per_rack])) for i in range(0, shards, shards_per_rack)]
    regions = [Node(f"r{i // racks_per_region}", children=tuple(racks[i : i + racks_per_region])) for i in range(0, len(racks), racks_per_region)]
    return Node("root", children=tuple(regions))


def with_shard(tree: Node, weight: float = 1.0) -> Node:
    """One more shard, in a rack and a region of its own: rows move only into it."""
    n = max(x.shard for x in tree.leaves()) + 1
    return replace(tree, children=(*tree.children, Node(f"r+{n}", children=(Node(f"k+{n}", children=(Node(f"s{n}", weight, n),)),))))


def with_weight(tree: Node, shard: int, weight: float) -> Node:
    if tree.shard == shard:
        return replace(tree, leaf_weight=weight)
    return replace(tree, children=tuple(with_weight(c, shard, weight) for c in tree.children))


def _draw(key: Column, child: Node) -> Column:
    h = F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("\0null")), F.lit(f"/{child.name}"))), 1, 13), 16, 10).cast("double")
    return -F.log((h + 0.5) / F.lit(2.0**52)) / F.lit(float(child.weight))


def shard_of(key: Column, tree: Node) -> Column:
    """The shard of a key, as one expression; branches not taken are not evaluated."""
    if not tree.children:
        return F.lit(tree.shard).cast("int")
    open_ = [c for c in tree.children if c.weight > 0]
    if not open_:
        raise ValueError(f"no weight below {tree.name}")
    if len(open_) == 1:
        return shard_of(key, open_[0])
    draws = [_draw(key, c) for c in open_]
    least = F.least(*draws)
    out = shard_of(key, open_[-1])
    for d, c in list(zip(draws, open_, strict=True))[-2::-1]:
        out = F.when(d == least, shard_of(key, c)).otherwise(out)
    return out


def slotted(df: DataFrame, shard: str, order: list[str], blocks: int = 4096) -> DataFrame:
    """Adds slot, gapless from 0 in each shard, without bringing a shard into one task.

    A shard's rows are dealt to blocks by a hash of the order columns, so that rows that repeat an id (or null) with
    different texts are spread; a block starts where the counts of those before it end. The counts (shards x blocks rows at most) are the only thing that is broadcast.
    """
    at = df.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    counts = at.groupBy(shard, "_block").count()
    before = Window.partitionBy(shard).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(shard).alias("_s"), F.col("_block").alias("_b"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(shard, "_block").orderBy(*order)
    return (
        at.withColumn("_n", F.row_number().over(inside))
        .join(F.broadcast(starts), (F.col(shard).eqNullSafe(F.col("_s"))) & (F.col("_block") == F.col("_b")))
        .withColumn("slot", (F.col("_start") + F.col("_n") - 1).cast("long"))
        .drop("_s", "_b", "_start", "_n", "_block")
    )


def shard_documents(docs: DataFrame, tree: Node, grown: Node | None = None, id_col: str = "doc_id", text_col: str = "text", blocks: int = 4096) -> DataFrame:
    """One row per input row: its id, size, text_crc32, law ("key"), shard, slot and grown_shard.

    Nulls: a null id is a key like any other; a null text counts as empty (size 1, crc of no bytes). Repeated rows
    get the same shard and slots of their own. An empty table gives no rows. Other columns are not read.
    """
    body = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    key = F.col(id_col)
    flat = docs.select(
        key.alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, tree).alias("shard"),
        (shard_of(key, grown) if grown else F.lit(None)).cast("int").alias("grown_shard"),
    )
    out = slotted(flat, "shard", ["doc_id", "text_crc32"], blocks)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def brute_shard(key, tree: Node) -> int:
    """The same draw in plain Python, for tests."""
    import hashlib
    import math

    name = "\0null" if key is None else str(key)
    draw = lambda c: -math.log((int(hashlib.md5(f"{name}/{c.name}".encode()).hexdigest()[:13], 16) + 0.5) / 2.0**52) / c.weight
    while tree.children:
        tree = reduce(lambda a, b: b if draw(b) < draw(a) else a, [c for c in tree.children if c.weight > 0])
    return tree.shard
