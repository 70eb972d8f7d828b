"""Near-dedup by exact resemblance: fingerprints and MinHash bands propose pairs, the shingles themselves decide.

A document is the set of its shingle hashes; equal sets are one node. The SimHash operator proposes the nodes whose
fingerprints it links. At a similarity of 0.8 fingerprints differ in about ten bits of 64, beyond any radius at which
the pigeonhole still prunes, so MinHash bands propose the rest: nodes that agree on all rows of a band share a bucket.
First each node of a bucket is compared with the bucket's smallest; then a bucket whose nodes are still of several
components goes to a task that looks for links between them. A pair links if the Jaccard similarity of its sets reaches
the threshold; it is computed on the whole sets, so no link is an estimate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.components import components
from trawl.llm.shared import blocks, boxed, lean, small_batches, unboxed, written
from trawl.llm.simhash import least_rows, shingle_hashes, simhash
from trawl.llm.simhash import links as simhash_links

#: A pair at similarity s meets in some band with probability 1 - (1 - s**ROWS)**BANDS: 0.99993 at 0.8.
BANDS, ROWS = 24, 5
#: So many candidate nodes at most are sent to the texts; more are joined by a shuffle, with the same result.
MOST_SENT = 1_000_000
#: Members of a bucket that a task compares with each other or with as many others.
BLOCK = 4096
_MIX = np.random.default_rng(17).integers(1, 1 << 63, (2, BANDS * ROWS), np.uint64)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(shingle_hashes(text, size))


def set_key(own: np.ndarray) -> int:
    """64 bits of a set; equal sets have equal keys."""
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(own.astype("<u8").tobytes(), 7)


def band_keys(own: np.ndarray) -> np.ndarray:
    """A key for each band, from the least of each of its rows' hashes; an empty set has none."""
    if not len(own):
        return np.zeros(0, np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(own), 4096):
        x = (own[i : i + 4096, None] ^ _MIX[0]) * (_MIX[1] | np.uint64(1))
        np.minimum(least, (x ^ (x >> np.uint64(29))).min(0), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for row in least.reshape(BANDS, ROWS).T:
        key = (key ^ row) * np.uint64(0xFF51AFD7ED558CCD)
        key = key ^ (key >> np.uint64(33))
    return key


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def signatures(docs: DataFrame, text_col: str, keep: list[str], shingle: int) -> DataFrame:
    """The keep columns of docs, _key (of the shingle set), _n (its size), _fp (fingerprint) and _bands."""
    small_batches(docs.sparkSession)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    @lean
    def run(batches):
        for b in batches:
            hashes = [shingle_hashes(t, shingle) for t in b.column("__text__").to_pylist()]
            sets = [np.unique(x) for x in hashes]
            bands = [band_keys(s) for s in sets]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in bands])]).astype(np.int32)
            flat = np.concatenate(bands) if bands else np.zeros(0, np.uint64)
            own = [_signed(np.asarray([set_key(s) for s in sets], np.uint64)), pa.array([len(s) for s in sets], pa.int32()), _signed(np.asarray([simhash(x) for x in hashes], np.uint64)), pa.ListArray.from_arrays(pa.array(ends), _signed(flat))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *own], [*keep, "_key", "_n", "_fp", "_bands"])

    return docs.select(*keep, F.col(text_col).alias("__text__")).mapInArrow(run, f"{kinds}, _key bigint, _n int, _fp bigint, _bands array<bigint>")


def sets_of(nodes: DataFrame, at: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """_key and _set (sorted shingle hashes, little-endian unsigned 64-bit) of the nodes (_key) that are named."""
    wanted = F.broadcast(nodes) if nodes.count() <= MOST_SENT else nodes
    texts = at.select("_key", F.col(text_col).alias("_text")).join(wanted, "_key", "left_semi").groupBy("_key").agg(F.first("_text").alias("_text"))

    @lean
    def to_set(batches):
        for b in batches:
            sets = [shingle_set(t, shingle).astype("<u8").tobytes() for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_key"), pa.array(sets, pa.binary())], ["_key", "_set"])

    return written(texts.mapInArrow(to_set, "_key bigint, _set binary"), "sets")


def verified(pairs: DataFrame, at: DataFrame, text_col: str, similarity: float, shingle: int) -> DataFrame:
    """The pairs (a, b: set keys) whose sets have a Jaccard similarity of at least similarity."""
    nodes = written(pairs.select(F.col("a").alias("_key")).union(pairs.select("b")).distinct(), "nodes")
    sets = sets_of(nodes, at, text_col, shingle)

    @lean
    def compare(batches):
        for b in batches:
            found = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                found.append(both / max(len(x) + len(y) - both, 1) >= similarity)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(found, pa.bool_()))

    each = pairs.join(sets.select(F.col("_key").alias("b"), F.col("_set").alias("y")), "b").join(sets.select(F.col("_key").alias("a"), F.col("_set").alias("x")), "a")
    return written(each.select("a", "b", "x", "y").mapInArrow(compare, "a bigint, b bigint"), "links")


def joining(key: np.ndarray, root: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links between members (set keys) of different roots, enough of them to join every two roots that links join."""
    _, part = np.unique(root, return_inverse=True)
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    _, element = np.unique(np.concatenate(sets), return_inverse=True)
    by = np.argsort(element, kind="stable")
    holder = np.repeat(np.arange(len(sets)), size)[by]  # members of each element, element by element
    many = np.bincount(element)
    first, begin = np.cumsum(many) - many, np.cumsum(size) - size
    out = []
    # One of the members of any pair is outside the largest part.
    for x in np.flatnonzero(part != np.bincount(part).argmax()).tolist():
        own = element[begin[x] : begin[x] + size[x]]
        n = many[own]
        at = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        both = np.bincount(holder[at], minlength=len(sets))
        near = np.flatnonzero((both / (size + size[x] - both) >= similarity) & (part != part[x]))
        for y in near.tolist():
            if part[y] != part[x]:
                out.append((int(key[x]), int(key[y])))
                part[part == part[y]] = part[x]
        if near.size and (part == part[x]).all():
            break
    return out


def across(named: DataFrame, at: DataFrame, text_col: str, similarity: float, shingle: int) -> DataFrame:
    """a, b: links between the components of named (band, key, root), as many as join those that share a bucket and a link.

    A bucket whose members are of several components goes to one task, members and sets, not their pairs; one of over
    BLOCK members to a task for each two of its blocks.
    """
    mixed = named.groupBy("band").agg(F.min("root").alias("_least"), F.max("root").alias("_last"), F.count("*").alias("_m")).where("_least <> _last")
    mixed = written(mixed.select(F.col("band").alias("_b"), F.ceil(F.col("_m") / BLOCK).cast("int").alias("_blocks")), "mixed")
    members = written(named.join(mixed.hint("merge"), F.col("band") == F.col("_b")).select("band", "key", "root", "_blocks"), "members")
    sets = sets_of(written(members.select(F.col("key").alias("_key")).distinct(), "nodes"), at, text_col, shingle)
    own = F.pmod(F.xxhash64(F.col("key"), F.lit(3)), F.col("_blocks")).cast("int")
    each = members.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    each = each.select(F.xxhash64("band", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("task"), "key", "root")

    @lean
    def compare(batches):
        for t in blocks(batches, "task", 256):
            task, key, root = (t.column(c).to_numpy() for c in ("task", "key", "root"))
            cut = [0, *(np.flatnonzero(task[1:] != task[:-1]) + 1).tolist(), len(task)]
            found = []
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                sets = [np.frombuffer(x, "<u8") for x in t.column("_set").slice(lo, hi - lo).to_pylist()]
                found += joining(key[lo:hi], root[lo:hi], sets, similarity)
            if found:
                a, b = np.asarray(found, np.int64).T
                yield pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    dealt = each.join(sets.withColumnRenamed("_key", "key"), "key").select("task", "key", "root", "_set")
    return written(dealt.repartition("task").sortWithinPartitions("task", "key").mapInArrow(compare, "a bigint, b bigint").distinct(), "links")


def proposed(nodes: DataFrame, distance: int = 3) -> DataFrame:
    """a, b: pairs of set keys of nodes whose fingerprints the SimHash operator links, through the least key of each fingerprint."""
    least = written(nodes.groupBy("fp").agg(F.min("key").alias("least")), "fingerprints")
    apart = simhash_links(least.select("fp"), distance)
    x, y = least.select(F.col("fp").alias("a"), F.col("least").alias("ka")), least.select(F.col("fp").alias("b"), F.col("least").alias("kb"))
    over = apart.join(x, "a").join(y, "b").select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))
    same = nodes.join(least.hint("merge"), "fp").where(F.col("key") != F.col("least")).select(F.col("least").alias("a"), F.col("key").alias("b"))
    return over.unionByName(same)


def links(at: DataFrame, text_col: str, similarity: float, shingle: int) -> DataFrame:
    """a, b: links among the set keys of at, whose components are those of all links that share a band or a fingerprint."""
    near = lambda x, y: F.least(x, y) >= similarity * F.greatest(x, y) - 1e-6  # noqa: E731  sets of other sizes cannot reach it
    nodes = written(at.groupBy(F.col("_key").alias("key")).agg(F.first("_n").alias("n"), F.first("_fp").alias("fp"), F.first("_bands").alias("bands")), "nodes")
    dealt = nodes.select("key", "n", F.explode("bands").alias("band"))
    centres = dealt.groupBy("band").agg(F.min(F.struct("key", "n")).alias("c"), F.max("key").alias("last")).where("c.key <> last")
    centres = written(centres.select(F.col("band").alias("_b"), F.col("c.key").alias("c"), F.col("c.n").alias("cn")), "centres")
    shared = written(dealt.join(centres.hint("merge"), F.col("band") == F.col("_b")).drop("_b"), "buckets")
    centred = shared.where((F.col("key") != F.col("c")) & near(F.col("n"), F.col("cn"))).select(F.col("c").alias("a"), F.col("key").alias("b"))
    first = written(centred.unionByName(proposed(nodes.select("key", "fp"))).distinct(), "pairs")
    edges = verified(first, at, text_col, similarity, shingle)
    roots = written(components(edges, "a", "b"), "roots")
    named = shared.select("band", "key").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    return edges.unionByName(across(written(named, "named"), at, text_col, similarity, shingle))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """docs with one row of each component of near copies: the one with the smallest id (of rows that repeat it the least by all columns).

    Documents link if the Jaccard similarity of their shingle sets (A-Z lower-cased, of all words where they are fewer)
    is at least similarity. Nulls: a null or empty text has the empty set, and all of these are one component; a null
    id is never the smallest unless all are null. Texts of any length count whole. An empty table gives no rows.
    Columns of any name are carried.
    """
    keep = docs.columns
    columns, names = boxed(docs, keep)
    id_col, text_col = names[keep.index(id_col)], names[keep.index(text_col)]
    docs = docs.select(*columns)
    at = written(signatures(docs, text_col, names, shingle), "signatures")
    edges = links(at, text_col, similarity, shingle)
    roots = written(components(edges, "a", "b"), "roots").withColumnRenamed("node", "_key")
    distinct = at.groupBy("_key").agg(F.min(id_col).alias("_id"))
    named = distinct.join(roots, "_key", "left").withColumn("root", F.coalesce("root", "_key"))
    # Nulls come last, so a known id wins.
    best = named.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_key")).alias("x"))
    best = best.select(F.col("x._key").alias("_k"), F.col("x._id").alias("_i"))
    kept = at.join(best, (F.col("_key") == F.col("_k")) & F.col(id_col).eqNullSafe(F.col("_i")))
    return unboxed(least_rows(kept, "_key", names), keep)
