"""Approximate nearest neighbours by balanced posting lists.

Largest inner products become smallest distances by one more coordinate, the root of M^2 - |x|^2 (0 for queries).
Centroids come from balanced k-means on a bounded sample and stay in memory, linked by a graph of near neighbours
and some far ones. Every vector goes to the list of its nearest centroid and, near a boundary, to further lists whose
centroids are hardly farther and not behind one already taken. A query walks the graph to the centroids near it and
probes those whose distance is within a ratio of the nearest's. Lists and the queries that probe them are cut into
blocks of bounded size, so a crowded list is many tasks and no task holds more than one block of each. Equal vectors are one entry: its smallest ids answer for all, exactly.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.shared import written


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray  # (lists, dim + 1)
    graph: np.ndarray  # (lists, degree) neighbours
    entries: np.ndarray  # where walks start
    top: float  # M, the largest norm


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], 0)


def raised(x: np.ndarray, top: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(top * top - (x * x).sum(1), 0))[:, None]])


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 12, seed: int = 42) -> np.ndarray:
    """k-means whose assignment costs more the fuller a list is; an empty list restarts at the farthest point."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    fill = np.full(k, len(x) / k)
    for _ in range(rounds):
        d = squared(x, c)
        scale = d.min(1).mean() / (len(x) / k)
        at = (d + 0.5 * scale * fill[None]).argmin(1)
        fill = np.bincount(at, minlength=k).astype(float)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        full = fill > 0
        c[full] = total[full] / fill[full, None]
        if (~full).any():
            c[~full] = x[np.argsort(-d.min(1))[: int((~full).sum())]]
    return c


def link(c: np.ndarray, degree: int = 24, far: int = 4, seed: int = 42) -> np.ndarray:
    """Each centroid's nearest others and a few random ones."""
    k, rng = len(c), np.random.default_rng(seed)
    near = min(degree, k - 1)
    if k == 1:
        return np.zeros((1, 1), np.int64)
    out = []
    for i in range(0, k, 1024):
        d = squared(c[i : i + 1024], c)
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        out.append(np.argpartition(d, near - 1, axis=1)[:, :near])
    graph = np.hstack([np.vstack(out), rng.integers(0, k, (k, far))])
    by = np.argsort(graph, axis=1, kind="stable")
    same = np.diff(np.take_along_axis(graph, by, 1), axis=1, prepend=-1) == 0
    again = np.zeros_like(same)
    np.put_along_axis(again, by, same, 1)
    return np.where(again, np.arange(k)[:, None], graph)  # a repeated link points home


def walk(index: Index, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared distances, centroids) of about the width nearest for each query, nearest first: best-first over the graph, all queries at once."""
    c, n, k = index.centroids, len(q), len(index.centroids)
    width = min(width, k)
    seen = np.zeros((n, k), bool)
    own = np.broadcast_to(index.entries, (n, len(index.entries)))
    seen[:, index.entries] = True
    dist = squared(q, c[index.entries])
    ids, opened = own.copy(), np.zeros(own.shape, bool)
    row = np.arange(n)[:, None]
    while True:
        open_d = np.where(opened, np.inf, dist)
        best = open_d.argmin(1)
        live = np.isfinite(open_d[np.arange(n), best])
        if not live.any():
            break
        opened[np.arange(n), best] = True
        nodes = index.graph[ids[np.arange(n), best]]
        fresh = ~seen[row, nodes] & live[:, None]
        seen[row, nodes] = True
        d = np.einsum("nd,nd->n", q, q)[:, None] - 2 * np.einsum("nd,nkd->nk", q, c[nodes]) + np.einsum("nkd,nkd->nk", c[nodes], c[nodes])
        dist = np.hstack([dist, np.where(fresh, np.maximum(d, 0), np.inf)])
        ids, opened = np.hstack([ids, nodes]), np.hstack([opened, ~fresh])
        if dist.shape[1] > width:
            keep = np.argpartition(dist, width - 1, axis=1)[:, :width]
            dist, ids, opened = dist[row, keep], ids[row, keep], opened[row, keep]
    by = np.argsort(dist, axis=1)
    return dist[row, by], ids[row, by]


def lists_of(index: Index, x: np.ndarray, ratio: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of each copy of each vector: nearest list, and near ones that no taken one stands before."""
    c = index.centroids
    d = squared(x, c)
    m = min(most, len(c))
    near = np.argpartition(d, m - 1, axis=1)[:, :m]
    row = np.arange(len(x))[:, None]
    near = near[row, np.argsort(d[row, near], axis=1)]
    own = d[row, near]
    take = own <= own[:, :1] * ratio**2
    for j in range(1, m):
        between = ((c[near[:, j]][:, None] - c[near[:, :j]]) ** 2).sum(2)
        take[:, j] &= ~((between < own[:, j : j + 1] * 0.5) & take[:, :j]).any(1)
    i, j = np.nonzero(take)
    return i, near[i, j]


def build_index(sample: np.ndarray, top: float, n: int, per_list: int = 4096, least: int = 64) -> Index:
    x = raised(sample, top)
    k = int(max(1, min(max(n // per_list, min(least, n // 128)), len(sample) // 8, 4096)))
    c = balanced_centroids(x, k)
    rng = np.random.default_rng(7)
    return Index(c, link(c), np.unique(rng.integers(0, k, 8)), top)


def clean_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, key (of equal vectors) and vec (float64 bytes) of the vectors that take part: finite, not zero, of the commonest dimension."""
    v = F.col(vec_col)
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(v, lambda x: x != 0)
    held = df.where(good & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: x.cast("double")).alias("vec"))
    dims = held.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim = dims[0]["d"] if dims else 0

    def pack(batches):
        for b in batches:
            flat = (b.column("vec").flatten().to_numpy(zero_copy_only=False) + 0.0).reshape(-1, dim)  # -0.0 equals 0.0
            raw = [r.tobytes() for r in flat]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([hashlib.md5(r).digest() for r in raw], pa.binary()), pa.array(raw, pa.binary())], ["id", "key", "vec"])

    return held.where(F.size("vec") == dim).mapInArrow(pack, "id bigint, key binary, vec binary")


def _matrix(raw) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def nearest(df: DataFrame, queries, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, sample: int = 16_384, per_list: int = 4096, replica_ratio: float = 1.1, replicas: int = 4, probe_ratio: float = 1.2, probes: int = 12, width: int = 256, block: int = 4096, query_block: int = 8192) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (inner product, double) of the k nearest found to each query.

    queries: a condition on id (given as a function of a Column); candidates are all rows but the query's own. Ties go to the smaller id.
    The index is fitted on sample vectors at most (by a hash of their content); every vector is indexed. Nulls: a
    null id or vector takes no part, nor does a vector that is zero, not finite, or of another dimension than most.
    Repeated rows are candidates of their own. Without candidates there are no rows. Other columns are not read.
    """
    rows = written(clean_vectors(df, id_col, vec_col), "vectors")
    first = Window.partitionBy("key").orderBy("id")
    few = rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1)
    entries = written(few.groupBy("key").agg(F.first("vec").alias("vec"), F.array_sort(F.collect_list("id")).alias("ids")), "entries")
    n = entries.count()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not n:
        return df.sparkSession.createDataFrame([], schema)

    def norms(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_pydict({"m": [float(np.sqrt((_matrix(b.column("vec").to_pylist()) ** 2).sum(1)).max())]})

    top = entries.mapInArrow(norms, "m double").agg(F.max("m")).first()[0] * (1 + 1e-12)
    picked = entries.select("vec", F.xxhash64("key").alias("h"), "key").orderBy("h", "key").limit(sample).select("vec").toPandas()
    index = build_index(_matrix(list(picked["vec"])), top, n, per_list)
    held = df.sparkSession.sparkContext.broadcast(index)  # 4096 centroids at most, and their graph

    def post(batches):
        for b in batches:
            if b.num_rows:
                x = raised(_matrix(b.column("vec").to_pylist()), held.value.top)
                i, at = lists_of(held.value, x, replica_ratio, replicas)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), b.column("key").take(pa.array(i)), b.column("vec").take(pa.array(i))], ["list", "key", "vec"])

    def probe(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                q = _matrix(part.column("vec").to_pylist())
                d, c = walk(held.value, np.hstack([q, np.zeros((len(q), 1))]), width)
                near = (d <= d[:, :1] * probe_ratio**2) | (np.arange(d.shape[1]) < probes)  # a query very near one centroid still looks around
                i, j = np.nonzero(np.isfinite(d) & near)
                yield pa.RecordBatch.from_arrays([pa.array(c[i, j], pa.int32()), part.column("key").take(pa.array(i)), part.column("vec").take(pa.array(i))], ["list", "key", "vec"])

    posted = written(entries.select("key", "vec").mapInArrow(post, "list int, key binary, vec binary"), "postings")
    asked = rows.where(queries(F.col("id")))
    distinct = asked.select("key").distinct().join(entries.select("key", "vec"), "key")
    probed = written(distinct.select("key", "vec").mapInArrow(probe, "list int, key binary, vec binary"), "probes")
    parts = lambda df, name, size: df.groupBy("list").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    blocks = F.broadcast(parts(posted, "_b", block).join(parts(probed, "_c", query_block), "list"))  # a row for each list that is probed
    left = posted.join(blocks, "list").withColumn("block", F.pmod(F.xxhash64("key"), F.col("_b")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_c") - 1))).drop("_b", "_c")
    right = probed.join(blocks, "list").withColumn("part", F.pmod(F.xxhash64("key", F.lit(5)), F.col("_c")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_b") - 1))).drop("_b", "_c")

    def match(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(v) or not len(q):
            return pd.DataFrame({"query": pd.Series([], dtype=object), "key": pd.Series([], dtype=object), "score": pd.Series([], dtype=float)})
        x, keys = _matrix(list(v["vec"])), v["key"].to_numpy()
        out = []
        for lo in range(0, len(q), 1024):
            s = _matrix(list(q["vec"].iloc[lo : lo + 1024])) @ x.T
            m = min(k + 1, s.shape[1])
            # all that tie with the last one stay: ids decide among them later
            last = -np.partition(-s, m - 1, axis=1)[:, m - 1 : m]
            i, j = np.nonzero(s >= last)
            out.append(pd.DataFrame({"query": q["key"].to_numpy()[lo + i], "key": keys[j], "score": s[i, j]}))
        return pd.concat(out)

    found = left.groupBy("list", "block", "part").cogroup(right.groupBy("list", "block", "part")).applyInPandas(match, "query binary, key binary, score double")
    once = found.groupBy("query", "key").agg(F.max("score").alias("score")).join(entries.select("key", "ids"), "key")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0])
    classes = once.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1)
    answers = classes.groupBy("query").agg(F.collect_list(F.struct((-F.col("score")).alias("s"), "ids")).alias("c"))
    flat = F.flatten(F.transform("c", lambda x: F.transform(x["ids"], lambda i: F.struct(x["s"].alias("s"), i.alias("id")))))
    answers = answers.select("query", F.slice(F.array_sort(flat), 1, k + 1).alias("a"))
    own = asked.select(F.col("id").alias("query_id"), F.col("key").alias("query"))
    listed = own.join(answers, "query").select("query_id", F.slice(F.filter("a", lambda x: x["id"] != F.col("query_id")), 1, k).alias("a"))
    return listed.select("query_id", F.posexplode("a").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score"))
