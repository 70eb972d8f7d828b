"""Dense search: a stated set of queries against all rows, in blocks of both that meet on executors.

Rows are packed into blocks of a few thousand vectors, queries into blocks of their own; each pair of blocks is one
matrix product in a task, which keeps the best of every query over all the pairs that it meets and sends only these on.
The driver holds neither. quantise writes the index as product-quantised codes, some sixteen bytes a vector: a search
then reads codes, keeps a shortlist by table lookups, and scores only that with the vectors themselves.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.operators.lexical import top_k
from trawl.sources.files import fresh_folder, written

#: Rows of the index, and queries, of a block; query blocks of so many bytes together are sent to every task.
ROWS, QUERIES, SENT = 4096, 1024, 64 << 20
#: Query blocks whose best a task holds at a time; queries whose scores are copied at a time.
HELD, SLAB = 16, 64


def _vectors(batch: pa.RecordBatch, id_col: str) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(dimension, ids, vectors of length one) of a batch with _v; null, zero and non-finite vectors are left out."""
    lists = batch.column("_v")
    n = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)  # null components are NaN
    for dim in sorted(set(n.tolist()) - {0}):
        at = np.flatnonzero(n == dim)
        x = flat[np.repeat(n == dim, n)].reshape(-1, dim)
        length = np.sqrt((x * x).sum(1))
        good = np.isfinite(length) & (length > 0)
        if good.any():
            yield dim, batch.column(id_col).take(pa.array(at[good])), x[good] / length[good, None]


def packed(rows: DataFrame, id_col: str, vec: str, size: int) -> DataFrame:
    """ids, dim and flat (their vectors, scaled to length one, one after another) of up to size rows."""
    kind = rows.schema[id_col].dataType.simpleString()

    def batch_of(dim: int, parts: list) -> pa.RecordBatch:
        ids = pa.concat_arrays([p[0] for p in parts])
        flat = np.concatenate([p[1] for p in parts]).ravel()
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.RecordBatch.from_arrays([one(ids), pa.array([dim], pa.int32()), one(pa.array(flat))], ["ids", "dim", "flat"])

    def pack(batches):
        held: dict[int, list] = {}
        for b in batches:
            for dim, ids, x in _vectors(b, id_col):
                for i in range(0, len(x), size):
                    held.setdefault(dim, []).append((ids.slice(i, size), x[i : i + size]))
                    if sum(len(p[1]) for p in held[dim]) >= size:
                        yield batch_of(dim, held.pop(dim))
        for dim, parts in held.items():
            yield batch_of(dim, parts)

    own = rows.select(id_col, F.transform(vec, lambda x: x.cast("double")).alias("_v")).where(F.size("_v") > 0)
    return own.mapInArrow(pack, f"ids array<{kind}>, dim int, flat array<double>")


class _Best:
    """The k best rows of each query of a block, over the row blocks that it has met; rows that tie with the last stay."""

    def __init__(self, queries: int, k: int):
        self.k, self.limit = k, np.full(queries, np.finfo(float).min)  # -inf is no score
        self.parts: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        self.n = 0

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        at = scores.shape[1] - min(self.k, scores.shape[1])
        found = []
        for a in range(0, len(scores), SLAB):  # no copy of the whole matrix
            own = scores[a : a + SLAB]
            least = np.maximum(self.limit[a : a + SLAB], np.partition(own, at, axis=1)[:, at])
            i, j = np.nonzero(own >= least[:, None])
            found.append((i + a, j, own[i, j]))
        i, j, s = (np.concatenate(x) for x in zip(*found))
        self.parts.append((i, ids.take(pa.array(j)), s))
        self.n += len(i)
        if self.n > 8 * self.k * len(self.limit):
            self._cut()

    def put(self, i: np.ndarray, ids: pa.Array, s: np.ndarray) -> None:
        """Scores of chosen rows for queries i; the limits rise at once."""
        self.parts.append((i, ids, s))
        self._cut()

    def _cut(self) -> None:
        i, ids, s = np.concatenate([p[0] for p in self.parts]), pa.concat_arrays([p[1] for p in self.parts]), np.concatenate([p[2] for p in self.parts])
        number = pa.types.is_integer(ids.type) and not ids.null_count
        by = np.lexsort((ids.to_numpy(), -s, i)) if number else np.lexsort((-s, i))
        i, s = i[by], s[by]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        last = np.flatnonzero(place == self.k - 1)
        self.limit[i[last]] = s[last]
        keep = place < self.k if number else s >= self.limit[i]
        self.parts = [(i[keep], ids.take(pa.array(by[keep])), s[keep])]
        self.n = int(keep.sum())

    def rows(self, queries: pa.Array, names: list[str]) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self._cut()
            i, ids, s = self.parts[0]
            for a in range(0, len(i), 65536):
                yield pa.RecordBatch.from_arrays([queries.take(pa.array(i[a : a + 65536])), ids.slice(a, 65536), pa.array(s[a : a + 65536])], names)


def _meet(rows: DataFrame, queries: DataFrame, score: Callable, k: int, query_id: str, vec_id: str) -> DataFrame:
    """query, row, score: every block of rows with every block of queries, the k best of a query (and ties) from each task."""
    kinds = [queries.schema["ids"].dataType.elementType.simpleString(), rows.schema["ids"].dataType.elementType.simpleString()]
    q = written(queries.select(F.col("ids").alias("q_ids"), F.col("dim").alias("q_dim"), F.col("flat").alias("q_flat"), F.expr("uuid()").alias("q_block")), "query-blocks")
    size = q.agg(F.sum(F.size("q_flat"))).first()[0] or 0
    pairs = rows.crossJoin(F.broadcast(q) if 8 * size <= SENT else q)

    def run(batches):
        held: dict[str, tuple[pa.Array, _Best]] = {}
        for b in batches:
            for r in range(b.num_rows):
                if b.column("q_dim")[r].as_py() != b.column("dim")[r].as_py():
                    continue
                name, ids = b.column("q_block")[r].as_py(), b.column("q_ids")[r].values
                if name not in held:
                    if len(held) == HELD:
                        asked, best = held.pop(next(iter(held)))
                        yield from best.rows(asked, [query_id, vec_id, "score"])
                    held[name] = ids, _Best(len(ids), k)
                flat = b.column("q_flat")[r].values.to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                held[name][1].add(score(flat, b, r), b.column("ids")[r].values)
        for asked, best in held.values():
            yield from best.rows(asked, [query_id, vec_id, "score"])

    return pairs.mapInArrow(run, f"`{query_id}` {kinds[0]}, `{vec_id}` {kinds[1]}, score double")


def dense_top_k(queries: DataFrame, index: DataFrame, query_id: str, vec_id: str, vec: str, query_vec: str, k: int = 10, block: int = QUERIES) -> DataFrame:
    """The k nearest of index by cosine (six decimals) for each query, ties to the smaller id, exactly: the stated queries against all rows.

    Vectors that are null, zero, not finite or of another dimension than the query match nothing.
    """

    def score(q, b, r):
        x = b.column("flat")[r].values.to_numpy(zero_copy_only=False).reshape(-1, q.shape[1])
        scores = q @ x.T
        return np.round(scores, 6, out=scores)

    found = _meet(packed(index, vec_id, vec, ROWS), packed(queries, query_id, query_vec, block), score, k, query_id, vec_id)
    return top_k(found, query_id, [F.desc("score"), F.col(vec_id)], k)


# Product quantisation


@dataclass(frozen=True)
class Quantised:
    spark: SparkSession
    path: str
    vec_id: str
    books: np.ndarray  # parts x centroids x width: part p of a vector is near one of books[p]

    def codes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/codes")

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - 0.5 * (centres * centres).sum(1)).argmax(1)


def train(sample: np.ndarray, parts: int, centroids: int = 256, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Lloyd's rounds in each of parts slices of the vectors; a centroid that nothing is near stays where it is."""
    r = np.random.default_rng(seed)
    width = sample.shape[1] // parts
    books = np.zeros((parts, centroids, width))
    for p in range(parts):
        x = sample[:, p * width : (p + 1) * width]
        centres = x[r.choice(len(x), centroids, replace=len(x) < centroids)].copy()
        for _ in range(rounds):
            near = _nearest(x, centres)
            n = np.bincount(near, minlength=centroids)
            total = np.zeros_like(centres)
            np.add.at(total, near, x)
            centres[n > 0] = total[n > 0] / n[n > 0, None]
        books[p] = centres
    return books


def quantise(index: DataFrame, vec_id: str, vec: str, path: str, parts: int | None = None, sample: int = 16_384) -> Quantised:
    """Writes codes (blocks: ids, dim, codes) and vectors (vec_id, unit) into path and opens them.

    The codebooks are learnt from at most sample vectors, spread over the table by a hash of their ids; every vector of
    the commonest dimension is encoded. parts must divide the dimension (default: slices of two components).
    """
    spark = index.sparkSession
    blocks = written(packed(index, vec_id, vec, ROWS), "row-blocks")
    sizes = blocks.groupBy("dim").agg(F.sum(F.size("ids")).alias("n")).orderBy(F.desc("n"), "dim").first()
    dim, total = (sizes["dim"], sizes["n"]) if sizes else (2, 0)
    parts = parts or max(1, dim // 2)
    if dim % parts:
        raise ValueError("parts must divide the dimension")
    share = min(1.0, 1.2 * sample / max(total, 1))
    own = index.select(vec_id, F.transform(vec, lambda x: x.cast("double")).alias("_v")).where(F.size("_v") == dim)
    picked = own.where(F.pmod(F.xxhash64(vec_id), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(sample).toArrow()
    held = [x for b in picked.combine_chunks().to_batches() for _, _, x in _vectors(b, vec_id)]
    learnt = np.concatenate(held) if held else np.ones((1, dim)) / np.sqrt(dim)
    books = train(learnt, parts)
    kind = index.schema[vec_id].dataType.simpleString()

    def encode(batches):
        for b in batches:
            for r in range(b.num_rows):
                x = b.column("flat")[r].values.to_numpy(zero_copy_only=False).reshape(-1, dim)
                width = dim // parts
                codes = np.stack([_nearest(x[:, p * width : (p + 1) * width], books[p]) for p in range(parts)], 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([b.column("ids").slice(r, 1), b.column("dim").slice(r, 1), pa.array([codes.tobytes()], pa.binary())], ["ids", "dim", "codes"])

    def unpack(batches):
        for b in batches:
            for r in range(b.num_rows):
                ids, flat = b.column("ids")[r].values, b.column("flat")[r].values
                units = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * dim), flat)
                yield pa.RecordBatch.from_arrays([ids, units], [vec_id, "unit"])

    fitting = blocks.where(F.col("dim") == dim)
    fitting.mapInArrow(encode, f"ids array<{kind}>, dim int, codes binary").write.parquet(f"{path}/codes")
    fitting.mapInArrow(unpack, f"`{vec_id}` {kind}, unit array<double>").write.parquet(f"{path}/vectors")
    return Quantised(spark, path, vec_id, books)


def quantised_top_k(queries: DataFrame, index: Quantised, query_id: str, query_vec: str, k: int = 10, shortlist: int = 200) -> DataFrame:
    """The k best by cosine (six decimals) of a shortlist of each query: query id, vec_id, score, rank.

    The shortlist is the best by the codes, over all rows: a query's product with each centroid of each part is a
    table, and a row's score the sum of the entries that its code names. The shortlist alone meets its vectors.
    """
    books, vec_id = index.books, index.vec_id
    parts, _, width = books.shape

    def score(q, b, r):
        if q.shape[1] != parts * width:
            return np.full((len(q), len(b.column("ids")[r].values)), -np.inf)
        codes = np.frombuffer(b.column("codes")[r].as_py(), np.uint8).reshape(-1, parts)
        tables = np.einsum("qpw,pcw->pcq", q.reshape(len(q), parts, width), books).astype(np.float32)
        out = np.zeros((len(codes), len(q)), np.float32)
        for p in range(parts):
            out += tables[p][codes[:, p]]
        return out.T.astype(float)

    asked = written(packed(queries, query_id, query_vec, QUERIES // 4), "queries")
    near = top_k(_meet(index.codes(), asked, score, shortlist, query_id, vec_id), query_id, [F.desc("score"), F.col(vec_id)], shortlist).select(query_id, vec_id)
    unit = F.transform(query_vec, lambda x: x.cast("double"))
    both = near.join(index.vectors(), vec_id).join(queries.select(query_id, unit.alias("_q")), query_id)
    length = F.sqrt(F.aggregate("_q", F.lit(0.0), lambda a, x: a + x * x))
    dot = F.aggregate(F.zip_with("_q", "unit", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    exact = both.select(query_id, vec_id, F.round(dot / length, 6).alias("score"))
    return top_k(exact, query_id, [F.desc("score"), F.col(vec_id)], k)


_kept: dict[tuple[str, str], Quantised] = {}


def kept(spark: SparkSession, name: str, vectors: Callable[[], DataFrame], vec_id: str, vec: str) -> Quantised:
    """The quantised index of that name of this application, written at the first call (and again where its folder is gone)."""
    key = spark.sparkContext.applicationId, name
    if found := _kept.get(key):
        there = spark._jvm.org.apache.hadoop.fs.Path(f"{found.path}/vectors/_SUCCESS")
        if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
            return found
    _kept[key] = quantise(vectors(), vec_id, vec, fresh_folder(spark, f"quantised-{uuid.uuid4().hex}"))
    return _kept[key]
