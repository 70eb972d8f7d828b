"""Exact sparse search in blocks: documents and queries are packed as numbered terms, and every two blocks meet in a task.

A block of documents holds its own vocabulary and, for each document and term, a weight; a block of queries is the same.
A pair of blocks matches the vocabularies (equal, prefix, or inside), adds up products, and keeps the best of each query,
so no row for a document and query, or for a document and term, is ever shuffled. Memory is that of a pair of blocks.
Blocks of documents are made anew where they are read twice: as Parquet rows they would fill a reader's whole batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.sources.files import written

#: Documents, queries and terms of a block; products that are laid out at a time; terms that go by a matrix product.
ROWS, QUERIES, TERMS, LAID, DENSE = 1024, 1024, 1 << 18, 1 << 22, 512
#: Query blocks of so many terms together are sent to every task.
SENT = 4 << 20
Match = Callable[[pa.Array, pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _one(values) -> pa.ListArray:
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def packed(rows: DataFrame, id_col: str, size: int, prefix: str = "") -> DataFrame:
    """ids, dl, vocab, at (a document's number), code (a term's), w, all with prefix, of up to size rows (id, dl, terms, w: a weight for each term or null).

    A term that a row repeats stands once, with its weights added up. Null terms go.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    names = [prefix + c for c in ("ids", "dl", "vocab", "at", "code", "w")]

    def pack(batches):
        for b in batches:
            n = pc.fill_null(pc.list_value_length(b.column("terms")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            total, start = np.concatenate([[0], np.cumsum(n)]), 0
            while start < b.num_rows:
                end = min(start + size, max(start + 1, int(np.searchsorted(total, total[start] + TERMS, "right")) - 1))
                own = b.slice(start, end - start)
                flat = pc.list_flatten(own.column("terms"))
                at = np.repeat(np.arange(end - start), n[start:end])
                w = np.ones(len(flat)) if own.column("w").null_count else pc.list_flatten(own.column("w")).to_numpy(zero_copy_only=False)
                if flat.null_count:
                    good = pc.is_valid(flat).to_numpy(zero_copy_only=False)
                    flat, at, w = flat.filter(pa.array(good)), at[good], w[good]
                coded = flat.dictionary_encode()
                key, which = np.unique(at * max(1, len(coded.dictionary)) + coded.indices.to_numpy(), return_inverse=True)
                at, code = np.divmod(key, max(1, len(coded.dictionary)))
                cells = [_one(own.column(id_col)), _one(own.column("dl")), _one(coded.dictionary), _one(at.astype(np.int32)), _one(code.astype(np.int32)), _one(np.bincount(which, w, len(key)).astype(float))]
                yield pa.RecordBatch.from_arrays(cells, names)
                start = end

    schema = f"ids array<{kind}>, dl array<double>, vocab array<string>, at array<int>, code array<int>, w array<double>"
    own = rows.select(id_col, F.col("dl").cast("double").alias("dl"), "terms", "w")
    return own.mapInArrow(pack, ", ".join(prefix + c for c in schema.split(", ")))


def equal(vocab: pa.Array, terms: pa.Array):
    found = pc.index_in(vocab, value_set=terms)
    v = np.flatnonzero(pc.is_valid(found).to_numpy(zero_copy_only=False))
    return v, found.drop_null().to_numpy().astype(np.int64), np.ones(len(v))


def begins(vocab: pa.Array, terms: pa.Array):
    """A word of the vocabulary for each term that it begins with."""
    size, out = pc.utf8_length(vocab).to_numpy(zero_copy_only=False), []
    for n in sorted(set(pc.utf8_length(terms).to_pylist())):
        long = np.flatnonzero(size >= n)
        heads = pc.utf8_slice_codeunits(vocab.take(pa.array(long)), 0, n)
        v, t, _ = equal(heads, terms)
        out.append((long[v], t))
    v, t = (np.concatenate([x[i] for x in out]).astype(np.int64) if out else np.zeros(0, np.int64) for i in (0, 1))
    return v, t, np.ones(len(v))


def _points(words: list[str]) -> np.ndarray:
    return np.frombuffer("\n".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _threes(p: np.ndarray) -> np.ndarray:
    """A number for every three code points in a row."""
    return (p[:-2] << 42) | (p[1:-1] << 21) | p[2:]


def inside(vocab: pa.Array, terms: pa.Array):
    """How often, without overlaps, each word of the vocabulary holds a term of three characters or more.

    A term's first three characters find its places. Terms with white space match as equals alone.
    """
    words, asked = vocab.to_pylist(), terms.to_pylist()
    spaced = [any(c in t for c in " \t\n\x0b\f\r") for t in asked]
    heads = np.array([_threes(_points([t[:3]]))[0] if len(t) >= 3 and not s else -1 for t, s in zip(asked, spaced)], np.int64)
    whole = _points(words)
    keys = _threes(whole)
    at = np.flatnonzero(np.isin(keys, heads))
    at = at[np.argsort(keys[at], kind="stable")]
    number, place = _spread(heads, keys[at])
    cut, out = np.searchsorted(number, np.arange(len(asked) + 1)), [(np.zeros(0, np.int64),) * 2]
    for i, term in enumerate(asked):
        found = at[place[cut[i] : cut[i + 1]]]
        for j, c in enumerate(term[3:] if len(found) else "", 3):
            found = found[found + j < len(whole)]
            found = found[whole[found + j] == ord(c)]
        if len(found) > 1 and np.diff(found).min() < len(term):
            free, kept = -1, []
            for x in found.tolist():
                if x >= free:
                    kept.append(x)
                    free = x + len(term)
            found = np.array(kept, np.int64)
        out.append((found, np.full(len(found), i)))
    starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])
    v, t = np.searchsorted(starts, np.concatenate([x for x, _ in out]), "right") - 1, np.concatenate([x for _, x in out])
    both, n = np.unique(v * max(1, len(asked)) + t, return_counts=True)
    v, t = np.divmod(both, max(1, len(asked)))
    v2, t2, n2 = equal(vocab, terms)
    own = np.array([spaced[x] for x in t2], bool)
    return np.concatenate([v, v2[own]]), np.concatenate([t, t2[own]]), np.concatenate([n, n2[own]]).astype(float)


def _spread(key: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every key the places where sorted by has it: (number of the key, place), pair by pair."""
    lo, hi = np.searchsorted(by, key, "left"), np.searchsorted(by, key, "right")
    n = hi - lo
    number = np.repeat(np.arange(len(key)), n)
    return number, np.arange(len(number)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def matches(cells: tuple, vocab: pa.Array, terms: pa.Array, match: Match) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, weight) of a block for the query's terms; words that stand for one term add up."""
    at, code, w = cells
    v, t, times = match(vocab, terms)
    order = np.argsort(v, kind="stable")
    v, t, times = v[order], t[order], times[order]
    number, place = _spread(code, v)
    key, which = np.unique(at[number].astype(np.int64) * max(1, len(terms)) + t[place], return_inverse=True)
    doc, term = np.divmod(key, max(1, len(terms)))
    return doc, term, np.bincount(which, w[number] * times[place], len(key))


def products(n: int, doc, term, w, asked: int, query, q_term, q_w) -> np.ndarray:
    """queries x documents: sums of products over shared terms, -inf where none is shared. Terms of most pairs go by a matrix product."""
    terms = int(max(term.max(initial=-1), q_term.max(initial=-1))) + 1
    load = np.bincount(term, minlength=terms) * np.bincount(q_term, minlength=terms)
    heavy = np.argsort(-load)[:DENSE]
    heavy = heavy[load[heavy] * 64 > n * asked]
    scores = np.zeros((asked, n))
    place = np.full(terms, -1)
    place[heavy] = np.arange(len(heavy))
    d, q = place[term] >= 0, place[q_term] >= 0
    if len(heavy):
        x, y = np.zeros((n, len(heavy))), np.zeros((asked, len(heavy)))
        x[doc[d], place[term[d]]], y[query[q], place[q_term[q]]] = w[d], q_w[q]
        scores += y @ x.T
    doc, term, w, query, q_term, q_w = doc[~d], term[~d], w[~d], query[~q], q_term[~q], q_w[~q]
    order = np.argsort(q_term, kind="stable")
    query, q_term, q_w = query[order], q_term[order], q_w[order]
    laid, start = np.concatenate([[0], np.cumsum(load[term])]), 0
    flat = scores.reshape(-1)
    while start < len(doc):
        end = max(start + 1, int(np.searchsorted(laid, laid[start] + LAID, "right")) - 1)
        number, at = _spread(term[start:end], q_term)
        flat += np.bincount(query[at] * n + doc[start:end][number], w[start:end][number] * q_w[at], len(flat))
        start = end
    scores[scores <= 0] = -np.inf
    return scores


def _of(b: pa.RecordBatch, r: int, prefix: str = "") -> dict:
    arrow = {c: b.column(prefix + c)[r].values for c in ("ids", "vocab")}
    return arrow | {c: b.column(prefix + c)[r].values.to_numpy(zero_copy_only=False) for c in ("dl", "at", "code", "w")}


def pairs(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Every block of documents (packed) with every block of queries (packed with prefix q_), which q_block names."""
    q = written(queries.withColumn("q_block", F.expr("uuid()")), "query-blocks")
    size = q.agg(F.sum(F.size("q_code") + F.size("q_vocab"))).first()[0] or 0
    return docs.crossJoin(F.broadcast(q) if size <= SENT else q)


def single(rows: DataFrame, id_col: str) -> DataFrame:
    """Rows (id, dl, terms, w) whose ids repeat, as one: the terms of all, the longest length."""
    if rows.groupBy(id_col).count().where("count > 1").isEmpty():
        return rows
    together = rows.groupBy(id_col).agg(F.max("dl").alias("dl"), F.flatten(F.collect_list("terms")).alias("terms"), F.flatten(F.collect_list("w")).alias("_w"))
    return together.withColumn("w", F.when(F.size("_w") > 0, F.col("_w"))).drop("_w")


def texts(docs: DataFrame, id_col: str, text) -> DataFrame:
    """ids and texts of up to ROWS documents."""
    kind = docs.schema[id_col].dataType.simpleString()

    def pack(batches):
        for b in batches:
            total, start = np.concatenate([[0], np.cumsum(pc.binary_length(b.column("_t")).to_numpy(zero_copy_only=False))]), 0
            while start < b.num_rows:
                end = min(start + ROWS, max(start + 1, int(np.searchsorted(total, total[start] + 4 * TERMS, "right")) - 1))
                yield pa.RecordBatch.from_arrays([_one(b.column(c).slice(start, end - start)) for c in (id_col, "_t")], ["ids", "texts"])
                start = end

    return docs.select(id_col, F.coalesce(text, F.lit("")).alias("_t")).mapInArrow(pack, f"ids array<{kind}>, texts array<string>")


def trigram_cells(b: pa.RecordBatch, r: int, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, 1) of the query trigrams that the texts of a block hold, once each."""
    points = lambda a: np.frombuffer("".join(a.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    own, asked = b.column("texts")[r].values, points(terms).reshape(-1, 3)
    number = lambda x, y, z: (x << 42) | (y << 21) | z
    keys = number(*asked.T)
    order = np.argsort(keys)
    p, doc = points(own), np.repeat(np.arange(len(own)), pc.utf8_length(own).to_numpy(zero_copy_only=False))
    if len(p) < 3 or not len(keys):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    found = number(p[:-2], p[1:-1], p[2:])
    at = np.minimum(np.searchsorted(keys[order], found), len(keys) - 1)
    good = (keys[order][at] == found) & (doc[:-2] == doc[2:])
    doc, term = np.divmod(np.unique(doc[:-2][good] * len(keys) + order[at[good]]), len(keys))
    return doc, term, np.ones(len(doc))


def held_by(both: DataFrame, match: Match) -> DataFrame:
    """qterm, df: how many documents match each term of the queries."""

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                d, terms = _of(b, r), b.column("q_vocab")[r].values
                _, term, _ = matches((d["at"], d["code"], d["w"]), d["vocab"], terms, match)
                n = np.bincount(term, minlength=len(terms))
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([b.column("q_block")[r].as_py()] * len(some), pa.string()), terms.take(pa.array(some)), pa.array(n[some], pa.int64())], ["q_block", "qterm", "n"])

    each = both.mapInArrow(run, "q_block string, qterm string, n long")
    return each.groupBy("q_block", "qterm").agg(F.sum("n").alias("df")).groupBy("qterm").agg(F.max("df").alias("df"))


def best(both: DataFrame, query_id: str, doc_id: str, k: int, match: Match = equal, impact: Callable | None = None, cells: Callable | None = None) -> DataFrame:
    """query, document, score (six decimals): from each task the k best of a query, and ties. impact makes a weight of a term's own and the document's dl.

    cells gives (document, term, weight) of a block of another form than packed.
    """
    from trawl.operators.dense import HELD, _Best

    kinds = [both.schema[c].dataType.elementType.simpleString() for c in ("q_ids", "ids")]
    names = [query_id, doc_id, "score"]

    def run(batches) -> Iterator[pa.RecordBatch]:
        kept: dict[str, tuple[pa.Array, _Best]] = {}
        for b in batches:
            for r in range(b.num_rows):
                q, name, ids = _of(b, r, "q_"), b.column("q_block")[r].as_py(), b.column("ids")[r].values
                if name not in kept:
                    if len(kept) == HELD:
                        asked, own = kept.pop(next(iter(kept)))
                        yield from own.rows(asked, names)
                    kept[name] = q["ids"], _Best(len(q["ids"]), k)
                if cells:
                    doc, term, w = cells(b, r, q["vocab"])
                else:
                    d = _of(b, r)
                    doc, term, w = matches((d["at"], d["code"], d["w"]), d["vocab"], q["vocab"], match)
                    w = impact(w, d["dl"][doc]) if impact else w
                if len(doc):
                    scores = products(len(ids), doc, term, w, len(q["ids"]), q["at"].astype(np.int64), q["code"], q["w"])
                    kept[name][1].add(np.floor(scores * 1e6 + 0.5) / 1e6, ids)
        for asked, own in kept.values():
            yield from own.rows(asked, names)

    return both.mapInArrow(run, f"`{query_id}` {kinds[0]}, `{doc_id}` {kinds[1]}, score double")
