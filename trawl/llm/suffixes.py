"""Exact repeats by a sparse suffix array: every byte of a string of width bytes that also starts elsewhere.

A full suffix array of all byte positions would shuffle an entry for each byte. Here only suffixes at anchors are
sorted: in each window of width bytes the anchor is the start of the k-gram with the smallest hash, so equal windows
have equal anchors at the same place, and each window start belongs to one anchor. Anchors whose k-gram occurs once
in the corpus are dropped. Of an anchor's window starts lo..hi the context is the text from lo to hi + width; equal
contexts are counted before anything is dealt, so a group of copies is one entry, and where the whole context occurs
twice all its windows repeat. All others are range-partitioned by the leading bytes of their suffixes, at splitters
that Spark samples; equal leading bytes share a bucket, so no comparison crosses a boundary. A bucket is sorted by
multikey quicksort, eight bytes at a time, once by the suffixes and once by what stands before them, and neighbours
are compared byte by byte: a window at distance d before an anchor repeats if another entry shares d bytes to the
left and width - d to the right.

A k-gram that more than MOST different contexts share (the edge of a very common passage, a periodic text) would be
one long run in one bucket. Its windows are cut into bands of 64, then 8, then 1 distances from the anchor; all
windows of a band share width - 63 (- 7, - 0) bytes, a far longer string, which takes the k-gram's place. Bands that
share it with nothing go, equal ones are counted again, and what is still shared by too many is cut again.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.shared import blocks, fresh_path, lean, note, small_batches, written

WIDTH, GRAM = 400, 64
#: Different contexts of a k-gram that one task compares; those of a commoner one are cut into bands (module text).
MOST, BANDS = 8192, (64, 8, 1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POS = 24  # bits of a position in a minimum's key; longer texts are taken in segments
_ITEMS = "core bigint, fa bigint, fb bigint, loc bigint, tid binary, weight int"


class Hasher:
    """Hashes of any substring in constant time, modulo 2^64, from the prefix sums of byte codes times powers of an odd base."""

    def __init__(self, seed: int):
        self.codes = np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(_BASE) + 2 * seed
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 2 * len(self.powers))
            self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, self.base)]), dtype=np.uint64)
            self.inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, self.inverse)]), dtype=np.uint64)

    def prefix(self, raw: np.ndarray) -> np.ndarray:
        self._grow(len(raw) + 1)
        out = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.codes[raw] * self.powers[: len(raw)], dtype=np.uint64, out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (prefix[end] - prefix[start]) * self.inverses[start]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        return x ^ (x >> np.uint64(29))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of all windows of w values: prefix minima of blocks against suffix minima."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def anchors(raw: np.ndarray, grams_of: Hasher, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(k-gram hash, two words of the context's digest, anchor, lo, hi) of each run of window starts that share an anchor."""
    n = len(raw)
    out = []
    span = (1 << _POS) - width
    for at in range(0, max(n - width + 1, 0), span):
        part = raw[at : at + span + width - 1]
        grams = np.arange(len(part) - gram + 1)
        h = grams_of.of(grams_of.prefix(part), grams, grams + gram)
        low = sliding_min((h >> np.uint64(_POS) << np.uint64(_POS)) | grams.astype(np.uint64), width - gram + 1)
        where = (low & np.uint64((1 << _POS) - 1)).astype(np.int64)
        lo = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        hi = np.append(lo[1:], len(where)) - 1
        p = where[lo]
        out.append((h[p], *_context(part, p, lo, hi, width), p + at, lo + at, hi + at))
    if not out:
        return tuple(np.zeros(0, np.uint64 if i < 3 else np.int64) for i in range(6))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _context(raw: np.ndarray, p: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the SHA-256 of each context's bytes, and of where its anchor stands in it.

    What is equal here is removed unseen, so it must be a digest that no text can be made to deceive. (A k-gram's
    hash may collide: it only says which strings are compared.)
    """
    view, sha = memoryview(np.ascontiguousarray(raw)), hashlib.sha256
    digests = np.frombuffer(b"".join([sha(view[a:z]).digest()[:16] for a, z in zip(lo.tolist(), (hi + width).tolist(), strict=True)]), np.uint64).reshape(-1, 2)
    return digests[:, 0], digests[:, 1] ^ ((p - lo) * (width + 1) + hi - lo).astype(np.uint64)


def bands_of(raw: np.ndarray, grams_of: Hasher, q: np.ndarray, lo: np.ndarray, hi: np.ndarray, band: int, width: int) -> tuple[np.ndarray, ...]:
    """Window starts lo..hi before anchors q, cut into bands of distances: (entry, hash of what a band's windows share, two words of the context's digest, new anchor, lo, hi)."""
    least, most = (q - hi) // band, (q - lo) // band
    n = most - least + 1
    entry = np.repeat(np.arange(len(q)), n)
    j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + least[entry]
    at = q[entry] - j * band
    start, end = np.maximum(lo[entry], at - band + 1), np.minimum(hi[entry], at)
    shared = grams_of.of(grams_of.prefix(raw), at, at + width - band + 1) ^ np.uint64(band)
    return entry, shared, *_context(raw, at, start, end, width), at, start, end


def multikey_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of words and their groups of equals; each word splits only the groups that are still shared."""
    order, group = np.arange(len(keys)), np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    for j in range(keys.shape[1]):
        if len(live) < 2:
            break
        word = keys[order[live], j]
        by = np.lexsort((word, group[live]))
        order[live], word, old = order[live][by], word[by], group[live][by]
        new = np.concatenate([[True], (word[1:] != word[:-1]) | (old[1:] != old[:-1])])
        start = np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))
        group[live] = live[start]  # a group is named by the place of its first row
        size = np.bincount(start, minlength=len(live))
        live = live[size[start] > 1]
    return order, group


def _padded(raw: np.ndarray, start: np.ndarray, length: np.ndarray, width: int, step: int) -> np.ndarray:
    """A row for each string, its bytes forward (step 1) or backward (-1) from start, then zeros."""
    i = np.arange(width)
    at = start[:, None] + step * i
    inside = i < length[:, None]
    return np.where(inside, raw[np.where(inside, at, 0)], 0).astype(np.uint8)


def _sorted_shared(strings: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of strings in their groups, by multikey quicksort, and the bytes that each shares with the one before (-1: another group)."""
    n, width = strings.shape
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = strings
    order, _ = multikey_order(np.hstack([group.astype(np.uint64)[:, None], words.view(">u8").astype(np.uint64)]))
    shared = np.full(n, -1, np.int64)
    differ = strings[order[1:]] != strings[order[:-1]]
    shared[1:] = np.where(differ.any(1), differ.argmax(1), width)
    shared[1:][group[order[1:]] != group[order[:-1]]] = -1
    return order, shared


def repeating(raw: np.ndarray, begin: np.ndarray, core: np.ndarray, q: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int) -> np.ndarray:
    """(entries x distances) whether the window at each distance before an entry's anchor occurs in another entry of its core.

    raw holds the contexts one after another, begin where each starts in it.
    """
    n, far = len(q), int((q - lo).max()) + 1
    _, group = np.unique(core, return_inverse=True)
    anchor = begin + q - lo
    f_order, f_shared = _sorted_shared(_padded(raw, anchor, hi + width - q, width, 1), group)
    b_order, b_shared = _sorted_shared(_padded(raw, anchor - 1, q - lo, far, -1), group)
    hit = np.zeros((n, far), bool)
    near, away = q - hi, q - lo
    size = np.bincount(group)
    # Two entries: they share f bytes to the right and b to the left, so all distances from width - f to b repeat.
    two = np.flatnonzero(size[group[f_order]] == 2)[1::2]
    x, y = f_order[two - 1], f_order[two]
    left = np.empty(n, np.int64)
    left[b_order] = b_shared
    after = np.empty(n, np.int64)
    after[b_order[:-1]], after[b_order[-1]] = b_shared[1:], -1
    b = np.maximum(left[x], after[x])
    a = np.maximum.reduce([width - f_shared[two], near[x], near[y]])
    z = np.minimum.reduce([b, away[x], away[y]])
    d = np.arange(far)
    inside = (d >= a[:, None]) & (d <= z[:, None])
    hit[x], hit[y] = inside, inside
    # More: at each distance, entries in one class of the suffix order and one of the other.
    some = size[group] > 2
    f_at, b_at = f_order[some[f_order]], b_order[some[b_order]]
    f_cut, b_cut = f_shared[some[f_order]], b_shared[some[b_order]]
    f_class, b_class = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for d in range(far if len(f_at) else 0):
        f_class[f_at], b_class[b_at] = np.cumsum(f_cut < width - d), np.cumsum(b_cut < d)
        own = f_at[(near[f_at] <= d) & (d <= away[f_at])]
        if len(own) > 1:
            key = f_class[own] * (n + 1) + b_class[own]
            by = np.argsort(key, kind="stable")
            same = key[by][1:] == key[by][:-1]
            again = np.zeros(len(own), bool)
            again[1:] |= same
            again[:-1] |= same
            hit[own[by[again]], d] = True
    return hit


def _bytes_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column one after another, and where each row's start."""
    lengths = np.asarray(pa.compute.binary_length(column).to_numpy(), np.int64)
    raw = np.frombuffer(b"".join(x for x in column.to_pylist()), np.uint8)
    return raw, np.cumsum(lengths) - lengths


def _compared(block: pa.Table, width: int) -> list[pa.RecordBatch]:
    """tid, start and end of the runs of repeating windows of a block's entries of weight 1 (of heavier ones all go already)."""
    core, q, lo, hi, weight = (block.column(c).to_numpy() for c in ("core", "q", "lo", "hi", "weight"))
    raw, begin = _bytes_of(block.column("context"))
    hit = repeating(raw, begin, core, q, lo, hi, width)
    hit[weight > 1] = False
    edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    i, near = np.nonzero(edge == 1)
    _, away = np.nonzero(edge == -1)  # one past the last distance; runs of a row come in the same order
    if not len(i):
        return []
    start, end = q[i] - away + 1, q[i] - near + width
    return pa.table([block.column("tid").take(pa.array(i)), pa.array(start), pa.array(end)], ["tid", "start", "end"]).combine_chunks().to_batches()


def find_repeats(texts: DataFrame, width: int = WIDTH, gram: int = GRAM, most: int | None = None) -> DataFrame:
    """tid and spans (array<struct<start, end>>, may overlap) of each text with bytes that repeat; texts: tid, body (binary), copies."""
    assert width <= 1024, "loc holds distances of 10 bits"
    most = MOST if most is None else most

    def rows(core, fa, fb, q, lo, hi, tid, weight):
        loc = q << 20 | (q - lo) << 10 | (q - hi)
        cols = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (core, fa, fb, loc)]
        return pa.RecordBatch.from_arrays([*cols, tid, pa.array(weight, pa.int32())], ["core", "fa", "fb", "loc", "tid", "weight"])

    @lean
    def scan(batches):
        grams_of = Hasher(1)
        for b in batches:
            parts = []
            for i, (body, copies) in enumerate(zip(b.column("body").to_pylist(), b.column("copies").to_pylist(), strict=True)):
                found = anchors(np.frombuffer(body, np.uint8), grams_of, width, gram)
                if len(found[0]):
                    parts.append((*found, np.full(len(found[0]), i), np.full(len(found[0]), min(copies, 2))))
            if parts:
                *cols, i, weight = map(np.concatenate, zip(*parts, strict=True))
                yield rows(*cols, b.column("tid").take(pa.array(i)), weight)

    def cut(band):
        def run(batches):
            grams_of = Hasher(1)
            for b in batches:
                for tid, body, xs in zip(b.column("tid").to_pylist(), b.column("body").to_pylist(), b.column("asked").to_pylist(), strict=True):
                    q, lo, hi = _places(np.asarray([x["loc"] for x in xs]))
                    entry, *cols = bands_of(np.frombuffer(body, np.uint8), grams_of, q, lo, hi, band, width)
                    weight = np.asarray([x["weight"] for x in xs])[entry]
                    for i in range(0, len(entry), 65536):
                        own = [c[i : i + 65536] for c in (*cols, weight)]
                        yield rows(*own[:-1], pa.array([tid] * len(own[0]), pa.binary()), own[-1])

        return run

    @lean
    def contexts(batches):
        for b in batches:
            held = []
            for tid, body, xs in zip(b.column("tid").to_pylist(), b.column("body").to_pylist(), b.column("asked").to_pylist(), strict=True):
                q, lo, hi = (x.tolist() for x in _places(np.asarray([x["loc"] for x in xs])))
                held.extend((tid, x["core"], *place, x["weight"], x["share"], body[place[0] : place[0] + 8], body[place[1] : place[2] + width]) for x, place in zip(xs, zip(q, lo, hi, strict=True), strict=True))
            for i in range(0, len(held), 2048):
                c = list(zip(*held[i : i + 2048], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, (pa.binary(), *[pa.int64()] * 4, pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["tid", "core", "q", "lo", "hi", "weight", "share", "prefix", "context"])

    @lean
    def compare(batches):
        for block in blocks(batches, "core", 4096):
            yield from _compared(block, width)

    def by_text(items: DataFrame) -> DataFrame:
        return texts.select("tid", "body").join(items.groupBy("tid").agg(F.collect_list(F.struct("core", "loc", "weight", "share")).alias("asked")), "tid")

    own = (F.col("core") == F.col("c")) & (F.col("fa") == F.col("a")) & (F.col("fb") == F.col("b"))
    q = F.shiftright("loc", 20)
    lo, hi = q - F.shiftright("loc", 10).bitwiseAND(1023), q - F.col("loc").bitwiseAND(1023)
    wholes, sorted_, share = [], [], gram  # share: bytes that all windows of an item share, from its anchor on
    items = texts.where(F.octet_length("body") >= width).mapInArrow(scan, _ITEMS)
    for band in (*[b for b in BANDS if b <= width - gram], None):
        # Written, so that the join below deals both sides itself and Spark can split a hot core's rows.
        shared = written(items.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select(F.col("core").alias("c")), "cores")
        held = written(items.join(shared, F.col("core") == F.col("c"), "left_semi"), "anchors")
        kinds = written(held.groupBy("core", "fa", "fb").agg(F.sum("weight").alias("weight"), F.min(F.struct("tid", "loc")).alias("one")), "contexts")
        twice = kinds.where("weight > 1").select(F.col("core").alias("c"), F.col("fa").alias("a"), F.col("fb").alias("b"))
        # Sorted, never broadcast after both sides are dealt: so Spark splits the rows of a very common context.
        wholes.append(held.where("weight = 1").join(twice.hint("merge"), own).select("tid", lo.alias("start"), (hi + width).alias("end")))
        several = written(kinds.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("core", "c"), "several")
        open_ = kinds.join(several, F.col("core") == F.col("c")).select("core", "one.tid", "one.loc", F.least("weight", F.lit(2)).cast("int").alias("weight"), F.lit(share).alias("share"), "n")
        if band is None or several.where(F.col("n") > most).isEmpty():
            sorted_.append(open_)
            break
        sorted_.append(open_.where(F.col("n") <= most))
        items = written(by_text(open_.where(F.col("n") > most)).select("tid", "body", "asked").mapInArrow(cut(band), _ITEMS), "bands")
        share = width - band + 1
    asked = sorted_[0]
    for more in sorted_[1:]:
        asked = asked.unionByName(more)
    placed = by_text(asked).mapInArrow(contexts, "tid binary, core bigint, q bigint, lo bigint, hi bigint, weight int, share int, prefix binary, context binary")
    lead = F.substring("context", (F.col("q") - F.col("lo") + 1).cast("int"), F.col("share"))
    edges = placed.repartitionByRange(lead).sortWithinPartitions("prefix", "core").mapInArrow(compare, "tid binary, start bigint, end bigint")
    spans = edges
    for whole in wholes:
        spans = spans.unionByName(whole)
    return spans.groupBy("tid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def _places(loc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    q = loc >> 20
    return q, q - (loc >> 10 & 1023), q - (loc & 1023)


def _removed(body: bytes, spans: list[dict]) -> tuple[int, int, str]:
    runs: list[list[int]] = []
    for s in sorted((x["start"], x["end"]) for x in spans):
        if runs and s[0] <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], s[1])
        else:
            runs.append(list(s))
    kept, at = [], 0
    for a, b in runs:
        kept.append(body[at:a])
        at = b
    kept.append(body[at:])
    return sum(b - a for a, b in runs), len(runs), hashlib.sha256(b"".join(kept)).hexdigest()


def distinct_texts(docs: DataFrame, text_col: str, least: int) -> DataFrame:
    """tid, body and copies of the texts of least bytes or more, bucketed by tid in the shared folder, so that later joins move no text."""
    spark = docs.sparkSession
    body = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(F.unhex(F.sha2(body, 256)).alias("tid"), body.alias("body")).where(F.octet_length("body") >= least)
    name, path = f"trawl_texts_{uuid.uuid4().hex}", fresh_path(spark, "texts")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = rows.groupBy("tid").agg(F.first("body").alias("body"), F.count("*").alias("copies"))
    note(path)
    one.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, "tid").saveAsTable(name)
    held = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # only the name goes, the files stay where they are
    return held


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept_sha256 of every row.

    Texts that occur twice or more, of width bytes or more, go whole. Nulls: a null text counts as empty. Repeated
    rows are copies of each other. Texts of any length count whole; shorter ones than width keep everything. An
    empty table gives no rows. Other columns are not read.
    """
    small_batches(docs.sparkSession, 256)
    texts = distinct_texts(docs.select(F.col(text_col).alias("text")), "text", width)
    spans = find_repeats(texts, width, gram)

    def cut(batches):
        for b in batches:
            got = [(t, *_removed(body, s)) for t, body, s in zip(b.column("tid").to_pylist(), b.column("body").to_pylist(), b.column("spans").to_pylist(), strict=True)]
            if got:
                c = list(zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.binary()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.string())], ["tid", "removed", "spans", "kept"])

    single = texts.where("copies = 1").select("tid", "body").join(spans, "tid").select("tid", "body", "spans")
    parts = single.mapInArrow(cut, "tid binary, removed bigint, spans bigint, kept string")
    nothing = hashlib.sha256(b"").hexdigest()
    full = texts.where("copies > 1").select("tid", F.octet_length("body").cast("long").alias("removed"), F.lit(1).cast("long").alias("spans"), F.lit(nothing).alias("kept"))
    results = written(parts.unionByName(full), "repeats").withColumnRenamed("tid", "t")
    body = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    own = docs.select(F.col(id_col), F.octet_length(body).cast("long").alias("n_bytes"), F.unhex(F.sha2(body, 256)).alias("tid"), F.sha2(body, 256).alias("sha"))
    joined = own.join(results, F.col("tid") == F.col("t"), "left")
    zero = F.lit(0).cast("long")
    return joined.select(id_col, "n_bytes", F.coalesce("removed", zero).alias("n_removed"), F.coalesce("spans", zero).alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256"))
