"""Quality rules: base counts, and how well public vocabularies fit a text (tokeniser fertility).

Measured on whole texts, word by word: characters per token under a piece vocabulary with byte fallback and under a
byte-level vocabulary, the share of byte-fallback tokens, and the entropy of the document's tokens. Each language
(where unknown: the script) and length class gets rejection bands from all of its documents: median and quartile
range, so that junk in a corpus hardly moves them. Thin classes take the bands of wider ones.
"""

from __future__ import annotations

import re
import struct
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.shared import boxed, carried, in_chunks, lean, small_batches, unboxed, written

#: Fixed values of the contract.
SYMBOLS, WINDOW, LEAST_WORDS, MOST_REPEAT = "#*$%&|<>", 5, 10, 20
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
METRICS = ("piece_chars", "byte_chars", "fallback", "entropy")
#: Width of the bands, chosen on labelled rows (README).
Z = 4.0
#: So many classes at most are sent to the documents; more are joined by a shuffle, with the same verdicts.
MOST_SENT = 100_000
#: Texts are measured together, about so many bytes at a time.
CHARS = 3_000_000
#: The last step of a metric in the counts that limits come from.
MOST_BIN = 30_000


def repeat_words(codes: np.ndarray, doc: np.ndarray, n_docs: int, window: int = WINDOW) -> np.ndarray:
    """For each document, its words in windows of equal codes found twice or more in it."""
    n = len(codes) - window + 1
    if n <= 0:
        return np.zeros(n_docs, np.int64)
    key = codes[:n].astype(np.int64)
    for k in range(1, window):  # exact: a pair of ranks is ranked again, so keys stay small
        key = pd.factorize(key * (int(codes.max()) + 1) + codes[k : n + k])[0]
    inside = np.flatnonzero(doc[:n] == doc[window - 1 :])
    group, _ = pd.factorize(key[inside] * n_docs + doc[inside])
    again = inside[np.bincount(group)[group] >= 2] if len(group) else inside
    cover = np.zeros(len(codes) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + window, -1)
    return np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=n_docs)


@lru_cache(maxsize=1 << 16)
def _script(letter: str) -> str | None:
    return {"CJK": "han"}.get(own := unicodedata.name(letter, "other").split()[0].split("-")[0], own.lower()) if letter.isalpha() else None


def script_of(text: str) -> str:
    """The script of most letters (ties: the first name), by the first word of their Unicode names; none without letters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") if not text.isascii() else None
    if codes is None:
        return "latin" if re.search("[A-Za-z]", text) else "none"
    low = codes[codes < 128] | 32
    count = {"latin": int(((low >= 97) & (low <= 122)).sum())}
    for c, n in zip(*np.unique(codes[codes >= 128], return_counts=True), strict=True):
        if name := _script(chr(c)):
            count[name] = count.get(name, 0) + int(n)
    best = min(count, key=lambda k: (-count[k], k))
    return best if count[best] else "none"


@lru_cache(maxsize=2)
def _vocabularies(piece_path: str, byte_path: str, pattern: str):
    import sentencepiece

    from trawl.llm.bpe import encoding

    piece = sentencepiece.SentencePieceProcessor(model_file=piece_path)
    return piece, encoding(byte_path, pattern), np.asarray([piece.is_byte(i) for i in range(piece.get_piece_size())])


class Fertility:
    """Token counts of words; each distinct word is encoded once while the cache holds it."""

    def __init__(self, piece_path: str, byte_path: str, pattern: str, most: int = 200_000):
        self.piece, self.byte, self.is_byte = _vocabularies(piece_path, byte_path, pattern)
        self.most, self.known = most, {}  # of a word: how many byte-level tokens, and its piece ids

    def tables(self, uniq: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Piece ids of the words one after another, how many each has, and how many byte-level tokens."""
        known = self.known
        if len(known) > self.most:
            known.clear()
        new = [w for w in uniq if w not in known]
        byte_ids = self.byte.encode_ordinary
        for i in range(0, len(new), 10_000):
            part = new[i : i + 10_000]
            for w, ids in zip(part, self.piece.encode(part, num_threads=1), strict=True):
                known[w] = struct.pack(f"={len(ids) + 1}i", len(byte_ids(" " + w)), *ids)
        own = list(map(known.__getitem__, uniq))
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
        flat = np.frombuffer(b"".join(own), np.int32)
        first = np.cumsum(sizes) - sizes
        inside = np.ones(len(flat), bool)
        inside[first] = False
        return flat[inside], sizes - 1, flat[first].astype(np.int64)


def measure(texts: list[str], fertility: Fertility) -> dict[str, np.ndarray]:
    """BASE and METRICS of each text; metrics are nan where a text has no word."""
    n = len(texts)
    lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))  # at the white space of WORD
    coded = lists.flatten().dictionary_encode()
    word = np.asarray(pc.binary_length(coded.dictionary).to_numpy() > 0)[coded.indices.to_numpy()]  # white space at an end leaves an empty string
    codes = coded.indices.to_numpy()[word].astype(np.int64)
    count = np.diff(np.concatenate([[0], np.cumsum(word)])[lists.offsets.to_numpy()]) if n else np.zeros(0, np.int64)
    out = {"n_words": count, "n_symbols": np.asarray([sum(map(t.count, SYMBOLS)) for t in texts], np.int64)}
    lines = [[x for x in t.split("\n") if x.strip(" \t\n\v\f\r")] if "\n" in t else [] for t in texts]
    out["n_dup_lines"] = np.asarray([len(x) - len(set(x)) for x in lines], np.int64)
    if not len(codes):
        zero = np.zeros(n, np.int64)
        return out | {"word_chars": zero, "n_repeat_words": zero} | {m: np.full(n, np.nan) for m in METRICS} | {"n_tokens": zero}
    doc = np.repeat(np.arange(n), count)
    total = lambda x: np.bincount(doc, weights=x[codes], minlength=n)
    chars = total(pc.utf8_length(coded.dictionary).to_numpy())
    out["word_chars"] = chars.astype(np.int64)
    out["n_repeat_words"] = repeat_words(codes, doc, n)
    ids, sizes, n_byte = fertility.tables(coded.dictionary.to_pylist())
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    each = sizes[codes]
    at = np.repeat(starts[codes] - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(int(each.sum()))
    tokens, token_doc = ids[at], np.repeat(doc, each)
    n_tokens = np.bincount(token_doc, minlength=n)
    pairs, c = np.unique(token_doc * np.int64(len(fertility.is_byte)) + tokens, return_counts=True)
    spread = np.bincount(pairs // len(fertility.is_byte), weights=c * np.log2(c), minlength=n)
    with np.errstate(divide="ignore", invalid="ignore"):
        out |= {
            "n_tokens": n_tokens,
            "piece_chars": chars / n_tokens,
            "byte_chars": chars / total(n_byte),
            "fallback": np.bincount(token_doc, weights=fertility.is_byte[tokens], minlength=n) / n_tokens,
            "entropy": np.log2(n_tokens) - spread / n_tokens,
        }
    return out


def measured(docs: DataFrame, vocabularies: tuple[str, str, str], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The keep columns of docs, BASE (long), n_tokens (long), METRICS (double, null without words) and __script__."""
    small_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    names = [*BASE, "n_tokens", *METRICS]

    @lean
    def run(batches):
        fertility = Fertility(*vocabularies)
        for b in in_chunks(batches, "__text__", CHARS):
            texts = [t or "" for t in b.column("__text__").to_pylist()]
            m = measure(texts, fertility)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(m[x], pa.int64()) for x in names[:6]), *(pa.array(m[x], pa.float64(), from_pandas=True) for x in METRICS), pa.array(map(script_of, texts), pa.string())], [*keep, *names, "__script__"])

    doubles = ", ".join(f"{m} double" for m in METRICS)
    return docs.select(*keep, F.col(text_col).alias("__text__")).mapInArrow(run, f"{kinds}, {', '.join(f'{x} bigint' for x in names[:6])}, {doubles}, __script__ string")


def cells(metrics: DataFrame) -> DataFrame:
    """How many rows of each class have each value of each metric, in steps of a thousandth: _m (place in METRICS), _bin, _n.

    Counts of whole numbers, so limits do not depend on how rows are partitioned; steps end at MOST_BIN.
    """
    step = lambda m: F.least(F.round(F.col(m) * 1000).cast("int"), F.lit(MOST_BIN))
    each = F.posexplode(F.array(*map(step, METRICS))).alias("_m", "_bin")
    return metrics.select("__group__", "__script__", "__length__", each).groupBy("__group__", "__script__", "__length__", "_m", "_bin").agg(F.count("*").alias("_n"))


def bands(counted: DataFrame, keys: list[str], z: float, least: int) -> DataFrame:
    """keys, and a struct of lower and upper limit of each metric from all rows of a group; groups of under least rows have none."""
    own = [*keys, "_m"]
    summed = counted.groupBy(*own, "_bin").agg(F.sum("_n").alias("_n"))  # at most MOST_BIN rows of a group and metric
    inside = Window.partitionBy(*own)
    seen = summed.withColumn("_seen", F.sum("_n").over(inside.orderBy("_bin"))).withColumn("_all", F.sum("_n").over(inside))
    quartiles = [F.min(F.when(4 * F.col("_seen") >= k * F.col("_all"), F.col("_bin"))).alias(f"_q{k}") for k in (1, 2, 3)]
    found = seen.groupBy(*own).agg(F.max("_all").alias("_all"), *quartiles).where(F.col("_all") >= least)
    spread = F.greatest((F.col("_q3") - F.col("_q1")) / 1000 / 1.349, F.lit(0.005))
    limit = F.struct((F.col("_q2") / 1000 - z * spread).alias("low"), (F.col("_q2") / 1000 + z * spread).alias("high"))
    return found.groupBy(*keys).agg(*(F.max(F.when(F.col("_m") == i, limit)).alias(m) for i, m in enumerate(METRICS)))


def _sent(small: DataFrame) -> DataFrame:
    return F.broadcast(small) if small.count() <= MOST_SENT else small


def class_limits(metrics: DataFrame, z: float, least: int = 30) -> DataFrame:
    """Limits of every class (__group__, __script__, __length__) that has rows with words, so that each gets a verdict.

    A class of a language and length with least rows has bands of its own. In a thinner one the metrics that depend on
    the language (characters per token, byte fallback) take the band of the language, else of the script, else of the
    corpus; entropy, which grows with the length, takes that of the length, else of the corpus.
    """
    has = metrics.where(F.col("n_tokens") > 0).select("__group__", "__script__", "__length__", *METRICS)
    counted = written(cells(has), "cells")
    out = counted.select("__group__", "__script__", "__length__").distinct()
    tiers = {"own": ["__group__", "__length__"], "group": ["__group__"], "script": ["__script__"], "length": ["__length__"], "all": []}
    for tier, keys in tiers.items():
        found = bands(counted, keys, z, least if keys else 1).withColumnsRenamed({m: f"{m}_{tier}" for m in METRICS})
        found = _sent(written(found, "bands"))
        out = out.join(found, keys, "left") if keys else out.crossJoin(found)
    order = {m: ("own", "length", "all") if m == "entropy" else ("own", "group", "script", "all") for m in METRICS}
    limits = [F.coalesce(*(F.col(f"{m}_{tier}")[side] for tier in order[m])).alias(f"{m}_{side}") for m in METRICS for side in ("low", "high")]
    return out.select(F.col("__group__").alias("_g"), F.col("__script__").alias("_s"), F.col("__length__").alias("_l"), *limits)


def judge_quality(docs: DataFrame, vocabularies: tuple[str, str, str], text_col: str = "text", lang_col: str | None = "lang", keep: list[str] | None = None, z: float = Z) -> DataFrame:
    """The keep columns of docs, BASE, METRICS, base_failed and kept.

    base_failed: under 10 words, or over a fifth of the words in repeated 5-word windows. kept: not base_failed, and
    inside the bands: characters per token between both limits under either vocabulary, byte fallback under its
    upper, entropy over its lower one. Bands are z standard deviations (by quartiles) wide and hold for a language
    (null, or no lang_col: for the script of most letters) and a length class (powers of two of tokens); classes of
    under 30 rows take wider bands (class_limits), so every document with words gets a verdict.
    Nulls: a null text counts as empty, fails the base and is not kept. Repeated rows are judged alike. Texts of any
    length count whole. An empty table gives no rows. Columns of any name are carried, but for those of the results.
    """
    keep = carried(docs, keep, (*BASE, *METRICS, "base_failed", "kept"))
    columns, inner = boxed(docs, keep)
    group = F.lit(None).cast("string") if lang_col is None else docs[f"`{lang_col}`"].cast("string")
    own = docs.select(*columns, docs[f"`{text_col}`"].alias("text_in"), group.alias("__group__"))
    held = measured(own, vocabularies, "text_in", [*inner, "__group__"]).withColumn("__length__", F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))).cast("int"))
    held = held.withColumn("__group__", F.coalesce("__group__", F.concat(F.lit("script "), "__script__")))
    held = written(held, "quality")
    limits = _sent(written(class_limits(held, z), "limits"))
    judged = held.join(limits, (F.col("__group__") == F.col("_g")) & (F.col("__script__") == F.col("_s")) & (F.col("__length__") == F.col("_l")), "left")
    outside = F.lit(False)
    for m, low, high in (("piece_chars", True, True), ("byte_chars", True, True), ("fallback", False, True), ("entropy", True, False)):
        if low:
            outside = outside | F.coalesce(F.col(m) < F.col(f"{m}_low"), F.lit(False))
        if high:
            outside = outside | F.coalesce(F.col(m) > F.col(f"{m}_high"), F.lit(False))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT * F.col("n_words"))
    out = [*BASE, *METRICS, "base_failed", "kept"]
    return unboxed(judged.select(*inner, *BASE, *METRICS, failed.alias("base_failed"), (~failed & ~outside).alias("kept")), keep, out)
