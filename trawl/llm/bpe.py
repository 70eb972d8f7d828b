"""Byte-level BPE: whole texts to token ids and back.

A text of up to chunk characters is encoded as it stands. A longer one is cut into chunks that overlap by overlap
characters; chunks are pre-tokenised in parallel, each from its own first character. Two neighbours are stitched at
the first pre-token boundary that both found in their overlap: from there on the pattern sees the same characters,
so the boundaries agree for good. Where none agrees (a run without boundaries), the text is scanned on from the last
sure boundary. The pieces between stitches are then encoded in parallel. Decoding concatenates the ids' raw bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.shared import lean, small_batches

#: A match that ends so many characters before a cut cannot have been shaped by the cut.
MARGIN = 16


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    return [ranks.get(i, b"") for i in range(max(ranks) + 1)]


@lru_cache(maxsize=4)
def _compiled(pattern: str):
    import regex

    return regex.compile(pattern)


def boundaries(text: str, pattern: str, last: bool) -> list[int]:
    """Ends of the pre-tokens that more text to the right could not move."""
    ends = [m.end() for m in _compiled(pattern).finditer(text)]
    return ends if last else [e for e in ends if e <= len(text) - MARGIN]


def stitch(chunks: Iterator[tuple[int, str, list[int]]], pattern: str) -> Iterator[str]:
    """(start, text, ends within the text) of a document's chunks, in order, to pieces that encode alone as in the whole.

    A run without boundaries is scanned again only when it has doubled, so all scans of a text together are linear.
    """
    start, text, ends = next(chunks)
    tail: list[str] = []  # what has come since the last scan
    size = scanned = len(text)
    begin = 0  # in text: the piece's first character, a sure boundary
    for at, more, found in chunks:
        off = at - start
        if not tail:
            own = {0, *found}
            p = next((e for e in ends if e >= off and e - off in own and not text[e - 1].isspace()), None)
            if p is not None:
                yield text[begin:p]
                start, text, ends, begin = at, more, [e for e in found if e > p - off], p - off
                size = scanned = len(text)
                continue
            sure = next((e for e in reversed(ends) if e > begin and e <= off + len(more) and not text[e - 1].isspace()), begin)
            if sure > begin:
                yield text[begin:sure]
                scanned = 0  # what stays is new to the scanner
            start, text, begin = start + sure, text[sure:], 0
            size, off = len(text), off - sure
        held = more[size - off :]
        tail.append(held)
        size += len(held)
        if size >= 2 * scanned:
            text, tail, scanned = "".join([text, *tail]), [], size
            ends = boundaries(text, pattern, False)
    rest = "".join([text[begin:], *tail])
    if rest:
        yield rest


def _runs(batches, keys: list[str]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Rows of sorted batches, by runs of equal keys, as they stream in."""
    from itertools import groupby

    rows = (r for b in batches for r in b.to_pylist())
    return groupby(rows, key=lambda r: tuple(r[k] for k in keys))


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = 32768, overlap: int = 512) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of each row of docs.

    Nulls: a null text counts as empty and has no ids; a null id stays null. Repeated rows each get a row. Texts of
    any length are encoded whole. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    long = F.length("text") > chunk
    out = pa.schema([("ids", pa.binary())])

    @lean
    def encode(batches):
        enc = encoding(path, pattern)
        for b in batches:
            ids = [np.asarray(enc.encode_ordinary(t), dtype="<u4").tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "text"), pa.array(ids, out.field("ids").type)], [*(c for c in b.schema.names if c != "text"), "ids"])

    def cut(batches):
        for b in batches:
            for doc, h, text in zip(b.column("doc_id"), b.column("h"), b.column("text").to_pylist(), strict=True):
                n = -(-len(text) // chunk)
                for k in range(n):
                    yield pa.RecordBatch.from_arrays([pa.array([doc], b.schema.field("doc_id").type), pa.array([h], pa.int64()), pa.array([k], pa.int32()), pa.array([k == n - 1], pa.bool_()), pa.array([text[k * chunk : (k + 1) * chunk + overlap]], pa.string())], ["doc_id", "h", "k", "last", "text"])

    @lean
    def pretokenise(batches):
        for b in batches:
            ends = [np.asarray(boundaries(t, pattern, z), dtype="<i4").tobytes() for t, z in zip(b.column("text").to_pylist(), b.column("last").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends, pa.binary())], [*b.schema.names, "ends"])

    @lean
    def stitched(batches):
        doc_type = None

        def seen(b):
            nonlocal doc_type
            doc_type = b.schema.field("doc_id").type
            return b

        for (doc, h), run in _runs(map(seen, batches), ["doc_id", "h"]):
            copies = 0

            def unique(run=run):
                nonlocal copies
                before = None
                for r in run:
                    copies += r["k"] == 0
                    if r["k"] != before:
                        before = r["k"]
                        yield before * chunk, r["text"], np.frombuffer(r["ends"], "<i4").tolist()

            for k, piece in enumerate(stitch(unique(), pattern)):
                yield pa.RecordBatch.from_arrays([pa.array([doc], doc_type), pa.array([h], pa.int64()), pa.array([k], pa.int32()), pa.array([copies], pa.int32()), pa.array([piece], pa.string())], ["doc_id", "h", "k", "copies", "text"])

    def joined(batches):
        doc_type = None

        def seen(b):
            nonlocal doc_type
            doc_type = b.schema.field("doc_id").type
            return b

        for (doc, _), run in _runs(map(seen, batches), ["doc_id", "h"]):
            parts, copies = [], 1
            for r in run:
                copies = max(copies, r["copies"])
                parts.append(r["ids"])
            ids = b"".join(parts)
            for _ in range(copies):
                yield pa.RecordBatch.from_arrays([pa.array([doc], doc_type), pa.array([ids], pa.binary())], ["doc_id", "ids"])

    short = rows.where(~long).mapInArrow(encode, f"doc_id {kind}, ids binary")
    key = ["doc_id", "h"]
    chunks = rows.where(long).withColumn("h", F.xxhash64("text")).mapInArrow(cut, f"doc_id {kind}, h bigint, k int, last boolean, text string")
    found = chunks.repartition("doc_id", "h", "k").mapInArrow(pretokenise, f"doc_id {kind}, h bigint, k int, last boolean, text string, ends binary")
    pieces = found.repartition(*key).sortWithinPartitions(*key, "k").mapInArrow(stitched, f"doc_id {kind}, h bigint, k int, copies int, text string")
    coded = pieces.repartition("doc_id", "h", "k").mapInArrow(encode, f"doc_id {kind}, h bigint, k int, copies int, ids binary")
    return short.unionByName(coded.repartition(*key).sortWithinPartitions(*key, "k").mapInArrow(joined, f"doc_id {kind}, ids binary"))


def decode_ids(coded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """Adds decoded (binary): the raw bytes of each id, one after another."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in coded.schema)

    @lean
    def decode(batches):
        get = token_bytes(path).__getitem__
        for b in batches:
            raw = [b"".join(map(get, np.frombuffer(x, "<u4").tolist())) if x else b"" for x in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(raw, pa.binary())], [*b.schema.names, "decoded"])

    return coded.mapInArrow(decode, f"{kinds}, decoded binary")


def digests(coded: DataFrame) -> DataFrame:
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
