"""Order-preserving packing: the documents' ids as one stream, cut into windows of at most `length` ids.

Where to cut is a dynamic programme over the places where a cut is cheap: the end of a document (free), of a sentence,
and, so that no stretch is without one, places inside long sentences. With f(i) the least cost of the stream up to
place c(i), f(j) = cut(j) + window + min over c(j) - length <= c(i) < c(j) of f(i) + length - (c(j) - c(i)); the part
that depends on i is f(i) + c(i), whose minimum over the moving range a monotone queue keeps. A window whose length
is a power of two needs no padding, so those few lengths are tried by themselves (not those of fewer ids than what a
window costs: one is never worth its own price).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.packing import _tokenizer
from trawl.llm.shared import in_chunks, lean, small_batches

#: The pattern of byte-level BPE tokenizers, as their file names it only by kind.
BYTE_LEVEL = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What ends a sentence, and what may stand between that and the white space after it.
STOPS, CLOSERS = ".!?…", "\"')]}»”’"
FULL_STOPS = "。！？"  # no white space after these
CHUNK = 4_000_000


@dataclass(frozen=True)
class Costs:
    """In padding ids: a cut at a sentence's end, a cut inside a sentence, any window at all."""

    sentence: int = 2
    inside: int = 8
    window: int = 64
    #: In a sentence a cut may stand after so many ids from the last place for one.
    stride: int = 32


def bytes_of_symbols() -> dict[str, int]:
    """The printable symbol that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteEncoder:
    """A byte-level BPE tokenizer's ids, by the merge loop of tiktoken where that is proved to be the same.

    It is, if ids are in the order of the merges and every token's own bytes are encoded as that token (both are checked
    for the whole vocabulary): two neighbouring tokens whose bytes together are a token's are then always the pair that
    makes it, as what stands around them has merged nothing across their ends. Texts go to the tokenizer itself if it is of another
    kind, if they hold an added token's string, or may hold a run of over 2 * BLOCK bytes with or without white space (a whole
    block of such bytes says so). That both libraries class every character alike is tested, character by character.
    """

    BLOCK = 2000

    def __init__(self, path: str):
        import json

        self.tokenizer = _tokenizer(path)
        kind = json.loads(self.tokenizer.to_str())
        model, pre = kind["model"], kind.get("pre_tokenizer") or {}
        vocab, symbols = model.get("vocab", {}), bytes_of_symbols()
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = [a for a in added if a]
        plain = {w: i for w, i in vocab.items() if w not in added}
        self.bytes = [b""] * (max(vocab.values(), default=-1) + 1)
        byte_level = model.get("type") == "BPE" and pre.get("type") == "ByteLevel"
        if byte_level:
            for w, i in plain.items():
                self.bytes[i] = bytes(symbols[c] for c in w)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
        same = (
            byte_level and pre.get("use_regex") and not pre.get("add_prefix_space") and not kind.get("normalizer") and not kind.get("truncation")
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            and [plain.get(a + b) for a, b in merges] == list(range(256, 256 + len(merges))) and len(plain) == 256 + len(merges)
            and all([t.id for t in self.tokenizer.model.tokenize(w)] == [i] for w, i in plain.items())
        )
        self.fast = None
        if same:
            import tiktoken

            self.fast = tiktoken.Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks={self.bytes[i]: i for i in plain.values()}, special_tokens={})
        text = [b.decode("utf-8", "ignore") for b in self.bytes]
        size = max(self.tokenizer.get_vocab_size(with_added_tokens=True), len(text))
        #: By id: ends a sentence if white space follows; ends one whatever follows; begins with white space.
        self.stop, self.full, self.lead = (np.zeros(size, bool) for _ in range(3))
        for i, t in enumerate(text):
            core = t.rstrip(CLOSERS)
            self.stop[i] = core[-1:] in STOPS and bool(core)
            self.full[i] = bool(core) and (core[-1] in FULL_STOPS or core[-1] == "\n")
            self.lead[i] = t[:1].isspace()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after another, and how many each has."""
        texts = texts.cast(pa.large_string())
        slow = np.full(len(texts), self.fast is None)
        if self.fast is not None:
            for a in self.special:
                slow |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
            slow |= self._long_runs(texts)
        out = []
        for t, s in zip(texts.to_pylist(), slow.tolist(), strict=True):
            out.append(np.asarray(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) if s else self.fast.encode_to_numpy(t))
        return np.concatenate(out) if out else np.zeros(0, np.uint32), np.fromiter(map(len, out), np.int64, len(out))


    def _long_runs(self, texts: pa.Array) -> np.ndarray:
        """Whether each text overlaps a block of bytes that are all white space, or none."""
        starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        held = texts.buffers()[2]
        if not len(texts) or held is None:
            return np.zeros(len(texts), bool)
        raw = np.frombuffer(held, np.uint8)[starts[0] : starts[-1]]
        n = len(raw) // self.BLOCK
        space = (raw[: n * self.BLOCK] <= 32).reshape(n, self.BLOCK)
        odd = np.flatnonzero(space.all(1) | ~space.any(1)) * self.BLOCK + starts[0]
        first = np.searchsorted(odd + self.BLOCK, starts[:-1], "right")
        return (first < len(odd)) & (odd[np.minimum(first, max(len(odd) - 1, 0))] < starts[1:]) if len(odd) else np.zeros(len(texts), bool)


@lru_cache(maxsize=1)
def _encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def places(ids: np.ndarray, ends: np.ndarray, encoder: ByteEncoder, costs: Costs) -> tuple[np.ndarray, np.ndarray]:
    """Where a cut may stand, ascending, and what it costs. ends: the documents' ends."""
    n = len(ids)
    after = np.concatenate([ids[1:], ids[:1]]) if n else ids
    cost = np.full(n + 1, -1, np.int32)
    cost[1:][encoder.full[ids] | encoder.stop[ids] & encoder.lead[after]] = costs.sentence
    cost[ends] = 0
    cost[0] = cost[n] = 0
    at = np.flatnonzero(cost >= 0)
    gaps = np.diff(at)
    wide = np.flatnonzero(gaps > costs.stride)
    if len(wide):
        each = (gaps[wide] - 1) // costs.stride
        first = np.repeat(at[wide], each)
        more = first + costs.stride * (np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each) + 1)
        cost[more] = costs.inside
        at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def cheapest(at: np.ndarray, cut: np.ndarray, length: int, window: int) -> list[int]:
    """The places (as indices of at) of the cheapest cuts, the first and last place among them."""
    m = len(at)
    extra: dict[int, list[int]] = {}
    k = 1 << max(0, window - 1).bit_length()
    while k <= length:
        i = np.searchsorted(at, at - k)
        for j in np.flatnonzero((at >= k) & (at[np.minimum(i, m - 1)] == at - k)).tolist():
            extra.setdefault(j, []).append(int(i[j]))
        k *= 2
    c, cost = at.tolist(), cut.tolist()
    f, back = [0] * m, [0] * m
    values, which, head = [c[0]], [0], 0  # the queue: f + c, ascending from head on, and of which place
    for j in range(1, m):
        here = c[j]
        low = here - length
        while c[which[head]] < low:
            head += 1
        best, i = values[head] - low, which[head]
        if j in extra:
            for x in extra[j]:
                if f[x] < best:
                    best, i = f[x], x
        best += cost[j] + window
        f[j], back[j] = best, i
        best += here
        while len(values) > head and values[-1] >= best:
            values.pop()
            which.pop()
        values.append(best)
        which.append(j)
    out, j = [m - 1], m - 1
    while j:
        j = back[j]
        out.append(j)
    return out[::-1]


def pack_stream(chunks: Iterator[tuple[list, np.ndarray, np.ndarray]], encoder: ByteEncoder, length: int, costs: Costs) -> Iterator[tuple]:
    """(names, totals, document of each piece, start, bounds, window, offset, ids) over (names, ids, sizes) of whole documents in order.

    The programme runs over what is held, and what it cuts off well before the end of that is final; the rest is
    looked at again with the documents that follow, so memory is that of a chunk and the cuts cost little more than those
    of the whole.
    """
    names, totals, ids, ends, given, windows = [], np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64), 0, 0
    pending = next(chunks, None)
    while pending is not None:
        more, new, sizes = pending
        ends = np.concatenate([ends, len(ids) + np.cumsum(sizes)])
        names, totals, ids = [*names, *more], np.concatenate([totals, sizes]), np.concatenate([ids, new])
        pending = next(chunks, None)
        if not len(ids):
            continue
        at, cost = places(ids, ends, encoder, costs)
        cuts = at[cheapest(at, cost, length, costs.window)]
        if pending is not None:
            final = int(np.searchsorted(cuts, max(0, len(ids) - 32 * length), "right"))
            cuts = cuts[: max(1, final)]
        last = int(cuts[-1])
        if not last:
            continue
        bounds = np.union1d(cuts, ends[ends <= last])
        begin = bounds[:-1]
        doc, window = np.searchsorted(ends, begin, "right"), np.searchsorted(cuts, begin, "right") - 1
        start = begin - np.where(doc > 0, ends[doc - 1], -given)
        yield names, totals, doc, start, bounds, windows + window, begin - cuts[window], ids[:last]
        windows += len(cuts) - 1
        done = int(np.searchsorted(ends, last, "right"))
        given = last - (int(ends[done - 1]) if done else -given)
        names, totals, ids, ends = names[done:], totals[done:], ids[last:], ends[done:] - last


SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack_documents(docs: DataFrame, path: str, end_id: int, length: int = 1024, costs: Costs | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Documents follow each other in ascending id order. A sequence is a run of pieces, offset where each begins in it;
    sequences and pieces keep the order of the stream, and sequence_id is the partition's number times 2 ** 33 plus a
    count. A sequence of under length ids is to be padded, unless its size is a power of two. Only each partition's
    last sequence may be short for want of documents.

    Nulls: a null id comes first, a null text counts as empty; an empty text is one piece, the end id. Rows with the
    same id follow each other in the order of their texts' hashes, each a document of its own. A very long text is
    encoded as a whole and cut into many pieces. An empty table gives no rows. Other columns are not read.
    """
    from pyspark import TaskContext

    if length < 1:
        raise ValueError("a sequence holds an id at least")
    costs = costs or Costs()
    costs = Costs(costs.sentence, costs.inside, costs.window, max(1, min(costs.stride, length)))
    small_batches(docs.sparkSession, 256)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text"), "text"]
    dealt = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)

    @lean
    def pack(batches):
        encoder, base = _encoder(path), TaskContext.get().partitionId() << 33

        def coded():
            for chunk in in_chunks(batches, "text", CHUNK):
                ids, sizes = encoder.encode(chunk.column("text"))
                yield chunk.column("doc_id").to_pylist(), np.insert(ids, np.cumsum(sizes), np.uint32(end_id)), sizes + 1

        for names, totals, doc, start, bounds, window, offset, ids in pack_stream(coded(), encoder, length, costs):
            raw = pa.py_buffer(ids.astype("<u4").tobytes())
            binary = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer((4 * bounds).astype(np.int32).tobytes()), raw])
            columns = [pa.array(names, pa.int64()).take(pa.array(doc)), pa.array(start), pa.array(np.diff(bounds)), binary, pa.array(totals[doc]), pa.array(base + window), pa.array(offset)]
            batch = pa.RecordBatch.from_arrays([c if c.type != pa.int32() else c.cast(pa.int64()) for c in columns], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            for i in range(0, batch.num_rows, 4096):
                yield batch.slice(i, 4096)

    return dealt.mapInArrow(pack, SCHEMA)


def piece_digest(pieces: DataFrame) -> DataFrame:
    """pieces with ids_crc32 (unsigned) in the place of ids. Null ids give null."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def padding(pieces: DataFrame, length: int = 1024) -> DataFrame:
    """sequences, ids, padded (ids of padding), cut (documents in more than one piece than their length needs)."""
    size = F.sum("length").alias("size")
    each = pieces.groupBy("sequence_id").agg(size)
    two = (F.col("size").bitwiseAND(F.col("size") - 1)) == 0
    return each.agg(F.count(F.lit(1)).alias("sequences"), F.sum("size").alias("ids"), F.sum(F.when(two, 0).otherwise(length - F.col("size"))).alias("padded"))
