"""Token ids in binary files: each id in as few bits as the vocabulary needs.

A file: blocks of block ids each, packed at width bits, little-endian, every block from a byte boundary; then the
index: document ids (int64), whether they are null (uint8), where each document starts (int64, one more than there
are documents), the byte offset of each block (int64, one more than there are blocks); then a 40-byte trailer
(TRAILER): magic, width, ids a block, documents, ids, where the index starts. Any range of ids is read with two
reads of the index and one of the blocks that hold it, and unpacked by numpy.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.shared import in_chunks, lean, small_batches, written

MAGIC = b"PACK"
TRAILER = struct.Struct("<4sIIxxxxQQQ")


def width_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = ((ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & 1).astype(np.uint8)
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, width: int, n: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(raw, f"<u{width // 8}", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(1, dtype=np.uint32)


#: A text with a letter from here on is not lower-cased ahead: its lower case may depend on what stands around it.
_BEYOND = "[\u0130-\U0010ffff]"
#: Texts are encoded together, about so many bytes at a time.
CHUNK = 8_000_000


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def vocabulary_size(path: str) -> int:
    return _tokenizer(path).get_vocab_size(with_added_tokens=True)


def _gathered(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries that codes name, one after another, and their sizes; ids holds the entries, sizes how long each is."""
    starts, each = np.cumsum(sizes) - sizes, sizes[codes]
    ends = np.cumsum(each)
    at = np.repeat(starts[codes] - (ends - each), each) + np.arange(int(ends[-1]) if len(ends) else 0)
    return ids[at], each


def _laid(entries: list[bytes], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, entries), np.int64, len(entries)) // 4
    return _gathered(np.frombuffer(b"".join(entries), "<u4"), sizes, codes)


class WordEncoder:
    """Encodes texts word by word, each distinct word once while the cache holds it.

    That holds for tokenizers that drop white space and let no token cross it: alone says whether this one does, by
    comparison on all pairs of PROBES; texts of any other are encoded whole. Where it also folds case, texts of Latin
    letters are lower-cased first, and letters with final MARKS share the entry of the bare word, as the marks are a
    token run of their own. Lower-case ASCII words go to the tokenizer's model alone where, on trial, nothing before it
    changes them (bare). Other new words are encoded together, a separator word between them, and split where its
    token comes back. A text that holds an added token's string (which may hold white space or touch words) is encoded
    whole, and so is a word that holds the separator.
    """

    PROBES = ("a", "B", "7", ".", ",", "'s", "n't", "é", "ß", "x1", "42", "...", "#", "_", "(b)", "漢字", "İ", "word-word", "zzqx")
    MARKS = ".,:;!?%$#&*"

    def __init__(self, path: str, most: int = 400_000):
        self.tokenizer, self.most = _tokenizer(path), most
        self.model = self.tokenizer.model
        self.ids, self.old = {"": b""}, {}  # words lately used; words used before
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        codes = ((c, self.tokenizer.encode(c, add_special_tokens=False).ids) for c in "\u2665\u2605\u2714\u266b\u2600")
        self.mark, self.mark_id = next(((c, ids[0]) for c, ids in codes if len(ids) == 1), (None, None))
        one = {x: self.whole(x) for x in self.PROBES}
        seps = (" ", "  ", "\n", "\t", "\r\n", " \v", "\f")
        self.alone = all(self.whole(x + sep + y) == one[x] + one[y] for x in one for y in one for sep in seps) and all(self.whole(sep + x + sep) == one[x] for x in one for sep in seps)
        tails = (*self.MARKS, self.MARKS, ".%%%", "...")
        self.folds = self.alone and all(self.whole(f"{x}{t}") == self.whole(x.lower()) + self.whole(t) for x in ("Ab", "zzQx", "ÀÞ") for t in tails)
        letters = [chr(97 + i) + chr(97 + j) for i in range(26) for j in range(26)]
        plain = [*letters, *("".join(letters[i::97]) for i in range(97)), "internationally", "hello"]
        self.bare = self.alone and all(self.whole(w) == struct.pack(f"<{len(own)}I", *own) for w in plain for own in [[t.id for t in self.model.tokenize(w)]])

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _together(self, text: str) -> list[int]:
        fast = getattr(self.tokenizer, "encode_batch_fast", None)  # without offsets
        return (fast([text], add_special_tokens=False)[0] if fast else self.tokenizer.encode(text, add_special_tokens=False)).ids

    def _learn(self, new: list[str]) -> None:
        if self.bare:
            tokenize = self.model.tokenize
            for w in new:
                if w.isascii() and w.isalpha() and w.islower():
                    own = [t.id for t in tokenize(w)]
                    self.ids[w] = struct.pack(f"<{len(own)}I", *own)
            new = [w for w in new if w not in self.ids]
        for i in range(0, len(new), 4_000):
            part = new[i : i + 4_000]
            plain = [w for w in part if self.mark and self.mark not in w]
            if plain:
                ids = np.asarray(self._together(f" {self.mark} ".join(plain)), "<u4")
                at = np.flatnonzero(ids == self.mark_id)
                if len(at) == len(plain) - 1:
                    raw = ids.tobytes()
                    starts, ends = [0, *(4 * at + 4).tolist()], [*(4 * at).tolist(), len(raw)]
                    self.ids.update((w, raw[i:j]) for w, i, j in zip(plain, starts, ends, strict=True))
            for w in part:
                if w not in self.ids:
                    self.ids[w] = self.whole(w)

    def _entries(self, uniq: list[str]) -> list[bytes]:
        """The ids of distinct words or marks."""
        if len(self.ids) > self.most:
            self.old, self.ids = self.ids, {"": b""}
        ids, old = self.ids, self.old
        missing = [w for w in uniq if w not in ids]
        ids.update((w, old[w]) for w in missing if w in old)
        self._learn([w for w in missing if w not in ids])
        return list(map(ids.__getitem__, uniq))

    def _words(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words one after another, and how many each has."""
        if not self.folds:
            return _laid(self._entries(distinct.to_pylist()), np.arange(len(distinct)))
        core = pc.ascii_rtrim(distinct, self.MARKS)
        cut = pc.and_(pc.utf8_is_alpha(core), pc.not_equal(core, distinct))
        tail = pc.struct_field(pc.extract_regex(distinct, f"(?P<tail>[{self.MARKS}]+)$"), "tail")
        core = pc.if_else(cut, core, distinct).dictionary_encode()
        tail = pc.if_else(cut, tail, pa.scalar("", tail.type)).dictionary_encode()
        own = self._entries(core.dictionary.to_pylist()) + self._entries(tail.dictionary.to_pylist())
        codes = np.stack([core.indices.to_numpy(), tail.indices.to_numpy() + len(core.dictionary)], 1).ravel()
        ids, sizes = _laid(own, codes)
        return ids, sizes.reshape(-1, 2).sum(1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after another, and how many each has."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if not self.alone:
            each = [self.whole(t) for t in texts.to_pylist()]
            return np.frombuffer(b"".join(each), "<u4"), np.asarray([len(x) // 4 for x in each], np.int64)
        texts = texts.cast(pa.large_string())
        held = np.zeros(len(texts), bool)
        for a in self.added:
            held |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(held), pa.scalar("", pa.large_string()), texts)
        if self.folds:
            plain = pc.if_else(pc.match_substring_regex(plain, _BEYOND), plain, pc.utf8_lower(plain))
        lists = pc.ascii_split_whitespace(plain)  # at the white space of WORD; any other stays inside a word
        coded = lists.flatten().dictionary_encode()
        ids, each = _gathered(*self._words(coded.dictionary), coded.indices.to_numpy())
        before = np.concatenate([[0], np.cumsum(each)])[lists.offsets.to_numpy()]
        if held.any():
            parts = np.split(ids, before[1:-1])
            for i in np.flatnonzero(held):
                parts[i] = np.frombuffer(self.whole(texts[i].as_py()), "<u4")
            return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return ids, np.diff(before)


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class PackedWriter:
    """Writes one file; documents and ids come in order. The file appears under its name only when it is whole."""

    def __init__(self, folder: str, name: str, width: int, block: int):
        from pyarrow import fs

        self.fs, base = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(base, recursive=True)
        self.path, self.tmp = f"{base}/{name}", f"{base}/.{name}.{uuid.uuid4().hex}"
        self.out, self.width, self.block = self.fs.open_output_stream(self.tmp), width, block
        self.rest, self.held = [], 0
        self.docs, self.null, self.starts, self.offsets, self.ids = [], [], [0], [0], 0

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.add_all([doc], ids, np.asarray([len(ids)]))

    def add_all(self, docs: list[int | None], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Several documents, their ids one after another."""
        self.docs.extend(0 if d is None else d for d in docs)
        self.null.extend(d is None for d in docs)
        self.starts.extend((self.ids + np.cumsum(sizes)).tolist())
        self.ids += len(ids)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= 64 * self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        held = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32)
        cut = len(held) if last else len(held) // self.block * self.block
        for i in range(0, cut, self.block):
            raw = pack(held[i : min(i + self.block, cut)], self.width)
            self.out.write(raw)
            self.offsets.append(self.offsets[-1] + len(raw))
        self.rest, self.held = [held[cut:]], len(held) - cut

    def close(self) -> None:
        self._flush(True)
        for x, kind in ((self.docs, "<i8"), (self.null, "u1"), (self.starts, "<i8"), (self.offsets, "<i8")):
            self.out.write(np.asarray(x, kind).tobytes())
        self.out.write(TRAILER.pack(MAGIC, self.width, self.block, len(self.docs), self.ids, self.offsets[-1]))
        self.out.close()
        self.fs.move(self.tmp, self.path)


class PackedReader:
    """Random access to a file's ids."""

    def __init__(self, folder: str, name: str):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        self.file = store.open_input_file(f"{base}/{name}")
        end = self.file.size() - TRAILER.size
        magic, self.width, self.block, n, self.n_ids, at = TRAILER.unpack(self._read(end, TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{name} is not a packed file")
        index = self._read(at, end - at)
        self.docs, self.null = np.frombuffer(index, "<i8", n), np.frombuffer(index, "u1", n, 8 * n)
        self.starts = np.frombuffer(index, "<i8", n + 1, 9 * n)
        self.offsets = np.frombuffer(index, "<i8", -1, 17 * n + 8)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def ids(self, begin: int, end: int) -> np.ndarray:
        if end <= begin:
            return np.zeros(0, np.uint32)
        first, last = begin // self.block, -(-end // self.block)
        raw = self._read(int(self.offsets[first]), int(self.offsets[last] - self.offsets[first]))
        parts = []
        for b in range(first, last):
            lo, hi = int(self.offsets[b] - self.offsets[first]), int(self.offsets[b + 1] - self.offsets[first])
            parts.append(unpack(raw[lo:hi], self.width, min(self.block, self.n_ids - b * self.block)))
        held = np.concatenate(parts)
        return held[begin - first * self.block : end - first * self.block]

    def documents(self, most: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(document, start in the file, ids), reading about most ids at a time."""
        i, n = 0, len(self.docs)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + most, "right")) - 1)
            j = min(j, n)
            held = self.ids(int(self.starts[i]), int(self.starts[j]))
            for d in range(i, j):
                lo, hi = self.starts[d] - self.starts[i], self.starts[d + 1] - self.starts[i]
                yield None if self.null[d] else int(self.docs[d]), int(self.starts[d]), held[lo:hi]
            i = j


def write_packed(docs: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block: int = 65536) -> DataFrame:
    """Writes every text's ids and the end id, in ascending id order (nulls first), into files of folder; returns their manifest.

    A file holds a range of ids; files are in order of part. The manifest (part, name, n_docs, n_ids, base) has a
    row for each file; base counts the ids of all files before it. Null texts count as empty (just the end id); rows
    with the same id follow each other, in the order of their texts' hashes. An empty table gives no files. A file that a lost task had half written is
    never seen, and one that is written again has the same bytes.
    """
    from pyspark import TaskContext

    small_batches(docs.sparkSession, 256)
    width = width_of(max(vocabulary_size(path), end_id + 1))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Rows of one id are dealt on by their texts, so that an id (or null) with very many rows is many files.
    order = ["doc_id", F.xxhash64("text"), "text"]
    dealt = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)

    @lean
    def write(batches):
        part, out, encoder = TaskContext.get().partitionId(), None, _encoder(path)
        for chunk in in_chunks(batches, "text", CHUNK):
            out = out or PackedWriter(folder, f"part-{part:06d}.pack", width, block)
            ids, sizes = encoder.encode(chunk.column("text"))
            out.add_all(chunk.column("doc_id").to_pylist(), np.insert(ids, np.cumsum(sizes), np.uint32(end_id)), sizes + 1)
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [f"part-{part:06d}.pack"], "n_docs": [len(out.docs)], "n_ids": [out.ids]})

    files = written(dealt.mapInArrow(write, "part int, name string, n_docs bigint, n_ids bigint"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def read_packed(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document, from the files."""

    def read(batches):
        for b in batches:
            for f in b.to_pylist():
                held = []
                for doc, start, ids in PackedReader(folder, f["name"]).documents():
                    held.append((doc, f["base"] + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(held) == 4096:
                        yield _batch(held)
                        held = []
                if held:
                    yield _batch(held)

    files = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as many as wrote; a plain repartition would be merged into few
    return manifest.repartition(files, "part").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])
