"""Window packing: the encoder against the library, the programme against brute force, pieces against their documents."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from trawl.llm import windows  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, ids string, start int, sequence_id string"


@pytest.fixture(scope="module")
def encoder():
    return windows.ByteEncoder(PATH)


def plain(encoder, text):
    return encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_vocabulary_is_proved(encoder):
    assert encoder.fast is not None
    assert windows.ByteEncoder(public_tokenizers.path("word_bpe_49k.json")).fast is None


def test_every_character_is_classed_alike(encoder):
    for begin in range(0, 0x110000, 4096):
        text = "".join(f"a{c}1{c}.{c} {c}{c}\n" for c in map(chr, range(begin, begin + 4096)) if not "\ud800" <= c <= "\udfff")
        if text:
            assert encoder.fast.encode_ordinary(text) == plain(encoder, text)


def test_encoder_equals_library(encoder):
    r = random.Random(5)
    letters = ["a", "b", "the", " ", "  ", "\n", "\t", "'s", "é", "漢", "1", "!", ".", " ", "　", "it's", "́", "😀"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(400)]
    texts += ["", "<|endoftext|>", "a<|endoftext|>b", "x" * 9000, " " * 9000 + "y", "ab" * 3000 + "\n" * 5000, "word " * 3000, "漢字" * 1500, "a b " * 700 + "y" * 5000, " " * 2100, "x\n" * 20 + "\t" * 4100 + "z"]
    ids, sizes = encoder.encode(pa.array(texts))
    ends = np.cumsum(sizes)
    for t, a, z in zip(texts, ends - sizes, ends, strict=True):
        assert ids[a:z].tolist() == plain(encoder, t)


def test_cheapest_equals_brute_force():
    r = random.Random(2)
    for _ in range(150):
        n, length = r.randint(1, 60), r.choice([1, 2, 5, 8, 16])
        at = sorted({0, n, *(i for i in range(n) if r.random() < 0.7), *range(0, n, max(1, length))})
        cost = [0] + [r.choice([0, 2, 8]) for _ in at[1:]]
        free = lambda s: s & (s - 1) == 0 and s >= 4  # noqa: E731  smaller ones cost more than they hold
        best = {0: 0}
        for j in range(1, len(at)):
            sizes = [(i, at[j] - at[i]) for i in range(j) if at[j] - at[i] <= length]
            best[j] = min(best[i] + (0 if free(s) else length - s) for i, s in sizes) + cost[j] + 3
        cuts = windows.cheapest(np.array(at), np.array(cost), length, 3)
        spent = sum((0 if free(s := at[b] - at[a]) else length - s) + cost[b] + 3 for a, b in zip(cuts, cuts[1:], strict=False))
        assert cuts[0] == 0 and cuts[-1] == len(at) - 1 and all(0 < at[b] - at[a] <= length for a, b in zip(cuts, cuts[1:], strict=False))
        assert spent == best[len(at) - 1]


def check(spark, rows, encoder, length=1024, **more):
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)
    got = windows.pack_documents(df, PATH, 0, length, **more).toPandas()
    want = sorted((i, zlib.crc32(np.asarray([*plain(encoder, t or ""), 0], "<u4").tobytes()), len(plain(encoder, t or "")) + 1) for i, t in rows if i is not None)
    seen, held = [], b""
    got = got.sort_values(["sequence_id", "offset"])
    for _, g in got.groupby("sequence_id"):
        assert g.length.sum() <= length and (g.offset == g.length.cumsum() - g.length).all()
    for p in got.itertuples():
        assert len(p.ids) == 4 * p.length > 0 and p.start == len(held) // 4
        held += p.ids
        if p.start + p.length == p.doc_tokens:
            if p.doc_id == p.doc_id and p.doc_id is not None:
                seen.append((p.doc_id, zlib.crc32(held), p.doc_tokens))
            held = b""
    assert not held and sorted(seen) == want
    return got


def test_pieces_are_the_documents(spark, encoder):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(1, 8)))
    text = lambda n: " ".join(word() + r.choice(["", "", "", ".", "!", ".\n"]) for _ in range(n))
    rows = [(i, text(r.choice([0, 1, 30, 400, 3000]))) for i in range(120)]
    got = check(spark, rows, encoder)
    size = got.groupby("sequence_id").length.sum()
    assert np.where(size & (size - 1) == 0, 0, 1024 - size).sum() < 0.03 * size.sum()
    check(spark, rows[:20], encoder, length=7)
    check(spark, rows[:6], encoder, length=1)


def test_nulls_long_texts_repeats_and_no_rows(spark, encoder):
    rows = [(1, None), (1, None), (2, ""), (3, "same text"), (3, "same text"), (3, "other"), (None, "null id"), (4, "A sentence of some words. " * 50_000), (5, "z" * 300_000)]
    got = check(spark, rows, encoder)
    assert got[got.doc_id == 1].length.tolist() == [1, 1] and got.doc_id.isna().sum() == 1
    assert windows.pack_documents(spark.createDataFrame([], SCHEMA), PATH, 0).count() == 0


def test_memory_is_a_chunk(encoder, monkeypatch):
    """Cuts of a stream that comes in chunks cost at most a twentieth more than those of the whole, even in chunks of a few windows."""
    r = random.Random(4)
    texts = [" ".join("word" + r.choice(["", ".", "", ""]) for _ in range(r.randint(1, 900))) for _ in range(200)]
    ids, sizes = encoder.encode(pa.array(texts))
    ends, costs = np.cumsum(sizes), windows.Costs()

    def stream(step):
        for i in range(0, len(texts), step):
            a = ends[i - 1] if i else 0
            z = ends[min(i + step, len(texts)) - 1]
            yield list(range(i, min(i + step, len(texts)))), ids[a:z], sizes[i : i + step]

    spent, cost = [], np.full(len(ids) + 1, costs.inside)
    at, each = windows.places(ids, ends, encoder, costs)
    cost[at] = each
    for step in (5, 50, 200):
        sizes_, cuts, total = [], [], 0
        for *_, bounds, window, _, out in windows.pack_stream(stream(step), encoder, 1024, costs):
            last = np.append(np.flatnonzero(np.diff(window)) + 1, len(window))
            cuts += (total + bounds[last]).tolist()
            total += len(out)
        sizes_ = np.diff([0, *cuts])
        assert total == len(ids) == cuts[-1]
        spent.append((np.where((sizes_ & (sizes_ - 1) == 0) & (sizes_ >= 64), 0, 1024 - sizes_) + costs.window).sum() + cost[cuts].sum())
    assert spent[2] == min(spent) and max(spent) <= 1.05 * spent[2]
