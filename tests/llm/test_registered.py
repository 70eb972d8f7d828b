"""Every registered query of the training-data operators on a whole small table, against brute force."""

from __future__ import annotations

import hashlib
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from test_operators import WORD, brute_quality, brute_repeats, brute_secrets  # noqa: E402
from trawl.llm import mixing, quality, queries, sharding, simhash  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def table():
    return lambda name: pd.read_parquet(f"{DATA}/{name}.parquet")


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: queries.queries()[name](spark, DATA).toPandas()


def by_id(frame):
    return {r.doc_id: r for r in frame.itertuples()}


def test_op1(run, table):
    docs, got = table("documents"), by_id(run("op1_sharding"))
    tree = sharding.regular_tree(8)
    grown = sharding.with_shard(tree)
    assert len(got) == len(docs)
    for r in docs.itertuples():
        raw, g = (r.text or "").encode(), got[r.doc_id]
        assert (g.size, g.text_crc32, g.law, g.shard, g.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "key", sharding.brute_shard(r.doc_id, tree), sharding.brute_shard(r.doc_id, grown))
        assert g.grown_shard in (g.shard, 8)
    slots = defaultdict(list)
    for g in got.values():
        slots[g.shard].append(g.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op2_and_op3(run, table):
    from tokenizers import Tokenizer

    from trawl.llm import bpe

    docs, two, three = table("documents"), by_id(run("op2_byte_bpe")), by_id(run("op3_token_packing"))
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    tk, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    for r in docs.sort_values("doc_id").itertuples():
        text = r.text or ""
        ids = np.asarray(enc.encode_ordinary(text), "<u4")
        g = two[r.doc_id]
        assert (g.n_tokens, g.ids_sha256, g.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        ids = np.asarray([*tk.encode(text, add_special_tokens=False).ids, 2], "<u4")
        g = three[r.doc_id]
        assert (g.start, g.n_tokens, g.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(two) == len(three) == len(docs)


def test_op4(run, table):
    e, got = table("embeddings"), run("op4_nearest")
    x = np.stack(e.embedding).astype(float)
    hit = n = 0
    for q, rows in got.groupby("query_id"):
        score = x @ x[np.flatnonzero(e.vec_id == q)[0]]
        want = sorted((-s, v) for s, v in zip(score, e.vec_id) if v != q)[:20]
        rows = rows.sort_values("rank")
        assert list(rows["rank"]) == list(range(1, len(rows) + 1)) and len(rows) == len(want)
        assert np.allclose(rows.score, [score[np.flatnonzero(e.vec_id == v)[0]] for v in rows.vec_id])
        hit += len({v for _, v in want} & set(rows.vec_id))
        n += len(want)
    assert set(got.query_id) == {v for v in e.vec_id if v % 20 == 0} and hit >= 0.9 * n


def test_op5(run, table):
    docs, got = table("documents"), run("op5_mixing")
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs.itertuples()}
    source = {r.doc_id: r.source for r in docs.itertuples()}
    names = sorted(set(source.values()), key=lambda m: (m is None, m or ""))
    total = Counter()
    for i, s in size.items():
        total[source[i]] += s
    target = dict(zip(names, mixing.water_fill([total[m] for m in names], [(5, 2, 1)[i % 3] for i in range(len(names))], sum(size.values())), strict=True))
    taken = Counter()
    for g in got.itertuples():
        assert (g.size, g.source_size) == (size[g.doc_id], total[source[g.doc_id]]) and g.target == pytest.approx(target[source[g.doc_id]]) and 0 <= g.taken <= 3 * g.size
        taken[source[g.doc_id]] += g.taken
    assert len(got) == len(docs) and all(abs(taken[m] - target[m]) <= 1 for m in names)
    assert run("op5_mixing").sort_values("doc_id").taken.tolist() == got.sort_values("doc_id").taken.tolist()


def test_op6(run, table):
    docs, got = table("documents"), by_id(run("op6_simhash"))
    fps = {r.doc_id: simhash.simhash(simhash.shingle_hashes(r.text)) for r in docs.itertuples()}
    label = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i in fps:
            low = min(label[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= 3)
            changed |= low < label[i]
            label[i] = min(label[i], low)
    assert {i: (g.fingerprint, g.component_id) for i, g in got.items()} == {i: (f"{fps[i]:016x}", label[i]) for i in fps}


def test_op7(run, table):
    got, labels = by_id(run("op7_toxicity")), table("labels")
    assert set(got) == set(table("documents").doc_id)
    assert all(g.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= g.score <= 1 and g.predicted == int(g.score >= 0.5) for i, g in got.items())
    known = [(r.toxic, got[r.doc_id].predicted) for r in labels.itertuples() if r.doc_id in got]
    assert np.mean([a == b for a, b in known]) >= 0.9


def limits_of(rows, z):
    """Lower and upper limit of each metric from counts in thousandths: the least value that a quarter, half, three quarters do not exceed."""
    out = {}
    for m in quality.METRICS:
        steps = np.sort([min(int(np.floor(r[m] * 1000 + 0.5)), quality.MOST_BIN) for r in rows])
        q1, q2, q3 = (steps[int(np.ceil(k * len(steps) / 4)) - 1] / 1000 for k in (1, 2, 3))
        spread = max((q3 - q1) / 1.349, 0.005)
        out[m] = q2 - z * spread, q2 + z * spread
    return out


def test_op8(run, table):
    docs, got = table("documents"), by_id(run("op8_quality"))
    texts = [t or "" for t in docs.text]
    m = quality.measure(texts, quality.Fertility(*queries.vocabularies()))
    rows = []
    for i, (doc, lang) in enumerate(zip(docs.doc_id, docs.lang, strict=True)):
        script = quality.script_of(texts[i])
        rows.append({"doc": doc, "group": lang if lang is not None else f"script {script}", "script": script, "length": int(np.log2(max(m["n_tokens"][i], 1))), "some": m["n_tokens"][i] > 0, **{k: m[k][i] for k in quality.METRICS}})
    tiers = {"own": ("group", "length"), "group": ("group",), "script": ("script",), "length": ("length",), "all": ()}
    held = {}
    for tier, keys in tiers.items():
        groups = defaultdict(list)
        for r in rows:
            if r["some"]:
                groups[tuple(r[k] for k in keys)].append(r)
        held |= {(tier, k): limits_of(g, quality.Z) for k, g in groups.items() if len(g) >= 30 or tier == "all"}
    for r, text in zip(rows, texts, strict=True):
        g, base = got[r["doc"]], brute_quality(text)
        failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == (*base, failed)
        outside = False
        for metric, low, high in (("piece_chars", 1, 1), ("byte_chars", 1, 1), ("fallback", 0, 1), ("entropy", 1, 0)):
            order = ("own", "length", "all") if metric == "entropy" else ("own", "group", "script", "all")
            if r["some"]:
                a, b = next(held[t, k] for t in order if (k := tuple(r[x] for x in tiers[t])) is not None and (t, k) in held)[metric]
                outside |= bool(low and r[metric] < a - 1e-9) or bool(high and r[metric] > b + 1e-9)
        assert g.kept == (not failed and not outside)


def test_op9(run, table):
    docs, got = table("documents"), by_id(run("op9_suffix_dedup"))
    want = brute_repeats(docs.text, 400)
    assert {i: (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for i, g in got.items()} == dict(zip(docs.doc_id, want, strict=True))


def test_op10(run, table):
    docs, got = table("documents"), by_id(run("op10_secrets"))
    kinds = ("assign", "access", "hex", "random")
    for r in docs.itertuples():
        base, g = brute_secrets(r.text), got[r.doc_id]
        text = ",".join(f"{kinds[k]}:{a}:{z}" for a, k, z in base)
        assert (g.n_assign, g.n_access, g.n_hex) == tuple(sum(k == n for _, k, _ in base) for n in range(3)) and g.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        spans = [s.split(":") for s in g.spans.split(",")] if g.spans else []
        assert [s for s in spans if s[0] != "random"] == [t.split(":") for t in text.split(",") if t]
        keys = [(int(a), kinds.index(k)) for k, a, _ in spans]
        assert keys == sorted(keys)


def test_op11(run, table):
    from tokenizers import Tokenizer

    docs, got = table("documents"), run("op11_window_packing")
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {i: g.sort_values("start") for i, g in got.groupby("doc_id")}
    assert len(pieces) == len(docs)
    for r in docs.itertuples():
        ids, at = np.asarray([*tk.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for p in pieces[r.doc_id].itertuples():
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 1024 and (g.offset == g.length.cumsum() - g.length).all()
    size = got.groupby("sequence_id").length.sum()
    assert np.where(size & (size - 1) == 0, 0, 1024 - size).sum() < 0.03 * size.sum()


def test_op12(run, table):
    from trawl.llm import manifest

    rows = table("documents").astype(object).where(lambda x: x.notna(), None).to_dict("records")

    def tampered(r):
        return r if zlib.crc32(str(r["doc_id"]).encode()) % 3 else r | {"text": r["text"] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])}

    want = manifest.brute_manifest(rows, ["doc_id", "source", "lang", "n_chars", "text"], tampered)
    got = run("op12_merkle_manifest")
    assert {(g.doc_id, g.leaf): (g.subroot, g.root, g.proof_sha256, g.folded_root, g.verified) for g in got.itertuples()} == want and len(got) == len(rows)


def test_op13(run, table):
    from trawl.llm import trie

    rows = [tuple(None if x is None or x != x else x for x in r) for r in table("conversations").itertuples(index=False)]
    got = run("op13_prefix_trie").astype(object).where(lambda x: x.notna(), None)
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    want = trie.brute_trie(rows, lambda c: (c - c % 100, zlib.crc32(str(c).encode()) % 6))
    assert {tuple(None if x is None else x if isinstance(x, str) else int(x) for x in r) for r in got[cols].itertuples(index=False)} == want and len(got) == len(want)
