"""Near-dedup of the pipeline against brute-force Jaccard similarity."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
import pytest
from tests_llm_shared import brute_near
from trawl.llm import resemblance


def corpus():
    r = random.Random(8)
    word = lambda: "w%d" % r.randrange(5000)
    rows = []
    for k in range(60):
        base = [word() for _ in range(r.randint(60, 200))]
        rows.append(base)
        for _ in range(4):  # near copies on both sides of 0.8
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 25))):
                copy[r.randrange(len(copy))] = word()
            rows.append(copy)
    hub = [word() for _ in range(100)]
    for i in range(150):  # a large group whose members are often below 0.8 of each other
        copy = list(hub)
        copy[r.randrange(100)] = word()
        copy[r.randrange(100)] = word()
        rows.append(copy)
    out = [(i, " ".join(w)) for i, w in enumerate(rows)]
    return out + [(9000, ""), (9001, None), (9002, out[0][1].upper()), (9003, "one two")]


@pytest.mark.parametrize("block", [7, 4096])
def test_near_dedup_equals_brute_force_jaccard(spark, monkeypatch, block):
    """Also with buckets that are cut into blocks."""
    monkeypatch.setattr(resemblance, "BLOCK", block)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == corpus_pipeline.COLUMNS
    assert sorted(x["doc_id"] for x in got.collect()) == brute_near(rows)


def test_null_ids_and_repeated_rows(spark):
    t = " ".join(f"x{i}" for i in range(30))
    docs = spark.createDataFrame([(None, t), (5, t), (5, t), (7, t + " more"), (None, "a b")], "doc_id bigint, text string")
    assert sorted(str(x["doc_id"]) for x in resemblance.one_of_each(docs).collect()) == ["5", "None"]


def test_links_between_roots_join_what_all_pairs_join():
    r = np.random.default_rng(4)
    for _ in range(40):
        m = int(r.integers(2, 30))
        sets = [np.unique(r.integers(0, 12, r.integers(4, 12))).astype(np.uint64) for _ in range(m)]
        key, root = np.arange(100, 100 + m), r.integers(0, max(2, m // 2), m)
        alike = lambda x, y: len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y))
        pairs = [(i, j) for i in range(m) for j in range(i) if alike(sets[i], sets[j])]
        got = [(a - 100, b - 100) for a, b in resemblance.joining(key, root, sets, 0.8)]
        assert all(alike(sets[a], sets[b]) and root[a] != root[b] for a, b in got)

        def parts(edges):
            label = root.copy()
            for _ in range(m):
                for a, b in edges:
                    label[label == label[a]] = label[b]
            return [tuple(label == x) for x in label]

        assert parts(got) == parts(pairs)
