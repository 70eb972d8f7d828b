"""Merkle manifests against a plain tree, with what tables may hold."""

import random

import pytest
from pyspark.sql import functions as F

from trawl.llm import manifest, ragged

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, part int, grp string, hash string, start long, _grp string"


def tampered(r):
    if r["doc_id"] is None or r["doc_id"] % 3:
        return r
    return r | {"text": r["text"] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])}


def rows_of(n, langs, seed=0):
    r = random.Random(seed)
    return [{"doc_id": i, "source": r.choice([None, "a", "é:"]), "lang": r.choice(langs), "n_chars": r.choice([None, 5, -1]), "text": r.choice([None, "", "Abc", "É ß 漢字", f"T{i}"])} for i in range(n)]


def check(spark, rows):
    df = spark.createDataFrame([tuple(r[c] for c in COLUMNS) + (1, "x", "y", 7, "z") for r in rows], SCHEMA)
    got = manifest.dataset_manifest(df, COLUMNS, other={"text": manifest.ascii_lower(F.col("text"))}, when=F.col("doc_id") % 3 == 0, proofs=True).collect()
    want = manifest.brute_manifest(rows, COLUMNS, tampered)
    assert len(got) == len(rows)
    for g in got:
        w = want[g.doc_id, g.leaf]
        if len({k for k in want if k == (g.doc_id, g.leaf)}) == 1 and sum((r["doc_id"], r["lang"]) == (g.doc_id, g.lang) for r in rows) == 1:
            assert (g.subroot, g.root, g.proof_sha256, g.folded_root, g.verified) == w
        assert g.root == w[1]
    return got


@pytest.mark.parametrize("n,langs", [(1, ["en"]), (8, [None]), (9, ["en"]), (65, ["en", None, "de"]), (700, ["en"] * 20 + [None, "de", "é", "zz"]), (40, [f"l{i}" for i in range(40)])])
def test_against_plain_trees(spark, n, langs):
    check(spark, rows_of(n, langs))


def test_small_blocks(spark, monkeypatch):
    """Blocks of 8 leaves: a round a level, every partition ragged."""
    monkeypatch.setattr(ragged, "STEP", 1)
    monkeypatch.setattr(ragged, "BLOCK", 8)
    levels = ragged.climb([bytes([i]) * 32 for i in range(20)], 3, 23, manifest.combine)
    assert [(lo, len(nodes)) for lo, nodes in levels] == [(3, 20), (1, 2)]
    assert [(level, i) for level, i, _ in ragged.largest(levels)] == [(0, 3), (0, 4), (0, 5), (0, 6), (0, 7), (1, 1), (1, 2)]


def test_repeated_rows_and_ids_and_nulls(spark):
    same = {"doc_id": 4, "source": "s", "lang": "en", "n_chars": 1, "text": "Same"}
    rows = [dict(same) for _ in range(30)] + [same | {"text": f"other {i}"} for i in range(5)] + [same | {"doc_id": None, "text": f"null {i}"} for i in range(12)]
    got = check(spark, rows)
    assert sorted(g.place for g in got) == list(range(47)) and [g.doc_id for g in sorted(got, key=lambda g: g.place)][:12] == [None] * 12


def test_long_text_and_empty_table(spark):
    rows = rows_of(10, ["en"]) + [{"doc_id": 99, "source": "s", "lang": "en", "n_chars": 2_000_000, "text": "Ab" * 1_000_000}]
    got = check(spark, rows)
    assert [g.verified for g in got if g.doc_id == 99] == [False]
    assert manifest.dataset_manifest(spark.createDataFrame([], SCHEMA), COLUMNS).count() == 0


def test_a_proof_folds_to_the_root(spark):
    got = check(spark, rows_of(300, ["en", "de"]))
    assert len({g.root for g in got}) == 1
    g = next(g for g in got if g.verified)
    assert all(len(x) == 64 for x in g.proof) and g.folded_root == g.root
