"""Verdicts of the quality bands: thin classes, band width, null languages, many languages."""

from __future__ import annotations

import random

import pytest

pytest.importorskip("public_tokenizers")

from tests_llm_shared import prose  # noqa: E402
from trawl.llm import queries, quality  # noqa: E402

ODD = "ᎠᎡᎢᎣ " * 3 + "ᚠᚡ ᚢ ᚣᚤ ᚥ ᚦ ᚧᚨ ᚩ ᚪ ᚫ"


def kept(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = quality.judge_quality(docs, queries.vocabularies(), keep=["doc_id"], **options).collect()
    assert len(got) == len(rows)
    return {r["doc_id"]: r["kept"] for r in got if not r["base_failed"]}


def test_thin_classes_are_judged(spark):
    rows = [(i, prose(60, i), "en") for i in range(200)] + [(999, ODD, "en"), (998, ODD + " ᚬ", "xx")]
    got = kept(spark, rows, z=8.0)
    assert got[999] is False and got[998] is False and all(got[i] for i in range(200) if i in got)


def test_a_small_table_is_judged(spark):
    got = kept(spark, [(i, prose(60, i), "en") for i in range(12)] + [(999, ODD, "en")], z=8.0)
    assert got[999] is False and any(got[i] for i in range(12) if i in got)


def test_default_width_rejects_gibberish(spark):
    """More and more gibberish in clean texts of one language and length: the default width rejects from a lower share on."""
    r = random.Random(3)
    plain = ["the", "house", "water", "people", "number", "little", "because", "through", "country", "sentence", "great", "animal"]
    clean = [(i, " ".join(r.choice(plain) if r.random() > 0.3 else "%s%s" % (r.choice(plain), r.choice(["s", "ly", "ness"])) for _ in range(100)), "en") for i in range(150)]
    junk = [(1000 + i, " ".join(r.choice(plain) if r.random() > share else "".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(5)) for _ in range(100)), "en") for i, share in enumerate([k / 100 for k in range(2, 26)])]
    loose, got = kept(spark, clean + junk, z=8.0), kept(spark, clean + junk)
    gone = lambda x: [i for i, *_ in junk if not x[i]]
    assert set(gone(loose)) < set(gone(got)) and len(gone(got)) >= 16
    assert sum(got[i] for i, *_ in clean) >= 147


def test_null_languages_are_judged_by_script(spark):
    """Half of the null-language rows are Greek; a Greek text hidden among Latin ones would widen no band of theirs."""
    r = random.Random(6)
    greek = ["νερό", "άνθρωπος", "σπίτι", "μεγάλος", "χώρα", "θάλασσα", "δρόμος", "φως"]
    latin = ["the", "house", "water", "people", "number", "little", "because", "through"]
    text = lambda own: " ".join(r.choice(own) for _ in range(60))
    gibberish = " ".join("".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(5)) for _ in range(60))
    rows = [(i, text(greek), None) for i in range(60)] + [(100 + i, text(latin), None) for i in range(60)] + [(999, gibberish, None)]
    for options in ({}, {"lang_col": None}):
        got = kept(spark, rows, **options)
        assert got[999] is False and sum(not v for v in got.values()) <= 6


def test_scripts():
    assert [quality.script_of(t) for t in ("abc é", "νερό a", "漢字 a", "Ꭰ Ꭱ", "שלום", "12 ..", "", "мир ab c")] == ["latin", "greek", "han", "cherokee", "hebrew", "none", "none", "cyrillic"]


def test_classes_beyond_the_bound_keep_their_bands(spark, monkeypatch):
    """Judges alike with more classes than are sent to the documents."""
    rows = [(i, prose(60, i), f"l{i % 40}") for i in range(80)] + [(900 + i, ODD, f"l{i}") for i in range(5)]
    want = kept(spark, rows)
    monkeypatch.setattr(quality, "MOST_SENT", 3)
    limit = spark.range(1).__class__.limit
    monkeypatch.setattr(spark.range(1).__class__, "limit", lambda self, n: limit(self, min(n, 3)))  # as a bound in the plan would
    assert kept(spark, rows) == want and not any(want[900 + i] for i in range(5))
