"""Each stage of the pipeline against a brute-force version of itself, on what its predecessor kept."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests_llm_shared import brute_near, brute_secrets, prose  # noqa: E402
from trawl.llm import bpe, mixing, queries, quality  # noqa: E402
from trawl.llm.shared import written  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string"


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(4)
    rows = [(i, prose(r.randint(15, 90), i), r.choice(["en", "de"]), f"s{r.randint(0, 4)}") for i in range(60)]
    rows += [(100 + i, rows[i][1] + " one more word", "en", "s1") for i in range(10)] + [(200, rows[3][1], "en", None), (201, "", "en", "s1"), (202, None, None, "s2"), (203, "too short", "en", "s1"), (204, "again and again and again and again " * 9, "en", "s0")]
    rows += [(300, prose(40, 900) + ' password = "hunter22" ' + prose(10, 901), "en", "s3")]
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x") for i, t, lang, s in rows], SCHEMA).repartition(2)


def plain(df):
    return [tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in df.collect()]


def test_every_stage_and_the_whole_run(spark, docs, tmp_path):
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    held = spark.read.parquet(f"{sf}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before, held = held, written(stage(spark, held, sf), "test")
        seen.append((name, before, held))
    assert [n for n, *_ in seen] == ["quality rules", "near-dedup", "secret scans", "mixing", "byte-level BPE"]
    assert all(after.columns == corpus_pipeline.COLUMNS for _, _, after in seen[:4])

    _, before, after = seen[0]
    judged = {r["doc_id"]: r for r in quality.judge_quality(before.select("doc_id", "text", "lang"), queries.vocabularies()).collect()}
    assert Counter(plain(after)) == Counter(x for x in plain(before) if judged[x[0]]["kept"])
    assert not {201, 202, 203, 204} & {x[0] for x in plain(after)} and len(plain(after)) >= 60

    _, before, after = seen[1]
    rows = sorted(plain(before))
    smallest = set(brute_near([x[:2] for x in rows]))
    assert sorted(plain(after)) == [x for x in rows if x[0] in smallest]
    assert 200 not in {x[0] for x in plain(after)}

    _, before, after = seen[2]

    def masked(t):
        out, at = "", 0
        for a, _, z in brute_secrets(t):
            if a >= at:
                out += t[at:a] + "[SECRET]"
            at = max(at, z)
        return out + t[at:]

    assert Counter(plain(after)) == Counter((i, m := masked(t), lang, s, len(m)) for i, t, lang, s, _ in plain(before))

    _, before, after = seen[3]
    mixed = mixing.mix_by_source(before, keep=["doc_id"]).collect()
    want = Counter({r["doc_id"]: int((2 * r["taken"] + r["size"]) // (2 * r["size"])) if r["size"] else 0 for r in mixed})
    assert Counter(x[0] for x in plain(after)) == +want and set(want.values()) <= {0, 1, 2, 3}
    assert set(plain(after)) <= set(plain(before))

    _, before, after = seen[4]
    _, path, pattern = queries.vocabularies()
    enc = bpe.encoding(path, pattern)
    coded = Counter((x[0], len(ids := enc.encode_ordinary(x[1])), np.asarray(ids, "<u4").tobytes(), hashlib.sha256(x[1].encode()).hexdigest()) for x in plain(before))
    assert Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded_sha256"]) for r in after.collect()) == coded

    run = corpus_pipeline.run(spark, sf)
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in run.collect()) == Counter((r["doc_id"], bytes(r["ids"])) for r in after.collect())


def test_stages_take_an_empty_table(spark):
    held = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        held = written(stage(spark, held, ""), "empty")
        assert held.count() == 0


def test_prose_has_no_secret():
    assert not any(brute_secrets(prose(50, k)) for k in range(20)) and re.search("[a-z]", prose(5))
