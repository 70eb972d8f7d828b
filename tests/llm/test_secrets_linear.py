"""Scans and redaction of texts with very many matches: right, and in time that follows the text."""

import time

import pytest
from pyspark.sql import functions as F

from tests_llm_shared import brute_secrets
from trawl.llm import secrets


def log(n):
    return " ".join(f"é{i} token={i:08d}abcdef {i * 2654435761 % 2**64:016x}{i:016x}" for i in range(n))


def brute_redact(text, spans):
    out, at = [], 0
    for a, z in spans:
        if a >= at:
            out.append(text[at:a] + "[SECRET]")
        at = max(at, z)
    return "".join(out) + text[at:]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 4095, 4097, 9000])
def test_spans_and_redaction(spark, n):
    text = log(n) if n else "no secrets here"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.scan_secrets(df).collect()}
    spans = [(s.start, s.kind, s.end) for s in got[1].secrets]
    assert [s for s in spans if s[1] < 3] == brute_secrets(text) and not got[2].secrets and not got[3].secrets
    clean = {r.doc_id: r.text for r in secrets.redact(secrets.scan_secrets(df)).collect()}
    assert clean == {1: brute_redact(text, [(a, z) for a, _, z in spans]), 2: None, 3: ""}


def test_running_values(spark):
    import random

    r = random.Random(1)
    for n in (0, 1, 5, 64, 200, 5000):
        v = [r.randint(0, 9) for _ in range(n)]
        df = spark.createDataFrame([(v,)], "v array<int>")
        sums, tops = df.select(secrets._before(F.col("v"), secrets._sum, (100, 7)), secrets._before(F.col("v"), lambda a, b: F.greatest(a, b))).first()
        assert sums == [sum(v[:i]) for i in range(n)] if n < 1000 else sums[-1] == sum(v[:-1])
        assert tops == [max(v[:i], default=0) for i in range(n)] if n < 1000 else tops[-1] == max(v[:-1])


def test_four_megabytes_take_about_four_times_one(spark):
    def seconds(n):
        df = spark.createDataFrame([(1, log(n))], "doc_id long, text string").checkpoint()
        secrets.redact(secrets.scan_secrets(df)).write.format("noop").mode("overwrite").save()
        began = time.time()
        secrets.redact(secrets.scan_secrets(df)).write.format("noop").mode("overwrite").save()
        return time.time() - began

    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    small, large = seconds(16_000), seconds(64_000)
    assert large < 8 * small + 5


def test_columns_of_any_name_are_carried(spark):
    names = ["doc_id", "text", "__base__", "__tokens__", "__kept__", "a.b", "__text__", "hit", "secrets"]
    df = spark.createDataFrame([(1, "password=hunter22", "b", "t", "k", "dot", "x", "h", "old")], names)
    got = secrets.scan_secrets(df)
    assert got.columns == names[:-1] + ["secrets"]
    r = got.first()
    assert list(r)[:-1] == [1, "password=hunter22", "b", "t", "k", "dot", "x", "h"] and [(s.start, s.end) for s in r.secrets] == [(0, 17)]
