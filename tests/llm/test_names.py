"""Columns of the caller's with the names of inner ones."""

import pytest

from trawl.llm import mixing, resemblance

TEXT = "one two three four five six seven eight nine ten eleven twelve"


def rows(spark, names):
    data = [(i, f"{TEXT} {i // 2}", *[f"{n}-{i}" for n in names]) for i in range(6)]
    return spark.createDataFrame(data, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))


def test_judge_quality(spark):
    pytest.importorskip("public_tokenizers")
    from trawl.llm import quality, queries

    names = ["lang", "__group__", "__script__", "__length__", "__text__", "_g", "_m", "kept_0", "text_in", "a.b", "n_tokens"]
    got = quality.judge_quality(rows(spark, names), queries.vocabularies())
    assert got.columns == ["doc_id", "text", *names, *quality.BASE, *quality.METRICS, "base_failed", "kept"]
    assert sorted(tuple(r)[2 : 2 + len(names)] for r in got.collect()) == sorted(tuple(f"{n}-{i}" for n in names) for i in range(6))


def test_one_of_each(spark):
    names = ["_key", "_n", "_fp", "_bands", "__text__", "_id", "_k", "_i", "root", "_least", "count", "kept_1", "a.b"]
    df = rows(spark, names)
    got = resemblance.one_of_each(df)
    assert got.columns == df.columns
    kept = sorted(tuple(r) for r in got.collect())
    assert {r[0] for r in kept} <= {0, 2, 4} and all(r[2:] == tuple(f"{n}-{r[0]}" for n in names) for r in kept)


def test_mix(spark):
    from pyspark.sql import functions as F

    names = ["source", "_m", "_end", "_start", "_whole", "_rest", "words", "_part", "_name", "size_"]
    df = rows(spark, names)
    got = mixing.mix(df, F.array("source"), mixing.word_count(F.col("text")), keep=["doc_id", *names])
    assert sorted(tuple(r)[: 1 + len(names)] for r in got.collect()) == sorted((i, *[f"{n}-{i}" for n in names]) for i in range(6))
