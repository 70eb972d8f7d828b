"""Merge-on-read tables against a plain upsert, and what they write."""

import os
import random

import pytest
from pyspark.sql import functions as F

from trawl.operators import incremental
from trawl.sources.merging import MergeTable

SCHEMA = "k long, v string, at int"


def rows(df):
    return sorted(((r.k is None, r.k or 0), r.v, r.at) for r in df.collect())


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet"))


def test_equals_plain_upserts(spark, tmp_path):
    r = random.Random(1)
    base = [(i, f"v{i}", 0) for i in range(200)] + [(None, "null key", 0)]
    table, plain = MergeTable.create(frame(spark, base), f"file://{tmp_path}/t", "k", "at", 8), frame(spark, base)
    versions = {0: rows(plain)}
    for step in range(1, 5):
        new = [(r.choice([None, *range(250)]), f"s{step}", r.randint(1, 9)) for _ in range(30)]
        new = list({(k, at): (k, v, at) for k, v, at in new}.values())
        plain = spark.createDataFrame(incremental.upsert(plain, frame(spark, new), "k", "at").collect(), SCHEMA)
        number = table.upsert(frame(spark, new))
        gone = frame(spark, [(r.randrange(250), None, None) for _ in range(5)])
        plain = spark.createDataFrame(plain.join(gone.select("k"), "k", "left_anti").collect(), SCHEMA)
        number = table.delete(gone)
        assert rows(table.read()) == rows(plain)
        versions[number] = rows(plain)
        if step % 2 == 0:
            assert table.compact() is not None and table.compact() is None
            assert rows(table.read()) == rows(plain)
    for number, want in versions.items():
        assert rows(table.read(number)) == want
    table.vacuum()
    assert rows(table.read()) == rows(plain) and table.vacuum() == []


def test_an_upsert_of_a_hundredth_writes_about_a_hundredth(spark, tmp_path):
    wide = spark.range(40_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("v"), F.lit(0).alias("at"))
    table = MergeTable.create(wide, f"file://{tmp_path}/t", "k", "at", 16)
    before = size(tmp_path)
    table.upsert(wide.where("k % 100 = 3").withColumn("at", F.lit(1)))
    assert size(tmp_path) - before < 0.03 * before
    assert table.read().where("at = 1").count() == 400 and table.read().count() == 40_000


def test_compaction_leaves_untouched_buckets_alone(spark, tmp_path):
    table = MergeTable.create(frame(spark, [(i, "a", 0) for i in range(100)]), f"file://{tmp_path}/t", "k", "at", 10)
    table.upsert(frame(spark, [(5, "b", 1)]))
    table.compact()
    assert len(set(table.log()[-1]["folders"].values())) == 2 and list(table.log()[-1]["folders"].values()).count(table.log()[0]["folders"]["0"]) == 9


def test_a_batch_that_is_sent_again_is_there_once(spark, tmp_path):
    table = MergeTable.create(frame(spark, [(1, "a", 0)]), f"file://{tmp_path}/t", "k", "at", 2)
    sink = table.sink()
    for _ in range(2):
        sink(frame(spark, [(1, "b", 1), (2, "c", 1)]), 7)
    assert len(table.log()) == 2 and rows(table.read()) == rows(frame(spark, [(1, "b", 1), (2, "c", 1)]))


def test_of_two_writers_one_takes_the_next_number(spark, tmp_path):
    table = MergeTable.create(frame(spark, [(1, "a", 0)]), f"file://{tmp_path}/t", "k", "at", 2)
    assert table._commit(1, {"kind": "delta", "folder": "nowhere", "touched": []}) and not table._commit(1, {"kind": "delta"})
    assert table.upsert(frame(spark, [(1, "b", 1)])) == 2 and rows(table.read()) == [((False, 1), "b", 1)]


def test_empty_tables_and_deltas(spark, tmp_path):
    table = MergeTable.create(frame(spark, []), f"file://{tmp_path}/t", "k", "at", 4)
    assert table.read().count() == 0
    table.upsert(frame(spark, []))
    table.upsert(frame(spark, [(1, "x", 0), (1, "y", 2)]))
    assert rows(table.read()) == [((False, 1), "y", 2)]
    with pytest.raises(ValueError):
        MergeTable.create(frame(spark, []), f"file://{tmp_path}/t", "k", "at")
    with pytest.raises(ValueError):
        MergeTable(spark, f"file://{tmp_path}/none").read()
