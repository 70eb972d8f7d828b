"""Places, quantiles and ordered digests against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from trawl.operators import ordered


def test_places(spark):
    r = random.Random(1)
    data = [(r.randint(0, 50), i) for i in range(3000)]
    df = spark.createDataFrame(data, "v long, i long").repartition(7)
    got = ordered.numbered(df, [F.desc("v"), F.col("i")]).collect()
    assert [(g.v, g.i) for g in sorted(got, key=lambda g: g.place)] == sorted(data, key=lambda x: (-x[0], x[1])) and sorted(g.place for g in got) == list(range(1, 3001))
    same = ordered.numbered(df.select(F.lit(1).alias("v")), [F.col("v")])
    assert sorted(g.place for g in same.collect()) == list(range(1, 3001))
    assert ordered.numbered(df.limit(0), [F.col("v")]).count() == 0


@pytest.mark.parametrize("few", [10, 10_000])
def test_quantiles(spark, monkeypatch, few):
    monkeypatch.setattr(ordered, "FEW", few)
    r = random.Random(2)
    groups = {"a": [r.gauss(0, 1) for _ in range(900)], "b": [5.0] * 400, None: [float(r.randint(0, 3)) for _ in range(333)], "c": [1e308, -1e308, 0.0, *[r.expovariate(1e-6) for _ in range(200)]], "d": [7.5]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("e", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = [0.0, 0.5, 0.95, 1.0]
    for floor in (False, True):
        got = {(q.g, q.p): (q.n, q.value) for q in ordered.quantiles(df, ["g"], "v", shares, floor).collect()}
        place = lambda p, n: min(int(p * n + 1e-9), n - 1) if floor else max(-int(-round(p * n, 9) // 1) - 1, 0)
        assert got == {(g, p): (len(vs), sorted(vs)[place(p, len(vs))]) for g, vs in groups.items() for p in shares}


def test_digest_of_one_group_in_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(ordered, "PIECE", 200)
    r = random.Random(3)
    rows = [("one" if r.random() < 0.9 else r.choice([None, "two"]), i, r.choice([None, "", f"line {i}", "é漢"])) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, i long, line string").repartition(6)
    got = {x.g: (x.digest, x.n) for x in ordered.ordered_digest(df, "g", ["i"], F.col("line"), "\t").collect()}
    want = {}
    for g in ("one", "two", None):
        own = [line or "" for k, _, line in sorted(rows, key=lambda x: x[1]) if k == g]
        want[g] = hashlib.sha256("\t".join(own).encode()).hexdigest(), len(own)
    assert got == want


def test_anchors_by_doubling(spark):
    from trawl.operators import jobs

    r = random.Random(5)
    rows = [(g, r.randint(0, 4000)) for g, n in ((1, 2500), (2, 30), (None, 200), (3, 1)) for _ in range(n)] + [(4, None)]
    df = spark.createDataFrame(rows, "g int, t long").repartition(6)
    for gap in (0, 7, 300, 10_000):
        want = sorted((x.g is None, x.g or 0, x.batch, x["size"], x.first_ms, x.last_ms, x.spread_ms) for x in jobs.anchored_batches(df.where("t is not null"), "g", "t", gap).collect())
        got = sorted((x.g is None, x.g or 0, x.batch, x["size"], x.first_ms, x.last_ms, x.spread_ms) for x in jobs.anchored_in_parallel(df, "g", "t", gap).collect())
        assert got == want
    assert jobs.anchored_in_parallel(df.limit(0), "g", "t").count() == 0
