"""Dense search in blocks against numpy, and the recall of quantised codes."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trawl.operators import dense
from trawl.plans import kept_queries, registry


def brute(q, x, k):
    unit = lambda v: v / np.sqrt((v * v).sum(1))[:, None]
    s = np.round(unit(q) @ unit(x).T, 6)
    return {(i, int(j), r + 1) for i in range(len(q)) for r, j in enumerate(np.lexsort((np.arange(len(x)), -s[i]))[:k])}


def frame(spark, x, name, vec):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} long, {vec} array<double>")


@pytest.mark.parametrize("rows,queries,k", [(1, 1, 5), (300, 40, 10), (900, 130, 3)])
def test_blocks_equal_brute_force(spark, monkeypatch, rows, queries, k):
    monkeypatch.setattr(dense, "ROWS", 128)
    monkeypatch.setattr(dense, "HELD", 2)
    r = np.random.default_rng(1)
    x, q = r.normal(size=(rows, 8)), r.normal(size=(queries, 8))
    x[: rows // 3] = x[0]  # a third of all rows is one vector
    got = dense.dense_top_k(frame(spark, q, "q", "qv").repartition(3), frame(spark, x, "v", "e").repartition(4), "q", "v", "e", "qv", k, block=16)
    assert {(g.q, g.v, g["rank"]) for g in got.collect()} == brute(q, x, k)


def test_queries_that_are_not_sent_to_every_task(spark, monkeypatch):
    monkeypatch.setattr(dense, "SENT", 0)
    r = np.random.default_rng(2)
    x, q = r.normal(size=(400, 6)), r.normal(size=(70, 6))
    got = dense.dense_top_k(frame(spark, q, "q", "qv"), frame(spark, x, "v", "e").repartition(3), "q", "v", "e", "qv", 4, block=16)
    assert {(g.q, g.v, g["rank"]) for g in got.collect()} == brute(q, x, 4)


def test_awkward_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [1.0, 0.0, 0.0]), (7, []), (8, [2.0, 0.0])]
    index = spark.createDataFrame(rows, "v string, e array<double>".replace("v string", "v long"))
    asked = spark.createDataFrame([(1, [3.0, 0.0]), (2, None), (3, [0.0, 0.0])], "q long, qv array<double>")
    got = dense.dense_top_k(asked, index, "q", "v", "e", "qv")
    assert [(g.q, g.v, g.score) for g in got.orderBy("rank").collect()] == [(1, 1, 1.0), (1, 8, 1.0)]
    assert dense.dense_top_k(asked, index.limit(0), "q", "v", "e", "qv").count() == dense.dense_top_k(asked.limit(0), index, "q", "v", "e", "qv").count() == 0


def recall(got, want):
    mine = {(g.q, g.v) for g in got.collect()}
    return len(mine & {(q, v) for q, v, _ in want}) / len(want)


def test_quantised_recall(spark, tmp_path):
    r = np.random.default_rng(3)
    centres = r.normal(size=(30, 32))
    x = centres[r.integers(0, 30, 5000)] + 0.7 * r.normal(size=(5000, 32))
    q = x[:60] + 0.2 * r.normal(size=(60, 32))
    index = dense.quantise(frame(spark, x, "v", "e").repartition(4), "v", "e", f"file://{tmp_path}/codes", sample=3000)
    got = dense.quantised_top_k(frame(spark, q, "q", "qv"), index, "q", "qv", 10)
    assert got.count() == 600 and recall(got, brute(q, x, 10)) >= 0.95
    sizes = index.codes().agg(F.sum(F.octet_length("codes")), F.sum(F.size("ids"))).first()
    assert sizes[0] == 16 * sizes[1] == 16 * 5000


def test_recall_of_the_query_at_production_parameters(spark):
    import os

    sf = "/root/testdata/sf0.1" if os.path.isdir("/root/testdata/sf0.1") else "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    want = {(r.query_id, r.vec_id) for r in registry.QUERIES["dense_topk"](spark, sf).collect()}
    got = {(r.query_id, r.vec_id) for r in kept_queries.quantised_topk(spark, sf).collect()}
    assert len(got & want) >= 0.95 * len(want)


def test_an_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "v long, e array<double>")
    index = dense.quantise(none, "v", "e", f"file://{tmp_path}/none")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "q long, qv array<double>")
    assert dense.quantised_top_k(asked, index, "q", "qv").count() == 0


def test_best_of_a_block_copies_no_whole_score_matrix():
    rng = np.random.default_rng(3)
    scores = np.round(rng.random((1000, 2000)), 3)  # with ties
    scores[rng.random(scores.shape) < 0.3] = -np.inf
    scores[5] = -np.inf
    ids, own = pa.array(np.arange(2000)), dense._Best(1000, 10)
    tracemalloc.start()
    own.add(scores, ids)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 0.5 * scores.nbytes
    got = {}
    for b in own.rows(pa.array(np.arange(1000)), ["q", "v", "s"]):
        for r in b.to_pylist():
            got.setdefault(r["q"], []).append((-r["s"], r["v"]))
    for q in range(1000):
        assert sorted(got.get(q, []))[:10] == sorted((-x, v) for v, x in enumerate(scores[q].tolist()) if x > -np.inf)[:10]
