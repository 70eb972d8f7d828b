"""Search in blocks: the same as counting one by one, and no row for a document and term leaves its task."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trawl.operators import blocks, lexical


def test_terms_inside_words_are_counted_without_overlaps():
    rng = random.Random(1)
    for _ in range(50):
        words = list({"".join(rng.choice("abé😀") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 30))} | {"a b a"})
        terms = list({"".join(rng.choice("abé😀") for _ in range(rng.randint(3, 5))) for _ in range(8)} | {"a b a"})
        v, t, n = blocks.inside(pa.array(words, pa.string()), pa.array(terms, pa.string()))
        assert {(words[a], terms[b]): c for a, b, c in zip(v, t, n)} == {(w, x): w.count(x) for w in words for x in terms if x in w}


def test_products_by_matrix_and_by_list_are_equal(monkeypatch):
    rng = np.random.default_rng(1)
    x, y = (rng.random((n, 40)) * (rng.random((n, 40)) < np.linspace(0, 1, 40)) for n in (30, 20))
    cells = [(*np.nonzero(m), m[np.nonzero(m)]) for m in (x, y)]
    want = np.where(y @ x.T > 0, y @ x.T, -np.inf)
    for dense, laid in ((512, 1 << 22), (0, 7), (5, 7)):
        monkeypatch.setattr(blocks, "DENSE", dense)
        monkeypatch.setattr(blocks, "LAID", laid)
        assert np.allclose(blocks.products(30, *cells[0], 20, *cells[1]), want)


def test_searches_send_no_row_for_a_document_and_term(spark):
    docs = spark.createDataFrame([(i, f"alpha beta{i} gamma") for i in range(50)], "id long, text string")
    q = spark.createDataFrame([(1, "beta alpha"), (2, "gamma")], "q long, text string")
    sparse = lexical.sparse_top_k(lexical.sparse_blocks(q, "q", "text", "q_"), lexical.sparse_blocks(docs, "id", "text"), "q", "id", 3)
    words = lexical.bm25(q.select("q", F.explode(F.split("text", " ")).alias("qterm")), lexical.postings(docs, "id", F.split("text", " ")), "q", 3, True)
    for found in (sparse, words, lexical.trigram_search(q, docs, "q", "id", 3)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "explode" not in plan and [r.id for r in found.where("q = 2").orderBy("rank").collect()] == [0, 1, 2]
    assert words.where("q = 1").count() == 3
    assert lexical.or_search(q, docs, "q", "id").where("q = 2").count() == 10


def test_fusion_routed_searches_once(spark, monkeypatch):
    from trawl.plans import search_queries

    calls = []
    for name in ("words_hits", "shape_hits"):
        was = getattr(search_queries, name)
        monkeypatch.setattr(search_queries, name, lambda *a, was=was, name=name: calls.append(name) or was(*a))
    search_queries.fusion_routed(spark, "/root/testdata/sf0.001")
    assert calls == ["words_hits", "shape_hits"]


@pytest.mark.parametrize("name", ["rrf_fusion", "hybrid_additive", "rrf_by_file"])
def test_fused_searches_keep_postings_in_their_tasks(spark, name):
    """A row for each posting of a document would be sorted by task: nothing that makes rows reads documents, only the queries' words."""
    from trawl.plans import search_queries

    def below(plan):
        yield plan
        for i in range(plan.children().size()):
            yield from below(plan.children().apply(i))

    plan = getattr(search_queries, name)(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    made = [p for p in below(plan) if p.nodeName() == "Generate"]
    assert not any("doc_id" in p.toString() for p in made)
