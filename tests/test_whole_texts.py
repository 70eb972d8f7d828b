"""Queries that once cut the text: fixtures that only whole texts answer right."""

from __future__ import annotations

import __spark_entry__  # noqa: F401  registers the queries
from trawl.plans import registry


def test_dedup_takes_the_whole_text(spark, tmp_path):
    rows = [(1, "How does the cache work?"), (2, "How does the queue work?"), (3, "  how does the CACHE work? "), (4, "other"), (5, "OTHER")]
    spark.createDataFrame(rows, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = registry.QUERIES["dedup_queries"](spark, str(tmp_path)).collect()
    assert sorted(r["item_id"] for r in got) == [1, 2, 4]


def test_symbols_come_from_the_whole_text(spark, tmp_path):
    docs = [(1, "filler " * 60 + "zebra", "a"), (2, "zebra first", "a"), (3, "nothing here", "a")]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "where is zebra")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = registry.QUERIES["exact_candidates"](spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["source"]) for r in got) == [(1, "symbols_defined"), (2, "symbols_defined")]
    ranked = {r["doc_id"]: r["match_reasons"] for r in registry.QUERIES["rerank_deterministic"](spark, str(tmp_path)).collect()}
    assert all("exact_symbol" in ranked[i] for i in (1, 2))
