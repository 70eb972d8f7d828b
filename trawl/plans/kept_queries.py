"""Searches over indexes that are written once and kept: postings in blocks, quantised vectors; and what keeps them up to date."""

from __future__ import annotations

from pyspark.sql import functions as F

from trawl.operators import dense, inverted, lexical
from trawl.plans import text_queries  # noqa: F401  its oracles are used here
from trawl.plans.registry import ORACLES, load, query, with_path
from trawl.plans.search_queries import queries_of


def _words(c):
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9_]+)"), F.lit(1))


def words_index(spark, sf):
    return inverted.kept(spark, f"{sf}/words", lambda: lexical.postings(load(spark, sf, "documents"), "doc_id", _words(F.col("text"))), "doc_id")


def fields_index(spark, sf):
    fields = (_words(F.col("path")), 1.0), (_words(F.concat_ws(" ", "lang", "source")), 3.0), (_words(F.col("text")), 1.0)
    return inverted.kept(spark, f"{sf}/fields", lambda: lexical.postings(with_path(load(spark, sf, "documents")), "doc_id", *fields), "doc_id")


def _asked(spark, sf, *more):
    words = lexical.fts_terms("text")
    return load(spark, sf, "benchmark").select("item_id", F.explode(F.concat(words, F.array(*more)) if more else words).alias("qterm"))


@query("indexed_bm25_topk", ORACLES["bm25_topk"])
def indexed_bm25_topk(spark, sf):
    """BM25 from a kept index: its queries together ask for much of it, so it is read pack by pack."""
    return inverted.search(_asked(spark, sf), words_index(spark, sf), "item_id")


@query("indexed_prefix_topk", ORACLES["bm25_prefix_topk"])
def indexed_prefix_topk(spark, sf):
    return inverted.prefix_search(_asked(spark, sf), words_index(spark, sf), "item_id")


@query("indexed_fields_topk", ORACLES["bm25_fields_topk"])
def indexed_fields_topk(spark, sf):
    """Path, symbols and body, weighted, from an index of all three."""
    more = F.when(F.col("item_id") % 3 == 0, "en").when(F.col("item_id") % 3 == 1, "tests").otherwise("py")
    return inverted.prefix_search(_asked(spark, sf, more), fields_index(spark, sf), "item_id", 5)


def codes_index(spark, sf):
    return dense.kept(spark, f"{sf}/codes", lambda: load(spark, sf, "embeddings"), "vec_id", "embedding")


@query("quantised_topk")
def quantised_topk(spark, sf):
    """dense_topk from product-quantised codes and an exact scoring of a shortlist; approximate, so it has no SQL: its recall is tested."""
    return dense.quantised_top_k(queries_of(spark, sf), codes_index(spark, sf), "query_id", "query_vec")
