"""Dense search, fusion of ranked lists, re-ranking. Queries are a table, so many run in one plan."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions.paths import confidence, path_penalty
from trawl.operators.dense import dense_top_k  # noqa: F401  the first of the searches
from trawl.operators.lexical import top_k
from trawl.sources.files import written

RRF_K, CANDIDATES = 60, 40
#: What a match reason adds to a score.
BOOSTS = {"exact_symbol": 0.35, "signature": 0.20, "path_token": 0.15, "lexical_content": 0.08}


def hydrate(hits: DataFrame, chunks: DataFrame, hit_id: str, chunk_id: str, active: Column | None = None) -> DataFrame:
    """Hits with their chunk. Inactive ones go after the cut at k, so fewer than k may stay, as a lookup per hit would leave."""
    kept = chunks.where(active) if active is not None else chunks
    return hits.join(kept, hits[hit_id] == kept[chunk_id])


def penalised(hits: DataFrame, path: str, query_id: str, resort: bool = False) -> DataFrame:
    """Scores times the path's penalty, beside the search's own (raw_score); ranks stay those of the search unless resort."""
    raw = F.col("raw_score" if "raw_score" in hits.columns else "score")
    out = hits.withColumn("raw_score", raw).withColumn("score", F.round(F.col("score") * path_penalty(path), 9))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), F.col("rank")))) if resort else out


def parent_boost(hits: DataFrame, query_id: str, hit_id: str, kind: str, parent: str, k: int = 10, boost: float = 0.5) -> DataFrame:
    """Per parent the best code score plus boost times the best question score."""
    owner = F.when((F.col(kind) == "hyde") & F.col(parent).isNotNull(), F.col(parent)).otherwise(F.col(hit_id))
    hyde = (F.col(kind) == "hyde") & F.col(parent).isNotNull()
    g = hits.groupBy(query_id, owner.alias("chunk_id")).agg(F.greatest(F.coalesce(F.max(F.when(~hyde, F.col("score"))), F.lit(0.0)), F.lit(0.0)).alias("code_score"), F.greatest(F.coalesce(F.max(F.when(hyde, F.col("score"))), F.lit(0.0)), F.lit(0.0)).alias("hyde_boost"))
    g = g.withColumn("score", F.round(F.col("code_score") + boost * F.col("hyde_boost"), 7))
    return top_k(g, query_id, [F.desc("score"), F.col("chunk_id")], k)


def rrf(ranked: DataFrame, query_id: str, key: list[str], rank: str = "rank", k: float = RRF_K, weight: str | None = None, limit: int = 30) -> DataFrame:
    """Reciprocal rank fusion: the sum of weight / (k + rank) over all lists; by file every chunk of it counts."""
    w = F.col(weight) if weight else F.lit(1.0)
    out = ranked.groupBy(query_id, *key).agg(F.round(F.sum(w / (k + F.col(rank))), 8).alias("score"))
    return top_k(out, query_id, [F.desc("score"), *map(F.col, key)], limit)


def additive(vector: DataFrame, lexical: DataFrame, query_id: str, doc_id: str) -> DataFrame:
    """Vector hits plus one where the words hit too; word-only hits score one; reasons tell which."""
    v = vector.select(query_id, doc_id, F.col("score").alias("_v"))
    t = lexical.select(query_id, doc_id, F.lit(True).alias("_t"))
    both = v.join(t, [query_id, doc_id], "full_outer")
    score = F.round(F.coalesce("_v", F.lit(0.0)) + F.when(F.col("_t"), 1.0).otherwise(0.0), 6)
    reasons = F.concat_ws("+", F.when(F.col("_v").isNotNull(), "vector"), F.when(F.col("_t"), "fts"))
    out = both.select(query_id, doc_id, score.alias("score"), reasons.alias("reasons"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), doc_id)))


def candidate_union(first: DataFrame, second: DataFrame, query_id: str, doc_id: str) -> DataFrame:
    """Both candidate lists (score, source): the larger score, sources joined by a plus."""
    a = first.select(query_id, doc_id, F.col("score").alias("_a"), F.col("source").alias("_sa"))
    b = second.select(query_id, doc_id, F.col("score").alias("_b"), F.col("source").alias("_sb"))
    return a.join(b, [query_id, doc_id], "full_outer").select(query_id, doc_id, F.greatest("_a", "_b").alias("score"), F.concat_ws("+", "_sa", "_sb").alias("source"))


def exact_candidates(queries: DataFrame, chunks: DataFrame, query_id: str, doc_id: str, terms: str = "terms", limit: int = 50) -> DataFrame:
    """Chunks that hold one of a query's first 40 terms as a symbol, or else a path token; score one.

    Terms are lower-cased and symbols are not, so symbols with capitals never match: that is how it is specified.

    Of a term only its first limit documents can be among a query's first limit, as all of one term and kind come in
    the order of their ids; so a common term sends these on and no more. What else the candidates hold is looked up
    in their chunks alone.
    """
    q = queries.select(query_id, F.explode(F.slice(terms, 1, 40)).alias("t")).distinct()
    asked = q.select("t").distinct()
    each = [chunks.select(doc_id, F.lit(i).alias("o"), F.explode(F.array_distinct(c)).alias("t")).join(asked, "t", "left_semi") for i, c in enumerate(("symbols_defined", "path_tokens"))]
    lists = top_k(each[0].unionByName(each[1]), ["t", "o"], [F.col(doc_id)], limit, "_r").drop("_r")
    hits = lists.join(q, "t").groupBy(query_id, doc_id).agg(F.min("o").alias("f"))
    found = written(top_k(hits, query_id, [F.col("f"), F.col(doc_id)], limit).select(query_id, doc_id), "candidates")
    own = chunks.select(doc_id, F.array_distinct("path_tokens").alias("_p")).join(found.select(doc_id).distinct(), doc_id, "left_semi")
    tokens = own.select(doc_id, F.explode("_p").alias("t")).join(q, "t").select(query_id, doc_id).distinct().withColumn("_path", F.lit(True))
    source = F.when(F.col("_path"), "path_tokens").otherwise("symbols_defined")
    return found.join(tokens, [query_id, doc_id], "left").select(query_id, doc_id, F.lit(1.0).alias("score"), source.alias("source"))


def reasons(terms, symbols, path_tokens, signature, content, has_questions) -> Column:
    """Why a candidate matches, in the order they are listed."""
    low = lambda a: F.transform(F.coalesce(F.col(a), F.array().cast("array<string>")), F.lower)
    inside = lambda text, ts: F.exists(ts, lambda t: F.contains(F.lower(F.coalesce(F.col(text), F.lit(""))), t))
    t = F.col(terms)
    found = F.array(
        F.when(F.arrays_overlap(low(symbols), t), F.lit("exact_symbol")),
        F.when(F.arrays_overlap(low(path_tokens), t), F.lit("path_token")),
        F.when(inside(signature, t), F.lit("signature")),
        F.when(inside(content, F.slice(t, 1, 20)), F.lit("lexical_content")),
        F.when(F.col(has_questions), F.lit("semantic_hyde")),
    )
    kept = F.filter(found, lambda x: x.isNotNull())
    return F.when(F.size(kept) == 0, F.array(F.lit("semantic_similarity"))).otherwise(kept)


def rerank(candidates: DataFrame, query_id: str, doc_id: str, k: int = 5) -> DataFrame:
    """Candidates (score, source, terms, metadata) by score plus boosts; rank, confidence and match_reasons."""
    why = reasons("terms", "symbols_defined", "path_tokens", "signature", "content", "has_questions")
    out = candidates.withColumn("_why", why)
    bonus = sum((F.when(F.array_contains("_why", name), F.lit(x)).otherwise(0.0) for name, x in BOOSTS.items()), F.lit(0.0))
    asks = F.arrays_overlap(F.col("terms"), F.array(*map(F.lit, ("test", "tests", "spec", "coverage"))))
    test = F.when(F.col("file_role") == "test", F.when(asks, 0.10).otherwise(-0.08)).otherwise(0.0)
    kind = F.when(F.col("chunk_type").isin("function", "class", "route"), 0.05).otherwise(0.0)
    out = out.withColumn("raw_score", F.col("score")).withColumn("score", F.round(F.col("score") + bonus + test + kind, 6))
    shown = F.when(F.col("source").isin("hybrid", "legacy_dense"), F.col("_why")).otherwise(F.concat(F.array("source"), F.col("_why")))
    out = out.withColumn("match_reasons", shown).withColumn("confidence", confidence("score", F.array_contains("_why", "exact_symbol")))
    return top_k(out, query_id, [F.desc("score"), F.col(doc_id)], k).drop("_why")


def prefetch_limits(limit: int = 10, candidates: int = CANDIDATES) -> dict[str, int]:
    """How many hits each channel brings: candidates (limit at least, 200 at most), half of them from summaries."""
    most = max(limit, min(candidates, 200))
    return {"hyde": most, "code": most, "summary": max(limit, most // 2), "sparse": most}


def channels_rrf(channels: dict[str, DataFrame], query_id: str, key: str, limit: int = 10, candidates: int = CANDIDATES, k: float = RRF_K, weights: dict[str, float] | None = None) -> DataFrame:
    """Ranked hits of several channels (query, key, rank), each cut at its limit, fused by reciprocal ranks."""
    limits, weights = prefetch_limits(limit, candidates), weights or {}
    cut = [df.where(F.col("rank") <= limits[name]).select(query_id, key, "rank", F.lit(float(weights.get(name, 1.0))).alias("_w")) for name, df in channels.items()]
    return rrf(reduce(DataFrame.unionByName, cut), query_id, [key], k=k, weight="_w", limit=limits["code"])


def channel_rrf(hits: DataFrame, query_id: str, hit_id: str, kind: str, parent: str, k: float = RRF_K, limit: int = 10) -> DataFrame:
    """Code and question hits ranked apart, questions standing for their chunk by their best rank, fused by reciprocal ranks."""
    own = Window.partitionBy(query_id, kind).orderBy(F.desc("score"), hit_id)
    owner = F.when((F.col(kind) == "hyde") & F.col(parent).isNotNull(), F.col(parent)).otherwise(F.col(hit_id))
    ranked = hits.withColumn("rank", F.row_number().over(own)).groupBy(query_id, kind, owner.alias("chunk_id")).agg(F.min("rank").alias("rank"))
    return rrf(ranked, query_id, ["chunk_id"], k=k, limit=limit)


def apply_rankings(hits: DataFrame, rankings: DataFrame, query_id: str, k: int = 10) -> DataFrame:
    """Hits in the order of a model's rankings (query, ranking: places from 0 in the order of rank; null: the call failed).

    Places that no hit has go, hits that no place names are lost, a place named twice counts twice, k are kept. A
    failed call keeps the old order up to k (fallback); a query of one hit or none is not re-ranked. Adds reranked and fallback.
    """
    own = Window.partitionBy(query_id)
    few = hits.withColumn("_i", F.row_number().over(own.orderBy("rank")) - 1).withColumn("_n", F.count("*").over(own))
    both = few.join(rankings.select(F.col(query_id).alias("_q"), "ranking"), F.col(query_id) == F.col("_q"), "left")
    valid = F.slice(F.filter("ranking", lambda x: (x >= 0) & (x < F.col("_n"))), 1, k)
    named = F.filter(F.transform(valid, lambda x, at: F.when(x == F.col("_i"), at)), lambda x: x.isNotNull())
    old, failed = F.array(F.col("_i")), F.col("ranking").isNull()
    places = F.when(F.col("_n") <= 1, old).when(failed, F.when(F.col("_i") < k, old).otherwise(F.array().cast("array<int>"))).otherwise(named)
    out = both.withColumn("reranked", (F.col("_n") > 1) & ~failed).withColumn("fallback", (F.col("_n") > 1) & failed)
    return out.withColumn("_at", F.explode(places)).withColumn("rank", (F.col("_at") + 1).cast("int")).drop("_i", "_n", "_q", "_at", "ranking")


def listwise_rerank(hits: DataFrame, query_id: str, ranker: Callable[[list[dict]], list[int]] | None, k: int = 10, candidates: int = 20) -> DataFrame:
    """The first candidates hits of each query in the order that ranker gives (hits as dicts to places from 0); a call that fails keeps the old order."""
    few = hits.where(F.col("rank") <= candidates)
    if ranker is None:
        return few.where(F.col("rank") <= k).withColumn("reranked", F.lit(False)).withColumn("fallback", F.lit(False))
    lists = few.groupBy(query_id).agg(F.array_sort(F.collect_list(F.struct("rank", F.struct(*few.columns).alias("hit")))).alias("hits"))  # candidates at most
    kind = few.schema[query_id].dataType.simpleString()

    def run(batches):
        for b in batches:
            out = []
            for own in b.column("hits").to_pylist():
                try:
                    out.append([int(x) for x in ranker([h["hit"] for h in own])])
                except Exception:  # whatever the model's side raises is a failed call
                    out.append(None)
            yield pa.RecordBatch.from_arrays([b.column(query_id), pa.array(out, pa.list_(pa.int32()))], [query_id, "ranking"])

    return apply_rankings(few, lists.mapInArrow(run, f"`{query_id}` {kind}, ranking array<int>"), query_id, k)


def scored_rerank(scored: DataFrame, query_id: str, k: int = 20) -> DataFrame:
    """The first k hits by model_score; rows without one go last, in their old order."""
    order = Window.partitionBy(query_id).orderBy(F.desc_nulls_last("model_score"), F.col("rank"))
    return scored.where(F.col("rank") <= k).withColumn("rank", F.row_number().over(order)).drop("model_score")


def overlap_scorer(hits: DataFrame, query_terms: str, text_terms: str) -> DataFrame:
    """The offline scorer: the share of a query's terms that a text holds."""
    shared = F.size(F.array_intersect(query_terms, text_terms)) / F.greatest(F.size(query_terms), F.lit(1))
    return hits.withColumn("model_score", shared)


def routed(hits: DataFrame, publications: DataFrame, slug: str) -> DataFrame:
    """Hits of the run that a codebase's publication pointer names, tagged with it."""
    active = publications.select(F.col(slug).alias("_s"), F.col("run_id").alias("active_run"))
    return hits.join(active, (hits[slug] == active["_s"]) & (hits["run_id"] == active["active_run"])).drop("_s")
