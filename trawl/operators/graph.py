"""Who calls whom: edges from a chunk that uses a symbol to those that define it, and the context of hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A symbol that more chunks than this define says nothing about which of them is meant, and names no edge.
DEFINERS = 8
#: Neighbours that a hit's context lists; how many there are is told beside.
LISTED = 20


def edges(chunks: DataFrame, chunk_id: str, defined: str = "symbols_defined", used: str = "symbols_used", definers: int = DEFINERS) -> DataFrame:
    """caller, callee: each pair once. A symbol that a chunk defines itself is its own; no chunk calls itself.

    A use meets at most definers definitions, so the edges grow with the uses, however common a symbol is; the side of
    the definitions is cut to that before they meet, and Spark splits the rows of a symbol that very many chunks use.
    """
    d = chunks.select(F.col(chunk_id).alias("callee"), F.explode(F.array_distinct(defined)).alias("symbol"))
    few = d.groupBy("symbol").agg(F.count("*").alias("_n")).where(F.col("_n") <= definers).select("symbol")
    u = chunks.select(F.col(chunk_id).alias("caller"), F.explode(F.array_except(used, defined)).alias("symbol"))
    return u.join(d.join(few, "symbol"), "symbol").where("caller <> callee").select("caller", "callee").distinct()


def context(hits: DataFrame, links: DataFrame, chunks: DataFrame, hit_id: str, chunk_id: str, role: str = "file_role", listed: int = LISTED) -> DataFrame:
    """A row for each distinct hit: calls, called_by and tests (ids, ascending, the first listed of them) and n_calls, n_called_by, n_tests.

    tests are callers whose role is test, called_by the others. A hit without neighbours has empty lists.
    """
    own = hits.select(F.col(hit_id).alias("_hit")).distinct()
    roles = chunks.select(F.col(chunk_id).alias("caller"), F.coalesce(F.col(role) == "test", F.lit(False)).alias("_test"))
    out = links.join(own, F.col("caller") == F.col("_hit")).select("_hit", F.lit("calls").alias("kind"), F.col("callee").alias("other"))
    back = links.join(own, F.col("callee") == F.col("_hit")).join(roles, "caller")
    back = back.select("_hit", F.when(F.col("_test"), "tests").otherwise("called_by").alias("kind"), F.col("caller").alias("other"))
    both = out.unionByName(back)
    counts = both.groupBy("_hit").agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("calls", "called_by", "tests")))
    first = both.withColumn("_r", F.row_number().over(Window.partitionBy("_hit", "kind").orderBy("other"))).where(F.col("_r") <= listed)
    none = F.array().cast(f"array<{chunks.schema[chunk_id].dataType.simpleString()}>")
    lists = first.groupBy("_hit").agg(*(F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col("other")))).alias(k) for k in ("calls", "called_by", "tests")))
    joined = own.join(lists, "_hit", "left").join(counts, "_hit", "left")
    return joined.select(F.col("_hit").alias(hit_id), *(F.coalesce(k, none).alias(k) for k in ("calls", "called_by", "tests")), *(F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in ("calls", "called_by", "tests")))


def neighbours(hits: DataFrame, links: DataFrame, query_id: str, hit_id: str, score: str = "score", share: float = 0.5, k: int = 10) -> DataFrame:
    """query id, hit id, score, rank: hits and what they call or are called by, one step away, at share of the best score that leads there."""
    own = hits.select(query_id, F.col(hit_id).alias("_hit"), F.col(score).cast("double").alias("_s"))
    both = links.select(F.col("caller").alias("_hit"), F.col("callee").alias("_to")).unionByName(links.select(F.col("callee").alias("_hit"), F.col("caller").alias("_to")))
    more = own.join(both, "_hit").groupBy(query_id, F.col("_to").alias(hit_id)).agg((share * F.max("_s")).alias("_s"))
    all_ = own.select(query_id, F.col("_hit").alias(hit_id), "_s").unionByName(more).groupBy(query_id, hit_id).agg(F.round(F.max("_s"), 6).alias("score"))
    order = Window.partitionBy(query_id).orderBy(F.desc("score"), hit_id)
    return all_.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
