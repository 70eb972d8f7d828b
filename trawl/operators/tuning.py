"""Fusion that is tuned and routed: a class for each query by its form, a grid of constants and weights scored by class.

The two ranked lists of a query are joined once, cut, and only then multiplied by the grid's cells, each document with
the few numbers that a cell needs; so the grid costs cells x hits, not cells x searches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the grid: constants of reciprocal rank fusion, weights of the word channel (the other weighs 1).
KS, WEIGHTS = (5, 10, 20, 30, 60), (0.8, 1.0, 1.5, 2.0)
#: What a question begins with.
ASKING = ("how", "what", "where", "when", "why", "which", "who", "does", "do", "is", "are", "can", "should")


def query_type(text) -> Column:
    """path, symbol, error, question, keywords or prose, by the form of a query alone; the first that fits.

    path: a slash between names, or a name with a short extension. symbol: one word with a capital or digit inside, an
    underscore, a dot, or a call's brackets. error: words that logs use, or a hexadecimal address. question: begins with a word that
    asks or ends with its mark. keywords: up to three words. Null and empty texts are keywords.
    """
    t = F.trim(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    first = F.regexp_replace(F.lower(F.coalesce(F.try_element_at(words, F.lit(1)), F.lit(""))), "[^a-z]", "")
    one = F.size(words) == 1
    return (
        F.when(t.rlike(r"(^|\s)[\w.-]*/[\w./-]+(\s|$)") | (one & t.rlike(r"^[\w-]+(\.[a-z]{2,5})+$")), "path")
        .when(one & (t.rlike(r"[a-z][A-Z0-9]") | t.rlike(r"\w_\w") | t.rlike(r"\w(\.|::)\w") | t.rlike(r"\w\(.*\)$")), "symbol")
        .when(t.rlike(r"(?i)\b(error|exception|traceback|failed|fatal|undefined|cannot)\b") | t.rlike(r"\b0x[0-9a-fA-F]{4,}\b"), "error")
        .when(first.isin(*ASKING) | t.endswith("?"), "question")
        .when(F.size(words) <= 3, "keywords")
        .otherwise("prose")
    )


def grid(spark, ks=KS, weights=WEIGHTS) -> DataFrame:
    """k, w: the cells."""
    return spark.createDataFrame([(int(k), float(w)) for k in ks for w in weights], "k int, w double")


def grid_ndcg(words: DataFrame, vectors: DataFrame, golden: DataFrame, query_id: str, item: str, ks=KS, weights=WEIGHTS, depth: int = 10) -> DataFrame:
    """query id, k, w, ndcg: the nDCG at depth (2 ** grade - 1 over log2) of each query under each cell's fusion.

    words and vectors: ranked hits (query id, item, rank). golden: query id, item, grade; a query without a graded item
    has no rows. Fused scores are rounded to eight decimals, ties go to the smaller item.
    """
    a, b = words.select(query_id, item, F.col("rank").alias("_a")), vectors.select(query_id, item, F.col("rank").alias("_b"))
    graded = golden.select(query_id, item, "grade")
    both = a.join(b, [query_id, item], "full_outer").join(graded, [query_id, item], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    cells = F.array(*(F.struct(F.lit(int(k)).alias("k"), F.lit(float(w)).alias("w")) for k in ks for w in weights))
    each = both.withColumn("_c", F.explode(cells)).select(query_id, item, "grade", "_a", "_b", "_c.k", "_c.w")
    part = lambda w, r: F.coalesce(w / (F.col("k") + F.col(r)), F.lit(0.0))
    fused = each.withColumn("score", F.round(part(F.col("w"), "_a") + part(F.lit(1.0), "_b"), 8))
    own = Window.partitionBy(query_id, "k", "w").orderBy(F.desc("score"), item)
    gain = lambda r: (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col(r) + 1)
    ranked = fused.withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= depth)
    got = ranked.groupBy(query_id, "k", "w").agg(F.sum(gain("_r")).alias("_got"))
    best = graded.withColumn("_r", F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("grade"), item))).where(F.col("_r") <= depth)
    ideal = best.groupBy(query_id).agg(F.sum(gain("_r")).alias("_ideal")).where("_ideal > 0")
    all_cells = ideal.withColumn("_c", F.explode(cells)).select(query_id, "_ideal", "_c.k", "_c.w")
    return all_cells.join(got, [query_id, "k", "w"], "left").select(query_id, "k", "w", F.round(F.coalesce("_got", F.lit(0.0)) / F.col("_ideal"), 6).alias("ndcg"))


def by_type(scores: DataFrame, types: DataFrame, query_id: str) -> DataFrame:
    """type, k, w, n, ndcg: the mean of each cell over the queries of a type (types: query id, type)."""
    return scores.join(types, query_id).groupBy("type", "k", "w").agg(F.count("*").alias("n"), F.round(F.avg("ndcg"), 6).alias("ndcg"))


def chosen(cells: DataFrame) -> DataFrame:
    """type, k, w: the best cell of each type; of equals the larger k, then the weight nearest to one, then the smaller."""
    own = Window.partitionBy("type").orderBy(F.desc("ndcg"), F.desc("k"), F.abs(F.col("w") - 1), "w")
    return cells.withColumn("_n", F.row_number().over(own)).where("_n = 1").select("type", "k", "w", "ndcg")


def routed_fusion(channels: dict[str, DataFrame], weighted: str, types: DataFrame, routes: DataFrame, query_id: str, item: str, limit: int = 10, k: int = 60) -> DataFrame:
    """Fusion with the constants of each query's type: query id, item, score, rank, type.

    channels: ranked hits by name; weighted names the one that a route's w weighs, the others weigh 1. Types without a
    route take k and a weight of 1. routes has a row for each type, a handful, and is sent to every task.
    """
    ranked = reduce(DataFrame.unionByName, (c.select(query_id, item, "rank", F.lit(name).alias("_channel")) for name, c in channels.items()))
    sent = F.broadcast(routes.select(F.col("type").alias("_t"), F.col("k").alias("_k"), F.col("w").alias("_w")))
    own = ranked.join(types, query_id).join(sent, F.col("type") == F.col("_t"), "left")
    w = F.when(F.col("_channel") == weighted, F.coalesce("_w", F.lit(1.0))).otherwise(1.0)
    fused = own.groupBy(query_id, item, "type").agg(F.round(F.sum(w / (F.coalesce("_k", F.lit(k)) + F.col("rank"))), 8).alias("score"))
    order = Window.partitionBy(query_id).orderBy(F.desc("score"), item)
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
