"""Graded retrieval evaluation."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlaps(file_a, start_a, end_a, file_b, start_b, end_b) -> Column:
    """Same file, and line ranges that meet; no golden range matches all, a missing result range none."""
    open_ = F.col(start_b).isNull() | F.col(end_b).isNull()
    meet = (F.col(start_a) <= F.col(end_b)) & (F.col(end_a) >= F.col(start_b))
    return (F.col(file_a) == F.col(file_b)) & (open_ | F.coalesce(meet, F.lit(False)))


def same_file_loosely(a, b) -> Column:
    """Either path ends in the other, or the names are equal."""
    base = lambda c: F.substring_index(F.col(c), "/", -1)
    return F.col(a).endswith(F.col(b)) | F.col(b).endswith(F.col(a)) | (base(a) == base(b))


def dcg(grades: list[float]) -> float:
    return sum((2**g - 1) / math.log2(i + 2) for i, g in enumerate(grades))


def score_ranked(results: list[dict], relevant: list[dict], k: int, best_grade: bool = True) -> dict[str, float]:
    """Recall (any hit), reciprocal rank and nDCG at k; a missing grade is 1, and only a grade above 0 is a hit.

    Each golden item matches once: of those that a result meets the highest grade goes first, or (best_grade off) the first listed.
    """
    grade = lambda g: 1 if g.get("grade") is None else g["grade"]

    def meets(r: dict, g: dict) -> bool:
        if r["file"] != g["file"]:
            return False
        if g.get("start_line") is None or g.get("end_line") is None:
            return True
        known = r.get("start_line") is not None and r.get("end_line") is not None
        return known and r["start_line"] <= g["end_line"] and r["end_line"] >= g["start_line"]

    free, grades = list(relevant), []
    for r in results[:k]:
        met = [g for g in free if meets(r, g)]
        taken = (max(met, key=grade) if best_grade else met[0]) if met else None
        if taken is not None:
            free.pop(next(i for i, g in enumerate(free) if g is taken))
        grades.append(grade(taken) if taken is not None else 0)
    first = next((i for i, g in enumerate(grades, 1) if g > 0), 0)
    ideal = dcg(sorted(map(grade, relevant), reverse=True)[:k])
    return {"recall": float(first > 0), "mrr": 1 / first if first else 0.0, "ndcg": dcg(grades) / ideal if ideal else 0.0}


def evaluate(results: DataFrame, golden: DataFrame, query_id: str, k: int = 10) -> DataFrame:
    """recall, mrr and ndcg of each golden query (relevant: array of file, start_line, end_line, grade); queries without results score 0.

    Greedy matching is sequential in a query, whose list is cut at k before it is gathered.
    """
    kind = golden.schema[query_id].dataType.simpleString()
    lists = results.where(F.col("rank") <= k).groupBy(query_id).agg(F.array_sort(F.collect_list(F.struct("rank", "file", "start_line", "end_line"))).alias("results"))
    both = golden.join(lists, query_id, "left").select(query_id, "relevant", "results")

    def run(batches):
        for b in batches:
            got = [score_ranked(r or [], g or [], k) for g, r in zip(b.column("relevant").to_pylist(), b.column("results").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(query_id), *(pa.array([x[m] for x in got], pa.float64()) for m in ("recall", "mrr", "ndcg"))], [query_id, "recall", "mrr", "ndcg"])

    return both.mapInArrow(run, f"{query_id} {kind}, recall double, mrr double, ndcg double")


def binary_metrics(hits: DataFrame, query_id: str, relevant: str, k: int = 10) -> DataFrame:
    """success and mrr at k from a flag on ranked hits, without gathering lists."""
    rank = F.when(F.col(relevant) & (F.col("rank") <= k), F.col("rank"))
    return hits.groupBy(query_id).agg(F.coalesce(F.max(rank.isNotNull().cast("int")), F.lit(0)).alias("success"), F.round(F.coalesce(1 / F.min(rank), F.lit(0.0)), 6).alias("mrr"))


def graded_ndcg(hits: DataFrame, golden: DataFrame, query_id: str, item: str, k: int = 10) -> DataFrame:
    """nDCG at k where each item has one grade: gains of the hits over those of the best k golden items."""
    from pyspark.sql import Window

    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + 1)
    best = golden.withColumn("_r", F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("grade"), item))).where(F.col("_r") <= k)
    ideal = best.groupBy(query_id).agg(F.sum(gain(F.col("grade"), F.col("_r"))).alias("_i"))
    got = hits.where(F.col("rank") <= k).join(golden, [query_id, item]).groupBy(query_id).agg(F.sum(gain(F.col("grade"), F.col("rank"))).alias("_g"))
    return ideal.join(got, query_id, "left").select(query_id, F.round(F.when(F.col("_i") > 0, F.coalesce("_g", F.lit(0.0)) / F.col("_i")).otherwise(0.0), 6).alias("ndcg"))


def linear_ndcg(hits: DataFrame, query_id: str, grade: str, k: int = 10) -> DataFrame:
    """The lenient variant: plain grades, normalised by what was retrieved."""
    from pyspark.sql import Window

    own = hits.where(F.col("rank") <= k).withColumn("_b", F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc(grade), "rank")))
    sums = own.groupBy(query_id).agg(F.sum(F.col(grade) / F.log2(F.col("rank") + 1)).alias("d"), F.sum(F.col(grade) / F.log2(F.col("_b") + 1)).alias("i"))
    return sums.select(query_id, F.round(F.when(F.col("i") > 0, F.col("d") / F.col("i")).otherwise(0.0), 6).alias("ndcg"))


def nearest_rank(value, p: float) -> Column:
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")


def floor_rank(df: DataFrame, group: list[str], value: str, p: float) -> DataFrame:
    """The variant that takes place floor(p n), counted from 0. Equal values are counted before they are put in order."""
    from pyspark.sql import Window

    n = Window.partitionBy(*group)
    counts = df.groupBy(*group, value).agg(F.count("*").alias("_c"))
    own = counts.withColumn("_upto", F.sum("_c").over(n.orderBy(value))).withColumn("_n", F.sum("_c").over(n))
    place = F.least(F.floor(p * F.col("_n")), F.col("_n") - 1)
    return own.where((F.col("_upto") - F.col("_c") <= place) & (place < F.col("_upto"))).select(*group, F.col(value).alias("value"))


def verdict(a, b, margin: float = 0.01) -> Column:
    return F.when(F.col(a) - F.col(b) > margin, "a").when(F.col(b) - F.col(a) > margin, "b").otherwise("tie")


def identifier_hits(question, identifiers) -> Column:
    return F.size(F.filter(F.col(identifiers), lambda i: F.contains(F.col(question), i)))


def holders(items: DataFrame, docs: DataFrame, item_id: str, doc_id: str, text: str = "text") -> DataFrame:
    """item and document of every document that holds an item's whole text, case and white space as they stand.

    The text's inner words (white space on both sides) are words of any document that holds it; the one that fewest
    documents have proposes them, by ids alone, and only then do the two texts meet. Texts without an inner word are
    proposed by their first three characters. Null and empty texts are held by none.
    """
    split = lambda c: F.filter(F.split(c, r"\s+"), lambda x: x != "")
    some = items.where(F.length(text) > 0).select(item_id, F.col(text).alias("_item"), split(F.col(text)).alias("_w"))
    inner = F.array_distinct(F.slice("_w", 2, F.greatest(F.size("_w") - 2, F.lit(0))))
    keys = some.select(item_id, F.explode(inner).alias("_key"))
    words = docs.select(doc_id, F.explode(F.array_distinct(split(F.col(text)))).alias("_key")).join(keys.select("_key").distinct(), "_key", "left_semi")
    rare = keys.join(words.groupBy("_key").agg(F.count("*").alias("_n")), "_key", "left").groupBy(item_id).agg(F.min_by("_key", F.struct(F.coalesce("_n", F.lit(0)), "_key")).alias("_key"))
    bare = some.where(F.size("_w") < 3).select(item_id, F.left("_item", F.lit(3)).alias("_key"))
    chars = docs.select(doc_id, F.split(text, "").alias("_c"))
    grams = F.flatten(F.transform(F.sequence(F.lit(0), F.size("_c") - 1), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(3), F.size("_c") - i)), lambda n: F.array_join(F.slice("_c", i + 1, n), ""))))
    parts = chars.where(F.size("_c") > 0).join(F.broadcast(bare.agg(F.count("*").alias("_bare")).where("_bare > 0")), F.lit(True)).select(doc_id, F.explode(F.array_distinct(grams)).alias("_key"))  # nothing, where no item is bare
    proposed = rare.join(words, "_key").select(item_id, doc_id).unionByName(bare.join(parts, "_key").select(item_id, doc_id))
    both = proposed.join(some.select(item_id, "_item"), item_id).join(docs.select(doc_id, F.col(text).alias("_doc")), doc_id)
    return both.where(F.contains("_doc", F.col("_item"))).select(item_id, doc_id)
