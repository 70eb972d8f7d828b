"""Renames of files that also changed: pairs of a deleted and an added file that share half of their bytes, line by line.

A pair's similarity is the bytes of the lines that both have (as often as both have them) over the larger file's. Pairs
are proposed by rare lines alone: with lines in order of how many files have them, two files of a similarity of at
least `least` share a line among those that make up the first 1 - least of either's bytes. So a closing bracket or a
licence, which stand in every file, propose nothing. Of the pairs the best goes first, and each file goes once.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.operators.incremental import diff_manifest
from trawl.sources.files import written


def lines(files: DataFrame, path: str, text: str) -> DataFrame:
    """path, line (a hash), n (how often), bytes (of all of them, each with its line feed) and size (of the file)."""
    each = files.select(F.col(path).alias("path"), F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("_l"))
    counted = each.groupBy("path", F.xxhash64("_l").alias("line"), F.octet_length("_l").alias("_o")).agg(F.count("*").alias("n"))
    return counted.select("path", "line", "n", (F.col("n") * (F.col("_o") + 1)).alias("bytes"))


def similar_pairs(gone: DataFrame, new: DataFrame, path: str, text: str, least: float = 0.5) -> DataFrame:
    """previous_path, file_path, similarity (six decimals) of all pairs that reach least."""
    a, b = (written(lines(x, path, text), "lines") for x in (gone, new))
    spread = a.select("line").union(b.select("line")).groupBy("line").agg(F.count("*").alias("_files"))

    def leading(x: DataFrame) -> DataFrame:
        """The rare lines of each file, up to 1 - least of its bytes and the one that crosses it; and its size."""
        order = Window.partitionBy("path").orderBy("_files", "line")
        seen = F.coalesce(F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        own = x.join(spread, "line").withColumn("_seen", seen).withColumn("size", F.sum("bytes").over(Window.partitionBy("path")))
        return own.where(F.col("_seen") <= (1 - least) * F.col("size")).select("path", "line", "size")

    p = leading(a).select(F.col("path").alias("previous_path"), "line", F.col("size").alias("_s"))
    q = leading(b).select(F.col("path").alias("file_path"), "line", F.col("size").alias("_t"))
    near = F.least("_s", "_t") >= least * F.greatest("_s", "_t")  # what the shorter has cannot reach it else
    proposed = p.join(q, "line").where(near).select("previous_path", "file_path", F.greatest("_s", "_t").alias("_most")).distinct()
    x = a.select(F.col("path").alias("previous_path"), "line", F.col("n").alias("_m"), (F.col("bytes") / F.col("n")).alias("_each"))
    y = b.select(F.col("path").alias("file_path"), "line", F.col("n").alias("_n"))
    shared = proposed.join(x, "previous_path").join(y, ["file_path", "line"]).groupBy("previous_path", "file_path", "_most").agg(F.sum(F.least("_m", "_n") * F.col("_each")).alias("_both"))
    score = F.round(F.col("_both") / F.col("_most"), 6)
    return shared.select("previous_path", "file_path", score.alias("similarity")).where(F.col("_both") >= least * F.col("_most"))


def one_to_one(pairs: DataFrame) -> DataFrame:
    """The pairs that a greedy choice takes: best similarity first, then by previous_path and file_path, each file once.

    First a pair that is the best of both its files is taken, and the pairs of taken files go. What is left, mostly of
    groups of near copies, falls into parts that share no file; each part is read in order by one task, which holds the
    names of its taken files.
    """
    best = lambda c: Window.partitionBy(c).orderBy(F.desc("similarity"), "previous_path", "file_path")
    all_ = written(pairs, "pairs")
    ranked = all_.withColumn("_a", F.row_number().over(best("previous_path"))).withColumn("_b", F.row_number().over(best("file_path")))
    now = written(ranked.where("_a = 1 AND _b = 1").drop("_a", "_b"), "renamed")
    left = all_.join(now.select("previous_path"), "previous_path", "left_anti").join(now.select("file_path"), "file_path", "left_anti").select(*pairs.columns)
    order, columns = ["_part", F.desc("similarity"), "previous_path", "file_path"], pairs.columns

    def greedy(batches):
        part, gone, new = None, set(), set()
        for b in batches:
            keep = []
            for own, p, q in zip(*(b.column(c).to_pylist() for c in ("_part", "previous_path", "file_path")), strict=True):
                if own != part:
                    part, gone, new = own, set(), set()
                free = p not in gone and q not in new
                keep.append(free)
                if free:
                    gone.add(p)
                    new.add(q)
            yield b.filter(pa.array(keep, pa.bool_())).select(columns)

    rest = _parts(left).repartition("_part").sortWithinPartitions(*order)
    return now.unionByName(rest.select("_part", *pairs.columns).mapInArrow(greedy, pairs.schema))


def _parts(pairs: DataFrame) -> DataFrame:
    """Pairs with _part, the least previous_path that can be reached over shared files: names spread until none changes."""
    now = pairs.withColumn("_part", F.col("previous_path"))
    while True:
        least = now.withColumn("_new", F.min("_part").over(Window.partitionBy("file_path")))
        step = written(least.withColumn("_new", F.min("_new").over(Window.partitionBy("previous_path"))), "parts")
        if step.where("_new <> _part").isEmpty():
            return step.drop("_new")
        now = step.drop("_part").withColumnRenamed("_new", "_part")


def diff_similar(base: DataFrame, target: DataFrame, path: str = "path", text: str = "text", least: float = 0.5) -> DataFrame:
    """action, file_path, previous_path, similarity: diff_manifest, whose added and deleted files that are alike are renames too.

    Equal contents pair first (similarity 1, in path order); null texts are empty, and empty files pair as equal ones.
    Modified files have no similarity.
    """
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    plain = written(diff_manifest(base.select(path, digest.alias("sha256")), target.select(path, digest.alias("sha256")), path), "manifest")
    gone = base.join(plain.where("action = 'deleted'").select(F.col("file_path").alias(path)), path, "left_semi")
    new = target.join(plain.where("action = 'added'").select(F.col("file_path").alias(path)), path, "left_semi")
    moved = written(one_to_one(similar_pairs(gone, new, path, text, least)), "moved")
    used = moved.select(F.lit("deleted").alias("action"), F.col("previous_path").alias("file_path")).union(moved.select(F.lit("added"), "file_path"))
    rest = plain.join(used, ["action", "file_path"], "left_anti").select("action", "file_path", "previous_path", F.when(F.col("action") == "renamed", 1.0).alias("similarity"))
    return rest.unionByName(moved.select(F.lit("renamed").alias("action"), "file_path", "previous_path", "similarity"))
