"""Calls to models in batches: bounded parallelism, retries with back-off, halving, fallback texts, durable shards."""

from __future__ import annotations

import random
import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RETRIES, FIRST_WAIT, LONGEST_WAIT = 5, 2.0, 60.0


def retried(call: Callable, tries: int = RETRIES, first: float = FIRST_WAIT, most: float = LONGEST_WAIT, base: float = 2.0, jitter: float = 0.1, retry_if: Callable[[Exception], bool] = lambda e: True, sleep: Callable[[float], None] = time.sleep):
    """call(), again after first * base^n seconds (most at most, plus some jitter) while it fails with what retry_if accepts."""
    for n in range(tries):
        try:
            return call()
        except Exception as e:
            if n == tries - 1 or not retry_if(e):
                raise
            sleep(min(most, first * base**n) * (1 + jitter * random.random()))


def with_fallback(first: Callable, second: Callable, quota: Callable[[Exception], bool]) -> Callable:
    """Calls first; once it fails for want of quota, second, for good."""
    state = {"call": first}

    def call(*args):
        try:
            return state["call"](*args)
        except Exception as e:
            if state["call"] is second or not quota(e):
                raise
            state["call"] = second
            return second(*args)

    return call


def halved(texts: list[str], embed: Callable[[list[str]], list], fallback: Callable[[str], str]) -> list:
    """embed(texts); where that fails its halves in turn, and for a single text its fallback."""
    try:
        return embed(texts)
    except Exception:
        if len(texts) <= 1:
            return embed([fallback(t) for t in texts])
        mid = len(texts) // 2
        return halved(texts[:mid], embed, fallback) + halved(texts[mid:], embed, fallback)


def fallback_of(text: str) -> str:
    """The same as functions.text.fallback_text, on the executor."""
    import hashlib

    return f"Embedding fallback for code-search chunk.\nOriginal text sha256: {hashlib.sha256(text.encode('utf-8', 'replace')).hexdigest()}\nPreview:\n{text[:1000]}"


def embed(df: DataFrame, id_col: str, text_col: str, model: Callable[[], Callable[[list[str]], list]], parallel: int, batch: int = 32, tries: int = RETRIES) -> DataFrame:
    """id and embedding of each text; parallel tasks at most, batch texts a call. model() opens a connection, once for each task."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        call = model()
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                part = b.slice(lo, batch)
                texts = [t or "" for t in part.column("_text").to_pylist()]
                found = halved(texts, lambda x: retried(lambda: call(x), tries), fallback_of)
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(found, pa.list_(pa.float64()))], [id_col, "embedding"])

    return df.select(id_col, F.col(text_col).alias("_text")).repartition(parallel).mapInArrow(run, f"{id_col} {kind}, embedding array<double>")


def valid_batches(rows: DataFrame, batch: str, most: int, *texts: str) -> DataFrame:
    """Per batch: rows, invalid (a null or empty text) and ok: 1 to most rows, none invalid."""
    bad = ~F.forall(F.array(*[F.coalesce(F.col(t), F.lit("")) for t in texts]), lambda x: x != "")
    g = rows.groupBy(batch).agg(F.count("*").alias("rows"), F.count_if(bad).alias("invalid"))
    return g.withColumn("ok", (F.col("rows") <= most) & (F.col("invalid") == 0))


#: How a shard's status may move, and what a job's shards make of it.
MOVES = {"pending": ("running",), "running": ("done", "failed", "running"), "failed": ("running",), "done": ()}


def applied(shards: DataFrame, events: DataFrame, job: str, seq: str, at: str) -> DataFrame:
    """Shards after their events in order of time: a move that MOVES does not list is ignored, so repeated deliveries do no harm.

    status, attempts (times it ran) and output (of the first event that ended it well).
    """
    table = {a: set(b) for a, b in MOVES.items()}
    kinds = ", ".join(f"{c} {shards.schema[c].dataType.simpleString()}" for c in (job, seq))
    both = shards.select(job, seq, F.lit(None).cast("timestamp").alias(at), F.lit("pending").alias("event"), F.lit(None).cast("string").alias("output"))
    both = both.unionByName(events.select(job, seq, at, "event", "output")).repartition(job, seq).sortWithinPartitions(job, seq, F.asc_nulls_first(at))

    def run(batches):
        key, state, types = None, None, None
        rows: list = []
        for b in batches:
            types = [b.schema.field(c).type for c in (job, seq)]
            for r in b.to_pylist():
                if (r[job], r[seq]) != key:
                    if state:
                        rows.append((*key, *state))
                    key, state = (r[job], r[seq]), ["pending", 0, None]
                if r["event"] in table[state[0]]:
                    state = [r["event"], state[1] + (r["event"] == "running"), r["output"] if r["event"] == "done" else state[2]]
            if len(rows) > 4096:
                yield _rows(rows, types)
                rows = []
        if state:
            rows.append((*key, *state))
        if rows:
            yield _rows(rows, types)

    def _rows(rows, types):
        c = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c[0], types[0]), pa.array(c[1], types[1]), pa.array(c[2], pa.string()), pa.array(c[3], pa.int32()), pa.array(c[4], pa.string())], [job, seq, "status", "attempts", "output"])

    return both.mapInArrow(run, f"{kinds}, status string, attempts int, output string")


def committed(shards: DataFrame, job: str, expected: DataFrame) -> DataFrame:
    """Jobs that have exactly the shards they announced (expected), and whether all are done."""
    g = shards.groupBy(job).agg(F.countDistinct("seq").alias("shards"), F.count_if(F.col("status") == "done").alias("done"))
    return expected.join(g, job, "left").select(job, "expected", F.coalesce("shards", F.lit(0)).alias("shards"), (F.coalesce("shards", F.lit(0)) == F.col("expected")).alias("complete"), F.coalesce(F.col("done") == F.col("expected"), F.lit(False)).alias("done"))


def valid_golden(queries: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """Golden queries whose relevant files all exist, the first of each question, with ids of their own."""
    each = queries.select("query", F.explode("relevant").alias("r")).select("query", F.col("r.file").alias("f"))
    missing = each.join(files.select(F.col(path).alias("f")), "f", "left_anti").select("query").distinct()
    kept = queries.where(F.size("relevant") > 0).join(missing, "query", "left_anti")
    own = Window.partitionBy(F.lower(F.trim("query"))).orderBy("query")
    return kept.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n").withColumn("id", F.concat(F.lit("golden-"), F.left(F.sha2("query", 256), F.lit(12))))


def drop_rate(generated: DataFrame, valid: DataFrame) -> DataFrame:
    """One row: generated, valid and the share that went."""
    return generated.agg(F.count("*").alias("generated")).join(valid.agg(F.count("*").alias("valid")), F.lit(True)).withColumn("drop_rate", F.round(1 - F.col("valid") / F.greatest("generated", F.lit(1)), 6))
