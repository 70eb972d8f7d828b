"""Event streams: windows, debounced file changes, duplicates, idempotent sinks, leases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.operators.incremental import upsert

#: How long a burst lasts, how many files a batch takes, how often one is tried.
DEBOUNCE, BATCH, TRIES = "500 milliseconds", 10, 3


def read_events(spark: SparkSession, path: str, at: str = "ts", files_per_batch: int = 100) -> DataFrame:
    """A Parquet folder or file as a stream, with at as a timestamp (watermarks refuse local ones)."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    rows = reader.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and not _is_folder(spark, path) else reader.parquet(path)
    return rows.withColumn(at, F.col(at).cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def windowed(events: DataFrame, at: str, group: list[str], width: str, late: str, slide: str | None = None, *aggs: Column) -> DataFrame:
    """Counts (and aggs) by window of event time; rows later than late are dropped."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    out = events.withWatermark(at, late).groupBy(w, *group).agg(F.count("*").alias("n"), *aggs)
    return out.select(F.col("window.start").alias("window_start"), *[c for c in out.columns if c != "window"])


def debounced(events: DataFrame, at: str, path: str, late: str, gap: str = DEBOUNCE) -> DataFrame:
    """One change for each burst of events of a path, which gap without another ends: its last time and how many it was."""
    s = events.withWatermark(at, late).groupBy(F.session_window(at, gap), path).agg(F.max(at).alias("changed"), F.count("*").alias("n"))
    return s.select(path, "changed", "n")


def queue_of(events: DataFrame, indexed: DataFrame, path: str, kind: str, at: str) -> DataFrame:
    """The queue that debounced events leave: path, added_at, retries.

    A path is queued once, from its first event that asks for it: any change, or an add of a path that is not indexed.
    An unlink takes it off the queue and off the index, so only later events count.
    """
    gone = events.groupBy(path).agg(F.max(F.when(F.col(kind) == "unlink", F.col(at))).alias("_gone"))
    known = indexed.select(F.col(path).alias("_p")).distinct()
    both = events.join(gone, path).join(known, F.col(path) == F.col("_p"), "left").where(F.col("_gone").isNull() | (F.col(at) > F.col("_gone")))
    wanted = (F.col(kind) == "change") | ((F.col(kind) == "add") & (F.col("_p").isNull() | F.col("_gone").isNotNull()))
    return both.where(wanted).groupBy(path).agg(F.min(at).alias("added_at")).withColumn("retries", F.lit(0))


def still_indexed(events: DataFrame, indexed: DataFrame, path: str, kind: str) -> DataFrame:
    return indexed.join(events.where(F.col(kind) == "unlink").select(path).distinct(), path, "left_anti")


def next_batch(queue: DataFrame, path: str, size: int = BATCH, paused: bool = False) -> DataFrame:
    """The files that wait longest; none while the watcher is paused."""
    return queue.orderBy("added_at", path).limit(0 if paused else size)


def after_batch(queue: DataFrame, outcomes: DataFrame, path: str, now, tries: int = TRIES) -> DataFrame:
    """The queue's files with their state after a batch (outcomes: path, ok): indexed, failed for good, or queued; a failure goes to the end."""
    both = queue.join(outcomes.select(F.col(path).alias("_p"), "ok"), F.col(path) == F.col("_p"), "left").drop("_p")
    failed = F.col("ok").isNotNull() & ~F.col("ok")
    out = both.withColumn("retries", F.col("retries") + failed.cast("int")).withColumn("added_at", F.when(failed, now).otherwise(F.col("added_at")))
    state = F.when(F.col("ok"), "indexed").when(failed & (F.col("retries") >= tries), "failed").otherwise("queued")
    return out.withColumn("state", state).drop("ok")


def once(events: DataFrame, at: str, keys: list[str], late: str) -> DataFrame:
    """At-least-once delivery to at-most-once rows, within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def run_once(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """All that is there now, then stop; the checkpoint remembers how far it came."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """The stream's rows in a Parquet folder, exactly once; the folder's own log keeps retried batches apart."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def upsert_sink(root: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a snapshot for each batch, of the last one and the batch's rows; a repeated batch writes the same again."""

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{root}/snapshot={number - 1}") if number else batch.limit(0)
        upsert(old, batch, key, order).write.mode("overwrite").parquet(f"{root}/snapshot={number}")

    return sink


def expired_leases(events: DataFrame, key: str, at: str, seconds: int, late: str) -> DataFrame:
    """Keys whose last renewal is over seconds older than the watermark: a session of renewals that has closed."""
    s = events.withWatermark(at, late).groupBy(F.session_window(at, f"{seconds} seconds"), key).agg(F.count("*").alias("renewals"))
    return s.select(key, F.col("session_window.end").alias("expired_at"), "renewals")


def snapshot_sink(root: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch in complete mode: each batch is a whole result and gets a folder of its own."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/snapshot={number:08d}")

    return sink


def last_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The newest snapshot's rows."""
    rows = spark.read.parquet(root)
    newest = rows.agg(F.max("snapshot").alias("n")).first()["n"]
    return rows.where(F.col("snapshot") == newest).drop("snapshot")
