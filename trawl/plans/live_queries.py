"""What keeps an index alive: keyed timers, upserts by deltas, exact ranks over all rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trawl.operators import jobs, ordered
from trawl.plans.index_queries import _snapshots, _stream
from trawl.plans.registry import ORACLES, load, query
from trawl.sources import files, line_source
from trawl.sources.files import fresh_folder
from trawl.sources.merging import MergeTable
from trawl.streaming import timers, watch


@query("lease_timers", ORACLES["stateful_lease"])
def lease_timers(spark, sf):
    """Leases that ran out, each by a timer of its own, an hour behind the last event."""
    events, folder = _stream(spark, sf)
    with timers.rocks(spark):
        out = watch.to_table(timers.lease_expiries(events, "user_id", "ts", 600, "1 hour"), f"{folder}/out", f"{folder}/checkpoint")
    return out.select("user_id", F.col("expired_at").cast("timestamp_ntz").alias("expired_at"), "renewals")


@query("dedupe_timers", "SELECT user_id, event_type, ts FROM (SELECT user_id, event_type, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS before FROM events) WHERE before IS NULL OR ts - before > INTERVAL 6 HOUR")
def dedupe_timers(spark, sf):
    """Events of a user and type that did not come in the six hours before; the state forgets what is older."""
    events, folder = _stream(spark, sf)
    own = events.select("user_id", "event_type", "ts")
    with timers.rocks(spark):
        out = watch.to_table(timers.once_within(own, ["user_id", "event_type"], "ts", 6 * 3600, "1 hour"), f"{folder}/out", f"{folder}/checkpoint")
    return out.select("user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("merge_on_read", ORACLES["upsert_latest"])
def merge_on_read(spark, sf):
    """upsert_latest from a base and a delta: the old rows are not written again."""
    old, new = _snapshots(spark, sf)
    own = lambda df, name: df.withColumn("origin", F.lit(name)).select("doc_id", "start_line", "origin")
    table = MergeTable.create(own(old, "old"), fresh_folder(spark, f"merging-{uuid.uuid4().hex}"), "doc_id", "start_line", 8)
    table.upsert(own(new, "new"))
    return table.read().select("doc_id", "origin")


@query("latency_quantiles", "SELECT event_type, p, value FROM (SELECT event_type, unnest([0.5, 0.9, 0.95, 0.99])::DOUBLE AS p, unnest(quantile_disc(value, [0.5, 0.9, 0.95, 0.99])) AS value FROM events GROUP BY 1)")
def latency_quantiles(spark, sf):
    """Nearest-rank quantiles by selection in rounds: no group's values pass one buffer."""
    return ordered.quantiles(load(spark, sf, "events"), ["event_type"], "value", [0.5, 0.9, 0.95, 0.99]).select("event_type", "p", "value")


@query("price_places", "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS place FROM lineitem")
def price_places(spark, sf):
    """A place for each row of the whole table, without one task for all."""
    x = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return ordered.numbered(x, [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]).drop("l_extendedprice")


@query(
    "anchored_one_user",
    """WITH RECURSIVE e AS (SELECT epoch_us(ts) // 1000 AS t FROM events), r(a, batch) AS (SELECT min(t), 0::BIGINT FROM e UNION ALL SELECT min(e.t), r.batch + 1 FROM r JOIN e ON e.t > r.a + 21600000 GROUP BY r.batch)
 SELECT batch, count(*) AS size, min(t) AS first_ms, max(t) AS last_ms, max(t) - min(t) AS spread_ms FROM (SELECT r.batch, e.t FROM r JOIN e ON e.t >= r.a AND e.t <= r.a + 21600000) GROUP BY 1""",
)
def anchored_one_user(spark, sf):
    """Batches of six hours, each from its own first event, with all events under one user."""
    e = load(spark, sf, "events").select(F.lit(1).alias("user"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t"))
    return jobs.anchored_in_parallel(e, "user", "t", 21_600_000).drop("user")


@query("sidecar_ranges", "SELECT CASE WHEN doc_id % 6 IN (1, 2) THEN 'bad' ELSE doc_id::VARCHAR END AS id, count(*) AS n, sum(CASE WHEN doc_id % 6 = 2 THEN 0 ELSE length(text) END)::BIGINT AS chars FROM documents WHERE doc_id % 6 <> 0 GROUP BY 1")
def sidecar_ranges(spark, sf):
    """Side-car lines with whole texts, some blank, cut off or not ok, read by byte ranges of the files."""
    i, folder = F.col("doc_id"), fresh_folder(spark, f"sidecar-{uuid.uuid4().hex}")
    good = F.to_json(F.struct(i.cast("string").alias("id"), (i % 6 != 1).alias("ok"), F.array("text").alias("hyde_questions")))
    line = F.when(i % 6 == 0, "  ").when(i % 6 == 2, F.left(good, F.length(good) - 3)).otherwise(good)
    load(spark, sf, "documents").select(line.alias("value")).write.text(folder)
    rows = line_source.read_sidecars(spark, folder, files.QUESTION, glob="part-*", range=1 << 20)
    chars = F.coalesce(F.length(F.get("hyde_questions", F.lit(0))), F.lit(0))
    return rows.groupBy(F.when(F.col("_bad"), "bad").otherwise(F.col("id")).alias("id")).agg(F.count("*").alias("n"), F.sum(chars).alias("chars"))
