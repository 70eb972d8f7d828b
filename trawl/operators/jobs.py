"""Jobs and shards: progress, statuses, leases, claims, throughput."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.operators.ordered import numbered
from trawl.sources.files import written

LEASE_SECONDS, GAP_MS, PER_CHUNK = 600, 300, 12


def progress(chunks: DataFrame, job: str, totals: DataFrame) -> DataFrame:
    """Active rows of each job and the status that follows; counted, never incremented, so redelivery does no harm."""
    done = chunks.groupBy(job).agg(F.count_if("active").alias("published"))
    out = totals.join(done, job, "left").withColumn("published", F.coalesce("published", F.lit(0)))
    return out.withColumn("status", F.when(F.col("published") >= F.col("total"), "published").otherwise("publishing"))


def shard_status(done, errors) -> Column:
    return F.when(F.col(errors) == 0, "published").when(F.col(done) > 0, "partial").otherwise("failed")


def rollup(shards: DataFrame, job: str) -> DataFrame:
    out = shards.groupBy(job).agg(F.sum("done").alias("done"), F.sum("errors").alias("errors"), F.count("*").alias("shards"))
    return out.withColumn("status", shard_status("done", "errors"))


def assign(rows: DataFrame, ordinal: str, shards: int, accounts: int, batch: int) -> DataFrame:
    """Round-robin shard and account, and the batch within the order."""
    shard = F.pmod(F.col(ordinal), F.lit(shards))
    return rows.withColumn("shard", shard.cast("int")).withColumn("account", F.pmod(shard, F.lit(accounts)).cast("int")).withColumn("batch", F.floor(F.col(ordinal) / batch).cast("long"))


def claimable(shards: DataFrame, status: str, leased_at: str, now, seconds: int = LEASE_SECONDS) -> DataFrame:
    """Shards that are pending, or running under a lease that has run out."""
    expired = (F.col(status) == "running") & (F.unix_micros(now) - F.unix_micros(leased_at) > seconds * 1_000_000)
    return shards.where((F.col(status) == "pending") | expired)


def claim(work: DataFrame, done: str, index: str, shards: int, shard: int, limit: int) -> DataFrame:
    """A shard's next items that are not done."""
    return work.where(~F.col(done) & (F.pmod(F.col(index), F.lit(shards)) == shard)).orderBy(index).limit(limit)


def claims_done(generated, total, per_chunk: int = PER_CHUNK) -> Column:
    """Whether a poller of claims stops: as many questions as the chunks call for are there."""
    return F.col(generated) >= F.col(total) * per_chunk


def summed(shards: DataFrame, job: str, counters: str) -> DataFrame:
    """Per job the sums of all fields of a struct of counters (null: none), and its shards."""
    fields = shards.schema[counters].dataType.names
    return shards.groupBy(job).agg(F.count("*").alias("shards"), *(F.sum(F.coalesce(F.col(f"{counters}.{f}"), F.lit(0))).alias(f) for f in fields))


def fan_out(shards: DataFrame, job: str, side: str = "side", done: str = "done", errors: str = "errors") -> DataFrame:
    """Jobs whose code and question shards ran side by side: what each side completed, whether it is live or partial, and the job's status.

    A shard without a result (done is null) failed as a whole: one error, nothing done. Only two live sides publish.
    """
    failed = F.col(done).isNull()
    count = lambda name, value: F.sum(F.when(F.col(side) == name, value).otherwise(0))
    lost = F.when(failed, F.lit(1)).otherwise(F.coalesce(errors, F.lit(0)))
    made = F.when(failed, F.lit(0)).otherwise(F.col(done))
    out = shards.groupBy(job).agg(count("code", made).alias("completed"), count("hyde", made).alias("hyde_completed"), count("code", lost).alias("_c"), count("hyde", lost).alias("_h"))
    live = lambda c: F.when(F.col(c) == 0, "live").otherwise("partial")
    status = F.when((F.col("_c") == 0) & (F.col("_h") == 0), "published").otherwise("partial")
    return out.select(job, live("_c").alias("code_status"), live("_h").alias("hyde_status"), "completed", "hyde_completed", status.alias("status"))


def throughput(events: DataFrame, group: list[str], at: str, value: str) -> DataFrame:
    """Events a second between the first and the last, and the spread of a value, by group."""
    wall = (F.unix_micros(F.max(at)) - F.unix_micros(F.min(at))) / 1e6
    out = events.groupBy(*group).agg(F.count("*").alias("n"), wall.alias("wall"), F.min(value).alias("least"), F.max(value).alias("most"), F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})").alias("p50"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"))
    return out.withColumn("per_second", F.round(F.when(F.col("wall") > 0, F.col("n") / F.col("wall")), 6)).drop("wall")


def sweep_rank(cells: DataFrame, rate: str, complete) -> DataFrame:
    """Parameter cells that completed, fastest first, with their place; ties by the other columns."""
    return numbered(cells.where(complete), [F.desc(rate), *[F.col(c) for c in cells.columns if c != rate]])


def anchored_batches(events: DataFrame, group: str, at_ms: str, gap: int = GAP_MS) -> DataFrame:
    """Batches of a group: an event opens one when it comes over gap after the first of the last. size, first_ms, last_ms, spread_ms.

    Not a session: the anchor is the batch's first event. Events of a group stream by in time order, none is held.
    """
    kind = events.schema[group].dataType.simpleString()
    own = events.select(group, F.col(at_ms).cast("long").alias("t")).repartition(group).sortWithinPartitions(group, "t")

    def run(batches):
        state, k, group_type = None, 0, None
        rows: list[tuple] = []
        for b in batches:
            group_type = b.schema.field(group).type
            for g, t in zip(b.column(group).to_pylist(), b.column("t").to_pylist(), strict=True):
                if state is None or g != state[0] or t - state[2] > gap:
                    if state is not None:
                        rows.append((*state, k))
                    k = k + 1 if state is not None and g == state[0] else 0
                    state = [g, 0, t, t]
                state[1] += 1
                state[3] = t
            if len(rows) > 4096:
                yield _batches(rows, group, group_type)
                rows = []
        if state is not None:
            rows.append((*state, k))
        if rows:
            yield _batches(rows, group, group_type)

    out = own.mapInArrow(run, f"{group} {kind}, size bigint, first_ms bigint, last_ms bigint, batch bigint")
    return out.withColumn("spread_ms", F.col("last_ms") - F.col("first_ms"))


def _batches(rows, group, kind) -> pa.RecordBatch:
    c = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c[0], kind), *(pa.array(x, pa.int64()) for x in c[1:])], [group, "size", "first_ms", "last_ms", "batch"])


def anchored_in_parallel(events: DataFrame, group: str, at_ms: str, gap: int = GAP_MS) -> DataFrame:
    """As anchored_batches, where a group of any size is many tasks: size, first_ms, last_ms, batch, spread_ms.

    Events are numbered in order. The event that would open the batch after one that an event opens is found by its
    place among all events and all times of events plus gap. Which of these chains start at a group's first event is
    found by doubling: each round follows twice as many batches at once. Null times take no part.
    """
    own = events.select(F.col(group).alias("g"), F.col(at_ms).cast("long").alias("t")).where(F.col("t").isNotNull())
    rows = written(numbered(own, [F.col("g"), F.col("t")], "i"), "events")
    ends = written(rows.groupBy("g").agg(F.min("i").alias("first"), F.max("i").alias("last")), "groups").withColumnRenamed("g", "_g")
    keys = rows.select("g", F.col("t").alias("key"), F.lit(0).alias("kind"), "i").unionByName(rows.select("g", (F.col("t") + gap).alias("key"), F.lit(1).alias("kind"), "i"))
    # The i-th of the later times comes after i - 1 others and all events that are not after it.
    placed = numbered(keys, [F.col("g"), F.col("key"), F.col("kind"), F.col("i")], "p").where("kind = 1").withColumn("next", F.col("p") - F.col("i") + 1)
    inside = placed.join(ends, F.col("g").eqNullSafe(F.col("_g"))).where("next <= last")
    after = jump = written(inside.select("i", "next"), "next")
    marks = written(ends.select(F.col("first").alias("i")), "anchors")
    while True:
        more = written(marks.join(jump, "i").select(F.col("next").alias("i")).distinct(), "anchors")
        if more.isEmpty():
            break
        marks = written(marks.union(more).distinct(), "anchors")
        jump = written(jump.select("i", F.col("next").alias("_n")).join(jump.select(F.col("i").alias("_n"), "next"), "_n").select("i", "next"), "next")
    named = marks.join(rows, "i").join(after, "i", "left").join(ends, F.col("g").eqNullSafe(F.col("_g"))).withColumn("end", F.coalesce("next", F.col("last") + 1))
    placed = numbered(named.select("i", "g", "t", "end"), [F.col("i")], "a")
    least = placed.groupBy(F.col("g").alias("_g")).agg(F.min("a").alias("_a"))
    closing = rows.select(F.col("i").alias("_i"), F.col("t").alias("last_ms"))
    out = placed.join(least, F.col("g").eqNullSafe(F.col("_g"))).join(closing, F.col("end") - 1 == F.col("_i"))
    return out.select(F.col("g").alias(group), (F.col("end") - F.col("i")).alias("size"), F.col("t").alias("first_ms"), "last_ms", (F.col("a") - F.col("_a")).alias("batch"), (F.col("last_ms") - F.col("t")).alias("spread_ms"))
