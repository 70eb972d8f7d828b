"""Keyed state with timers: leases that run out without a later event, duplicates that are forgotten after a while.

Both run on transformWithState: a key's state holds what is open, a timer of event time ends it when the watermark has
passed, and then the state is gone. State lives in RocksDB on the executors, and in the query's checkpoint.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def rocks(spark: SparkSession):
    """Queries that start within it keep their state in RocksDB, which timers need; the session's own choice comes back after."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def _due(micros: int) -> int:
    """The first millisecond that is not before it: timers count in these."""
    return -(-micros // 1000)


class Leases(StatefulProcessor):
    """A key's open leases (first, last, renewals). An event that comes less than gap after, or before, one renews it."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("leases", "first bigint, last bigint, n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = [tuple(x) for x in self.open.get()]
        out: list[tuple[int, int, int]] = []
        for first, last, n in sorted(before + [(r._t, r._t, 1) for r in rows]):  # late events may join two leases
            if out and first - out[-1][1] < self.gap:
                out[-1] = out[-1][0], max(out[-1][1], last), out[-1][2] + n
            else:
                out.append((first, last, n))
        old, new = self._next(before), self._next(out)
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(new)
        self.open.put(out)
        return iter(())

    def _next(self, leases: list[tuple[int, int, int]]) -> int | None:
        """When the first of a key's leases ends: its only timer, however many leases are open."""
        return min((_due(last + self.gap) for _, last, _ in leases), default=None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()  # all that it has passed ends at once
        held = [tuple(x) for x in self.open.get()]
        left = [x for x in held if _due(x[1] + self.gap) > now]
        if left:
            self.open.put(left)
            self.handle.registerTimer(self._next(left))
        else:
            self.open.clear()
        return iter([Row(key=key[0], expired=last + self.gap, renewals=n) for _, last, n in held if _due(last + self.gap) <= now])

    def close(self) -> None:
        pass


def lease_expiries(events: DataFrame, key: str, at: str, seconds: int, late: str) -> DataFrame:
    """key, expired_at and renewals of each lease that ran out: seconds passed after its last renewal, by the watermark.

    Events may come late, in any order and more than once, as long as they come within late: the leases are those of
    all of them in order of time. Null keys or times hold no lease. State is that of the open leases alone.
    """
    kind = events.schema[key].dataType
    own = events.withWatermark(at, late).where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key), F.col(at), F.unix_micros(at).alias("_t"))
    schema = T.StructType([T.StructField("key", kind), T.StructField("expired", T.LongType()), T.StructField("renewals", T.LongType())])
    out = own.groupBy(key).transformWithState(Leases(seconds * 1_000_000), schema, "Append", "EventTime")
    return out.select(F.col("key").alias(key), F.timestamp_micros("expired").alias("expired_at"), "renewals")


class Seen(StatefulProcessor):
    """The last time of a key; gone once nothing of it came for horizon."""

    def __init__(self, horizon: int, columns: list[str]):
        self.horizon, self.columns = horizon, columns

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = last = self.last.get()[0] if self.last.exists() else None
        out = []
        for r in sorted(rows, key=lambda r: r._t):
            if last is None or abs(r._t - last) > self.horizon:
                out.append(Row(**{c: r[c] for c in self.columns}))
            last = r._t if last is None else max(last, r._t)
        if last != before:
            if before is not None:
                self.handle.deleteTimer(_due(before + self.horizon) + 1)
            self.last.update((last,))
            self.handle.registerTimer(_due(last + self.horizon) + 1)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def once_within(events: DataFrame, keys: list[str], at: str, horizon: int, late: str) -> DataFrame:
    """At-least-once delivery to rows that come once: a row goes on if no row of its keys came in the horizon seconds before.

    It goes on at once, without waiting for the watermark. A redelivery renews the horizon. A key of which nothing came
    for that long, by the watermark, leaves the state and is new again. Rows of one time go on once.
    """
    columns = [f.name for f in events.schema]
    own = events.withWatermark(at, late).where(F.col(at).isNotNull()).withColumn("_t", F.unix_micros(at))
    return own.groupBy(*keys).transformWithState(Seen(horizon * 1_000_000, columns), events.schema, "Append", "EventTime")
