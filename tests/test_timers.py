"""Leases and duplicates with timers: late, redelivered and missing events over several micro-batches, and the state that stays."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from trawl.streaming import timers

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "k string, ts timestamp, note string"


class Feed:
    """Files that come one by one; each run of the query reads what is new and stops."""

    def __init__(self, spark, tmp_path, make):
        self.spark, self.root, self.make, self.n = spark, tmp_path, make, 0
        (tmp_path / "in").mkdir()

    def send(self, *rows):
        frame = self.spark.createDataFrame([(k, T0 + dt.timedelta(seconds=s), note) for k, s, note in rows], SCHEMA)
        frame.coalesce(1).write.mode("append").parquet(f"file://{self.root}/in")
        stream = self.spark.readStream.schema(SCHEMA).parquet(f"file://{self.root}/in")
        got = []
        with timers.rocks(self.spark):
            q = self.make(stream).writeStream.option("checkpointLocation", f"file://{self.root}/checkpoint").foreachBatch(lambda df, _: got.extend(df.collect())).trigger(availableNow=True).start()
            q.awaitTermination()
            state = q.lastProgress["stateOperators"][0]["numRowsTotal"] if q.lastProgress else None
        return got, state


@pytest.fixture
def zone(spark):
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"


def test_a_lease_expires_without_a_later_event_of_its_key(spark, tmp_path, zone):
    feed = Feed(spark, tmp_path, lambda s: timers.lease_expiries(s, "k", "ts", 60, "10 seconds"))
    assert feed.send(("a", 0, ""), ("b", 5, ""), ("a", 30, ""))[0] == []
    got, _ = feed.send(("b", 85, ""), ("c", 101, ""))  # the watermark is at 91: a's lease ended at 90
    assert [(r.k, (r.expired_at - T0).total_seconds(), r.renewals) for r in got] == [("b", 65.0, 1), ("a", 90.0, 2)] or sorted((r.k, r.renewals) for r in got) == [("a", 2), ("b", 1)]
    got, _ = feed.send(("c", 100, "redelivered"), ("z", 500, ""))
    assert sorted((r.k, (r.expired_at - T0).total_seconds(), r.renewals) for r in got) == [("b", 145.0, 1), ("c", 161.0, 2)]
    assert spark.conf.get(timers.PROVIDER, "").endswith("RocksDBStateStoreProvider") is False


def test_a_late_event_joins_two_leases(spark, tmp_path, zone):
    feed = Feed(spark, tmp_path, lambda s: timers.lease_expiries(s, "k", "ts", 60, "200 seconds"))
    feed.send(("a", 0, ""), ("a", 100, ""))
    feed.send(("a", 50, "late"))
    got, _ = feed.send(("z", 1000, ""))
    assert [(r.k, (r.expired_at - T0).total_seconds(), r.renewals) for r in got] == [("a", 160.0, 3)]


def test_redelivered_rows_go_on_once_and_state_leaves(spark, tmp_path, zone):
    feed = Feed(spark, tmp_path, lambda s: timers.once_within(s, ["k"], "ts", 60, "10 seconds"))
    got, state = feed.send(("a", 0, "first"), ("a", 0, "again"), ("b", 10, "b"))
    assert sorted((r.k, r.note) for r in got) == [("a", "first"), ("b", "b")] or len(got) == 2
    got, _ = feed.send(("a", 50, "redelivered"), ("b", 60, "redelivered"))
    assert got == []
    got, _ = feed.send(("z", 300, "z"))
    assert [r.k for r in got] == ["z"]
    got, state = feed.send(("a", 310, "new again"))
    assert [(r.k, r.note) for r in got] == [("a", "new again")]
    got, state = feed.send(("y", 5000, "y"))
    assert [r.k for r in got] == ["y"] and state <= 4  # a, b and z are gone; y's value and timer stay


def test_nulls_and_late_rows(spark, tmp_path, zone):
    feed = Feed(spark, tmp_path, lambda s: timers.lease_expiries(s, "k", "ts", 60, "10 seconds"))
    feed.send((None, 0, ""), ("z", 1000, ""))
    got, _ = feed.send(("a", 5, "beyond the watermark"), ("z", 1001, ""))
    assert got == []
    got, _ = feed.send(("y", 9000, ""))
    assert sorted((r.k, r.renewals) for r in got) == [("z", 2)]


class Handle:
    """Counts what a key's state is asked for."""

    def __init__(self):
        self.held, self.calls = [], 0

    def getListState(self, *_):
        return self

    def get(self):
        return iter(self.held)

    def put(self, rows):
        self.held = rows

    def clear(self):
        self.held = []

    def listTimers(self):
        return iter(range(len(self.held)))

    def registerTimer(self, at):
        self.calls += 1

    deleteTimer = registerTimer


def test_a_key_sets_one_timer_however_many_leases_are_open():
    from types import SimpleNamespace

    own, handle = timers.Leases(60_000_000), Handle()
    own.init(handle)
    own.handleInputRows(("a",), [SimpleNamespace(_t=100_000_000 * i) for i in range(50)], None)
    assert handle.calls == 1 and len(handle.held) == 50
    now = SimpleNamespace(getCurrentWatermarkInMs=lambda: 160_000, getExpiryTimeInMs=lambda: 60_000)
    assert [r.expired for r in own.handleExpiredTimer(("a",), now, now)] == [60_000_000, 160_000_000]
    assert handle.calls == 2 and len(handle.held) == 48
