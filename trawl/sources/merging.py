"""A table that is upserted at the cost of the change: a base, deltas over it, and a log of both.

A folder holds base-<n> and delta-<n>, each a Parquet folder by bucket of the key's hash, and _log, a small JSON file
for each commit. A commit exists once its log file does; the file is created, never overwritten, so of two writers of
the same number one fails and takes the next. An upsert writes its own rows and nothing else, a delete its keys. A
read takes the newest row of each key from the deltas, and from the base what no delta names: the base is not sorted,
and shuffled only if the deltas are too large to be sent to it. Compaction rewrites the buckets that deltas touch.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bookkeeping columns: bucket, commit, whether the row says that its key is gone.
OWN = ("__bucket__", "__commit__", "__gone__")


@dataclass
class MergeTable:
    spark: SparkSession
    root: str

    # the log

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def log(self) -> list[dict]:
        """The commits, oldest first: number, kind (base, delta), folder, buckets that it touches, and what the table is."""
        fs, p = self._fs(f"{self.root}/_log")
        if not fs.exists(p):
            return []
        names = sorted(s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().endswith(".json"))
        found = [json.loads(r[0]) for r in self.spark.read.text(names, wholetext=True).collect()] if names else []  # a line for each commit
        return sorted(found, key=lambda c: c["number"])

    def _commit(self, number: int, what: dict) -> bool:
        """Whether the commit was new; a file that is there already is left as it is."""
        fs, p = self._fs(f"{self.root}/_log/{number:012d}.json")
        try:
            out = fs.create(p, False)
        except Exception as e:  # the JVM's FileAlreadyExistsException, as py4j wraps it
            if "exist" in str(e).lower():
                return False
            raise
        out.write(bytearray(json.dumps({"number": number, **what}).encode()))
        out.close()
        return True

    def _head(self) -> dict:
        log = self.log()
        if not log:
            raise ValueError(f"no table at {self.root}")
        return log[0]

    # writing

    @staticmethod
    def create(rows: DataFrame, root: str, key: str, order: str, buckets: int = 64) -> MergeTable:
        """A new table of rows (one of each key: that of the largest order) at root."""
        table = MergeTable(rows.sparkSession, root)
        if table.log():
            raise ValueError(f"{root} holds a table")
        kept = _newest(rows, [key], [F.desc_nulls_last(order)])
        folder = table._written(kept.withColumn("__gone__", F.lit(False)), "base", 0, key, buckets)
        about = {"key": key, "order": order, "buckets": buckets, "schema": json.loads(rows.schema.json())}
        if not table._commit(0, {"kind": "base", "folders": {str(b): folder for b in range(buckets)}, "upto": 0, **about}):
            raise ValueError(f"{root} holds a table")
        return table

    def _written(self, rows: DataFrame, kind: str, number: int, key: str, buckets: int) -> str:
        folder = f"{kind}-{number}-{uuid.uuid4().hex}"
        own = rows.withColumns({"__bucket__": F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"), "__commit__": F.lit(number).cast("long"), "dir": F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")})
        own.repartition("dir").sortWithinPartitions("dir", key).write.partitionBy("dir").parquet(f"{self.root}/{folder}")
        return folder

    def _add(self, rows: DataFrame, commit: str | None) -> int:
        head, log = self._head(), self.log()
        if commit is not None and (done := [c["number"] for c in log if c.get("commit") == commit]):
            return done[0]
        number = log[-1]["number"] + 1
        folder = self._written(rows, "delta", number, head["key"], head["buckets"])
        touched = [r["dir"] for r in self._folder(folder).select(F.col("__bucket__").alias("dir")).distinct().collect()]  # as many as there are buckets
        while not self._commit(number, {"kind": "delta", "folder": folder, "touched": sorted(touched), **({"commit": commit} if commit is not None else {})}):
            number = self.log()[-1]["number"] + 1  # another writer was first
        return number

    def upsert(self, rows: DataFrame, commit: str | None = None) -> int:
        """Rows over those of their keys; of several of a key that of the largest order. Null keys are a key like any other.

        commit: a name under which the rows come once, however often they are sent. Returns the commit's number.
        """
        head = self._head()
        names = [f["name"] for f in head["schema"]["fields"]]
        kept = _newest(rows.select(*names), [head["key"]], [F.desc_nulls_last(head["order"])])
        return self._add(kept.withColumn("__gone__", F.lit(False)), commit)

    def delete(self, keys: DataFrame, commit: str | None = None) -> int:
        """Tombstones for keys (a column of the key's name); keys that are not there do no harm."""
        head = self._head()
        schema = T.StructType.fromJson(head["schema"])
        blank = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != head["key"] else F.col(f.name) for f in schema]
        return self._add(keys.select(head["key"]).distinct().select(*blank).withColumn("__gone__", F.lit(True)), commit)

    # reading

    def _schema(self) -> T.StructType:
        return T.StructType([*T.StructType.fromJson(self._head()["schema"]), T.StructField("__gone__", T.BooleanType()), T.StructField("__bucket__", T.IntegerType()), T.StructField("__commit__", T.LongType())])

    def _folder(self, *paths: str) -> DataFrame:
        there = [p for p in (f"{self.root}/{x}" for x in paths) if (f := self._fs(p))[0].exists(f[1])]
        if not there:
            return self.spark.createDataFrame([], self._schema())
        return self.spark.read.schema(self._schema()).parquet(*there)

    def _state(self, upto: int | None = None) -> tuple[dict, dict[str, str], list[dict]]:
        """The head, the base's folder of each bucket, and the deltas that are not compacted yet."""
        log = [c for c in self.log() if upto is None or c["number"] <= upto]
        if not log:
            raise ValueError(f"no table at {self.root}")
        bases = [c for c in log if c["kind"] == "base"]
        return log[0], bases[-1]["folders"], [c for c in log if c["kind"] == "delta" and c["number"] > bases[-1]["upto"]]

    def _base(self, folders: dict[str, str], of: list[int] | None = None) -> DataFrame:
        return self._folder(*(f"{f}/dir={b}" for b, f in folders.items() if of is None or int(b) in of))

    def _merged(self, base: DataFrame, deltas: list[dict], head: dict) -> DataFrame:
        if not deltas:
            return base
        key = head["key"]
        newest = _newest(self._folder(*(f"{d['folder']}/dir={b}" for d in deltas for b in d["touched"])), ["__bucket__", key], [F.desc("__commit__")])
        named = newest.select(F.col("__bucket__").alias("_b"), F.col(key).alias("_k"))
        rest = base.join(named, (F.col("__bucket__") == F.col("_b")) & F.col(key).eqNullSafe(F.col("_k")), "left_anti")
        return rest.unionByName(newest.where(~F.col("__gone__")))

    def read(self, upto: int | None = None) -> DataFrame:
        """The rows as of the newest commit, or of commit number upto (while its files are there)."""
        head, folders, deltas = self._state(upto)
        return self._merged(self._base(folders), deltas, head).drop(*OWN)

    def compact(self) -> int | None:
        """Folds the deltas into the buckets that they touch; the other buckets' files stay where they are. Returns the commit's number."""
        head, folders, deltas = self._state()
        if not deltas:
            return None
        number = self.log()[-1]["number"] + 1
        touched = sorted({b for d in deltas for b in d["touched"]})
        merged = self._merged(self._base(folders, touched), deltas, head).drop("__bucket__", "__commit__")
        folder = self._written(merged, "base", number, head["key"], head["buckets"])
        what = {"kind": "base", "folders": folders | {str(b): folder for b in touched}, "upto": deltas[-1]["number"]}
        while not self._commit(number, what):
            number = self.log()[-1]["number"] + 1  # deltas that came meanwhile have larger numbers than upto, and stay
        return number

    def vacuum(self) -> list[str]:
        """Deletes folders that neither the newest base nor an open delta names; returns them. No reader may be at an older commit."""
        _, folders, deltas = self._state()
        live = {*folders.values(), *(d["folder"] for d in deltas)}
        fs, p = self._fs(self.root)
        gone = [s.getPath() for s in fs.listStatus(p) if s.isDirectory() and s.getPath().getName() != "_log" and s.getPath().getName() not in live]
        names = [g.getName() for g in gone]
        for g in gone:
            fs.delete(g, True)
        return names

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: a delta for each micro-batch; a batch that is sent again is there already."""
        return lambda batch, number: self.upsert(batch, commit=f"batch-{number}") and None


def _newest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    own = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")
