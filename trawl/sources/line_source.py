"""A data source of JSON lines: byte ranges that begin at line breaks, bad lines as rows, files pruned before they are read.

    spark.dataSource.register(JsonLines)
    spark.read.format("trawl_jsonl").option("glob", "*.jsonl").load("file:///data/sidecars")

A file of any size is many partitions: a range owns the lines that begin in it. A line that is cut off, is no JSON
object, or holds bytes that are no UTF-8 comes as a row like the others, with ok false and what is wrong, so failures
can be counted. Listing sees names and sizes alone; glob and exclude (of names), prefix (of paths) and mostBytes drop files there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "trawl_jsonl"
SCHEMA = "path string, at bigint, line string, ok boolean, problem string"
#: Bytes of a range, and of one read.
RANGE, READ = 32 << 20, 4 << 20


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _judge(raw: bytes) -> tuple[str, bool, str | None]:
    """The line's text, whether it is a JSON object, and what is wrong with it."""
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace"), False, "encoding"
    try:
        found = json.loads(text)
    except ValueError:
        return text, False, "json"
    except RecursionError:
        return text, False, "depth"
    return text, isinstance(found, dict), None if isinstance(found, dict) else "no object"


def lines_of(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in start..end, without their line break."""
    at = start
    if start:
        file.seek(start - 1)
        at, rest = start - 1, b""
        while True:  # to the end of the line that begins before the range
            block = file.read(READ)
            if not block:
                return
            k = block.find(b"\n")
            if k >= 0:
                at += k + 1
                break
            at += len(block)
        if at >= end:
            return
    file.seek(at)
    held = b""
    while True:
        block = file.read(READ)
        rest = held + block
        parts = rest.split(b"\n")
        for line in parts[:-1]:
            if at >= end:
                return
            yield at, line.removesuffix(b"\r")
            at += len(line) + 1
        held = parts[-1]
        if not block:
            if held and at < end:
                yield at, held.removesuffix(b"\r")
            return
        if at >= end:
            return


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.glob, self.exclude = options["path"], options.get("glob", "*"), options.get("exclude")
        self.most, self.size = int(options.get("mostbytes", options.get("mostBytes", 1 << 62))), int(options.get("range", RANGE))
        self.prefix = options.get("prefix", "")

    def _wanted(self, path: str, size: int) -> bool:
        name = path.rsplit("/", 1)[-1]
        if name.startswith((".", "_")) or not fnmatch(name, self.glob) or self.exclude and fnmatch(name, self.exclude) or size > self.most:
            return False
        return path.startswith(self.prefix)

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        store, base = _store(self.root)
        about = store.get_file_info(base)
        if about.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        found = [about] if about.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True))
        files = sorted((x.path, x.size) for x in found if x.type == fs.FileType.File)
        # a name at least, so that an empty listing is an empty table
        return [Range(p, a, min(a + self.size, n)) for p, n in files if self._wanted(p, n) for a in range(0, n, self.size)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = _store(self.root)
        rows: list[tuple] = []
        with store.open_input_file(partition.path) as file:
            for at, raw in lines_of(file, partition.start, partition.end):
                if raw.strip():
                    rows.append((partition.path, at, *_judge(raw)))
                if len(rows) >= 4096:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "at", "line", "ok", "problem"])


class JsonLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def read_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """path, at (the byte where it begins), line, ok, problem of each line that is not blank."""
    spark.dataSource.register(JsonLines)
    return spark.read.format(NAME).options(**{k: str(v) for k, v in options.items()}).load(path)


def read_sidecars(spark: SparkSession, path: str, schema: T.StructType, **options) -> DataFrame:
    """As files.read_tolerant: the fields of schema, and _bad (unreadable, or not ok). Each line is parsed for its fields by the JVM."""
    rows = read_lines(spark, path, **options).select(F.from_json("line", schema).alias("r"), "ok")
    fine = F.col("ok") & F.coalesce(F.col("r.ok"), F.lit(False)) if "ok" in schema.fieldNames() else F.col("ok")
    return rows.select("r.*", (~fine).alias("_bad"))
