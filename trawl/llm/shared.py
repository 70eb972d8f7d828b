"""What the operators of this subpackage share: the shared folder, written tables, word scanning."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
import tempfile
import threading
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A word of the contracts: a run of anything but space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
_WORD = re.compile(WORD)


def words(text: str | None) -> list[str]:
    return _WORD.findall(text) if text else []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='trawl-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/trawl-{name}-{uuid.uuid4().hex}"


_noted = threading.local()


@contextlib.contextmanager
def noting(paths: list[str]):
    """Within it, this thread's written tables add their paths to paths."""
    before, _noted.paths = getattr(_noted, "paths", None), paths
    try:
        yield
    finally:
        _noted.paths = before


def note(path: str) -> None:
    if (paths := getattr(_noted, "paths", None)) is not None:
        paths.append(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes written tables that nothing reads any more."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    paths.clear()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, its lineage cut, safe against lost executors.

    The table stays until the owner of the folder removes it, as the returned DataFrame reads it.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    note(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def carried(docs: DataFrame, keep: list[str] | None, produced: tuple[str, ...]) -> list[str]:
    """The columns to carry: keep, or all but those whose names (case apart) the operator's own results take."""
    own = {p.lower() for p in produced}
    return list(keep) if keep is not None else [c for c in docs.columns if c.lower() not in own]


def boxed(docs: DataFrame, keep: list[str]) -> tuple[list, list[str]]:
    """keep as columns under names of our own, so that no name of the caller's meets an inner one, and these names."""
    own = [f"kept_{i}" for i in range(len(keep))]
    return [docs[f"`{c}`"].alias(k) for c, k in zip(keep, own, strict=True)], own


def unboxed(df: DataFrame, keep: list[str], rest: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """The columns of boxed under the caller's names, then rest."""
    return df.select(*(df[f"kept_{i}"].alias(c) for i, c in enumerate(keep)), *rest)


def small_batches(spark: SparkSession, rows: int = 512, size: str = "16m") -> None:
    """Arrow batches of so few rows and bytes that they fit a Python worker many times over.

    These are options of the session, as Spark has none for a plan alone; smaller ones that are set already stay.
    """
    held = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < held <= rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def lean(run):
    """A function over Arrow batches whose Python worker gives the memory of its task back, as workers live on idle."""

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return task


def in_chunks(batches: Iterable[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until their column holds size bytes; empty ones go."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.column(column).nbytes
        if n >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def blocks(batches: Iterable[pa.RecordBatch], key: str, least: int) -> Iterator[pa.Table]:
    """Batches sorted by key as tables of least rows or more that end where key changes."""
    held, n, wanted = [], 0, least
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= wanted:
            whole = pa.Table.from_batches(held).combine_chunks()
            k = whole.column(key).to_numpy()
            other = np.flatnonzero(k != k[-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield whole.slice(0, cut)
            held, n = whole.slice(cut).to_batches(), n - cut
            wanted = max(least, 2 * n)  # a key with very many rows is put together a few times only
    if n:
        yield pa.Table.from_batches(held).combine_chunks()
