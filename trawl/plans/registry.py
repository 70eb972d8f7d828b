"""Registered queries: a name, a function of (spark, sf_dir), and the same in DuckDB's SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: A source path for each document, in words that Spark and DuckDB both read.
PATH = """concat('src/', source, CASE doc_id % 8 WHEN 0 THEN '/tests/case_' WHEN 1 THEN '/api/user_' WHEN 2 THEN '/schema_' WHEN 3 THEN '/config_'
 WHEN 4 THEN '/View_' WHEN 5 THEN '/README_' WHEN 6 THEN '/run_' ELSE '/worker_' END, CAST(doc_id AS STRING),
 CASE doc_id % 8 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.prisma' WHEN 3 THEN '.json' WHEN 4 THEN '.tsx' WHEN 5 THEN '.md' WHEN 6 THEN '.sh' ELSE '.js' END)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_path(docs: DataFrame) -> DataFrame:
    return docs.withColumn("path", F.expr(PATH))


def joined(array) -> Column:
    """Arrays leave as text, which every engine compares alike."""
    return F.array_join(array, " ")
