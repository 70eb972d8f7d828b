"""Files, JSON lines and snapshots, all through Spark's own readers and writers."""

from __future__ import annotations

import subprocess
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.functions.paths import MOST_BYTES, source_file
from trawl.operators.incremental import upsert

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("chunk_id", "repo_slug", "file_path", "source_sha256", "text")])
CHANGE = T.StructType([*RECORD.fields, *(T.StructField(c, T.StringType()) for c in ("manifest_id", "action", "previous_path"))])
QUESTION = T.StructType(
    [*(T.StructField(c, T.StringType()) for c in ("id", "rel_path", "line_range", "content_hash", "hyde_version")), T.StructField("ok", T.BooleanType()), T.StructField("hyde_questions", T.ArrayType(T.StringType())), *(T.StructField(c, T.StringType()) for c in ("hyde_text", "model"))]
)
GOLDEN_ITEM = T.StructType([T.StructField("file", T.StringType()), T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), T.StructField("grade", T.IntegerType())])
GOLDEN = T.StructType([*(T.StructField(c, T.StringType()) for c in ("id", "query", "type")), T.StructField("relevant", T.ArrayType(GOLDEN_ITEM)), T.StructField("answer_files", T.ArrayType(T.StringType()))])


def tracked(spark: SparkSession, root: str) -> DataFrame | None:
    """The paths below root that git has in its index (a local work tree, listed by the driver); None where git lists nothing."""
    try:
        said = subprocess.run(["git", "-C", root.removeprefix("file://"), "ls-files", "--cached", "-z"], capture_output=True, check=True)
    except (OSError, subprocess.CalledProcessError):
        return None
    names = [x.decode("utf-8", "replace") for x in said.stdout.split(b"\0") if x]
    return spark.createDataFrame([(x,) for x in names], "path string") if names else None


def read_tree(spark: SparkSession, root: str, sources_only: bool = True, most_bytes: int = MOST_BYTES, listed: DataFrame | None = None) -> DataFrame:
    """path (below root), text, bytes, sha256 of every readable text file: not over most_bytes, valid UTF-8, no NUL, whole.

    listed (paths, as tracked gives them) keeps only those files; without it every file below root is taken.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(root)
    base = root.rstrip("/").split("://")[-1]
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:(//)?", ""), r"^/*" + base.lstrip("/").replace(".", r"\.") + "/", "")
    out = files.where(F.col("length") <= most_bytes).select(path.alias("path"), F.col("content").cast("string").alias("text"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    out = out.where(F.is_valid_utf8("text") & ~F.contains("text", F.lit("\0")))
    out = out if listed is None else out.join(listed.select("path"), "path", "left_semi")
    return out.where(source_file("path")) if sources_only else out


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Chunk records of a JSON-lines artifact; rows without all of chunk_id, repo_slug, file_path and text are dropped."""
    rows = spark.read.schema(RECORD).json(path)
    return rows.where(F.forall(F.array("chunk_id", "repo_slug", "file_path", "text"), lambda x: F.coalesce(x != "", F.lit(False))))


def read_changes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, tombstones) of an incremental artifact."""
    rows = spark.read.schema(CHANGE).json(path)
    gone = rows.where((F.col("action") == "tombstone") & F.col("file_path").isNotNull())
    kept = rows.where(~F.col("action").eqNullSafe("tombstone") & F.forall(F.array("chunk_id", "repo_slug", "file_path", "text"), lambda x: F.coalesce(x != "", F.lit(False))))
    return kept, gone.select("file_path", "manifest_id", "repo_slug")


def read_tolerant(spark: SparkSession, path: str, schema: T.StructType = QUESTION) -> DataFrame:
    """Side-car JSON lines: rows with _bad (unreadable, or not ok), so failures can be counted; blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.col("value"), F.from_json("value", schema).alias("r"), F.try_parse_json("value").isNull().alias("_broken"))
    ok = F.col("r.ok") if "ok" in schema.fieldNames() else F.lit(True)
    return parsed.select("r.*", (F.col("_broken") | ~F.coalesce(ok, F.lit(False))).alias("_bad"))


def read_chunks(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON list, an object with chunks, or JSON lines, by the file's name and shape."""
    if path.endswith(".jsonl"):
        return spark.read.schema(schema).json(path)
    wrapped = spark.read.schema(T.StructType([*schema.fields, T.StructField("chunks", T.ArrayType(schema))])).option("multiLine", "true").json(path)
    names = schema.fieldNames()
    inside = wrapped.where("chunks is not null").select(F.explode("chunks").alias("c")).select(*[F.col(f"c.{n}").alias(n) for n in names])
    return wrapped.where("chunks is null").select(*names).unionByName(inside)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden queries; the simple form (answer_files) becomes items of grade 1 without lines."""
    rows = spark.read.schema(GOLDEN).option("multiLine", "true").json(path)
    simple = F.transform("answer_files", lambda f: F.struct(f.alias("file"), F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"), F.lit(1).alias("grade")))
    return rows.select(F.coalesce("id", F.left(F.sha2("query", 256), F.lit(12))).alias("id"), "query", "type", F.coalesce("relevant", simple).alias("relevant"))


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def replace_json(df: DataFrame, path: str) -> None:
    """All or nothing, by Spark's commit protocol."""
    df.write.mode("overwrite").json(path)


def publish(df: DataFrame, path: str, partition: str | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).parquet(path)


def upsert_parquet(spark: SparkSession, path: str, target: str, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """The snapshot at path with incoming upserted, written to target (another path: a snapshot is never overwritten while it is read)."""
    if path.rstrip("/") == target.rstrip("/"):
        raise ValueError("the new snapshot needs a path of its own")
    upsert(spark.read.parquet(path), incoming, key, order).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def to_do(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose artifact does not exist yet."""
    return rows.join(done.select(key), key, "left_anti")


def shard_of(rows: DataFrame, ordinal: str, shards: int, shard: int) -> DataFrame:
    return rows.where(F.pmod(F.col(ordinal), F.lit(shards)) == shard)


def longest_prefix(paths: DataFrame, registry: DataFrame, path: str, root: str) -> DataFrame:
    """Each path with the registered project whose root is its longest prefix: joined on the path's own prefixes, not by comparing all pairs."""
    parts = F.split(F.col(path), "/")
    own = paths.withColumn("_r", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))))
    hit = own.join(registry, own["_r"] == registry[root]).drop("_r")
    return hit.groupBy(path).agg(F.max_by(F.struct(*registry.columns), F.length(root)).alias("_b")).select(path, "_b.*")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path in the folder that driver and executors share (spark.checkpoint.dir; a temporary one only in local mode)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        base = f"file://{tempfile.mkdtemp(prefix='trawl-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, safe against lost executors. The folder's owner removes it."""
    path = fresh_folder(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
