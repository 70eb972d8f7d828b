"""Keeping an index up to date: plans, manifests, upserts, guards, checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_DELETED = 0.20


def plan(existing: DataFrame, current: DataFrame, key: str, versions: list[str], lines: list[str]) -> DataFrame:
    """key and action: insert, delete, reindex (a version differs), backfill (only lines differ) or skip."""
    a, b = existing.alias("a"), current.alias("b")
    same = lambda cols: F.forall(F.array(*[F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in cols]), lambda x: x)
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    action = F.when(F.col(f"a.{key}").isNull(), "insert").when(F.col(f"b.{key}").isNull(), "delete").when(~same(versions), "reindex").when(~same(lines), "backfill").otherwise("skip")
    return joined.select(F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key), action.alias("action"))


def stale(existing: DataFrame, current: DataFrame, key: str) -> DataFrame:
    return existing.select(key).join(current.select(key), key, "left_anti")


def delete_guard(existing: DataFrame, current: DataFrame, key: str, most: float = MOST_DELETED) -> DataFrame:
    """One row: existing, stale, share, allowed; refused only above the limit."""
    n = existing.agg(F.count("*").alias("existing"))
    s = stale(existing, current, key).agg(F.count("*").alias("stale"))
    share = F.when(F.col("existing") > 0, F.col("stale") / F.col("existing")).otherwise(0.0)
    return n.join(s, F.lit(True)).select("existing", "stale", F.round(share, 6).alias("share"), (share <= most).alias("allowed"))


def guarded_stale(existing: DataFrame, current: DataFrame, key: str, most: float = MOST_DELETED) -> DataFrame:
    """The stale keys, or an error where there are too many."""
    if not delete_guard(existing, current, key, most).first()["allowed"]:
        raise ValueError(f"more than {most:.0%} of the index would go")
    return stale(existing, current, key)


def diff_manifest(base: DataFrame, target: DataFrame, path: str = "path", digest: str = "sha256") -> DataFrame:
    """action (added, modified, deleted, renamed), file_path, previous_path: a rename is one added file with a deleted one's content; equal contents pair in path order."""
    a = base.select(F.col(path).alias("_p"), F.col(digest).alias("_a"))
    b = target.select(F.col(path).alias("_q"), F.col(digest).alias("_b"))
    j = a.join(b, F.col("_p") == F.col("_q"), "full_outer")
    modified = j.where(F.col("_p").isNotNull() & F.col("_q").isNotNull() & ~F.col("_a").eqNullSafe(F.col("_b"))).select(F.lit("modified").alias("action"), F.col("_q").alias("file_path"), F.lit(None).cast("string").alias("previous_path"))
    nth = lambda p, d: F.row_number().over(Window.partitionBy(d).orderBy(p))
    gone = j.where(F.col("_q").isNull()).select("_p", "_a").withColumn("_i", nth("_p", "_a"))
    new = j.where(F.col("_p").isNull()).select("_q", "_b").withColumn("_j", nth("_q", "_b"))
    moved = gone.join(new, (F.col("_a") == F.col("_b")) & (F.col("_i") == F.col("_j")), "full_outer")
    action = F.when(F.col("_p").isNull(), "added").when(F.col("_q").isNull(), "deleted").otherwise("renamed")
    rest = moved.select(action.alias("action"), F.coalesce("_q", "_p").alias("file_path"), F.when(F.col("_q").isNotNull(), F.col("_p")).alias("previous_path"))
    return modified.unionByName(rest)


def manifest_summary(manifest: DataFrame) -> DataFrame:
    count = lambda a: F.count_if(F.col("action") == a).alias(a)
    return manifest.agg(*map(count, ("added", "modified", "deleted", "renamed")), F.count("*").alias("total"))


def touched_paths(manifest: DataFrame) -> DataFrame:
    return manifest.select(F.explode(F.array("file_path", "previous_path")).alias("path")).where("path is not null").distinct()


def deactivate(chunks: DataFrame, manifest: DataFrame, path: str = "file_path") -> DataFrame:
    """chunks with active off for every path the manifest touches, before its new records come in."""
    touched = touched_paths(manifest).select(F.col("path").alias("_t"))
    marked = chunks.join(touched, chunks[path] == F.col("_t"), "left")
    return marked.withColumn("active", F.col("active") & F.col("_t").isNull()).drop("_t")


def upsert(existing: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, new ones over old: a new snapshot, as Parquet has no update in place."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    own = Window.partitionBy(key).orderBy(F.desc("_new"), F.desc_nulls_last(order))
    return both.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n", "_new")


def bumped(counters: DataFrame, more: DataFrame, key: str, value: str) -> DataFrame:
    return counters.select(key, value).unionByName(more.select(key, value)).groupBy(key).agg(F.sum(value).alias(value))


def latest(log: DataFrame, key: str, seq: str, value: list[str]) -> DataFrame:
    """The last record of each key in a log: one pass, combined before the shuffle."""
    return log.groupBy(key).agg(F.max_by(F.struct(*value), F.col(seq)).alias("_v")).select(key, "_v.*")


def first_of(rows: DataFrame, key, order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def advance_state(state: DataFrame, jobs: DataFrame, slug: str) -> DataFrame:
    """The commit of each codebase moves on only when its job is wholly published, or had no records."""
    done = jobs.where((F.col("total") == 0) | (F.col("published") >= F.col("total"))).select(F.col(slug).alias("_s"), F.col("target_commit").alias("_c"))
    return state.join(done, state[slug] == F.col("_s"), "left").withColumn("active_commit", F.coalesce("_c", "active_commit")).drop("_s", "_c")


def cached_questions(chunks: DataFrame, cache: DataFrame, hash_: str, version: str, model: str, id_: str) -> DataFrame:
    """questions of each chunk: by content, version and model; else by content and version under any model; else by source id; else none."""
    usable = cache.where("ok")
    exact = first_of(usable, [hash_, version, model], "line_no").select(F.col(hash_).alias("_h1"), F.col(version).alias("_v1"), F.col(model).alias("_m1"), F.col("questions").alias("_q1"))
    any_model = first_of(usable, [hash_, version], "line_no").select(F.col(hash_).alias("_h2"), F.col(version).alias("_v2"), F.col("questions").alias("_q2"))
    by_id = first_of(usable, [id_], "line_no").select(F.col(id_).alias("_i3"), F.col("questions").alias("_q3"))
    out = chunks.join(exact, (chunks[hash_] == F.col("_h1")) & (chunks[version] == F.col("_v1")) & (chunks[model] == F.col("_m1")), "left")
    out = out.join(any_model, (chunks[hash_] == F.col("_h2")) & (chunks[version] == F.col("_v2")), "left").join(by_id, chunks[id_] == F.col("_i3"), "left")
    found = F.when(F.col("_q1").isNotNull(), "exact").when(F.col("_q2").isNotNull(), "any_model").when(F.col("_q3").isNotNull(), "source_id").otherwise("fallback")
    return out.select(*[chunks[c] for c in chunks.columns], F.coalesce("_q1", "_q2", "_q3").alias("questions"), found.alias("lookup"))


def without_questions(code: DataFrame, questions: DataFrame, key: str, parent: str, version: str | None = None) -> DataFrame:
    """Code chunks that no active question names as its parent; with version, none of that version."""
    q = questions.where(F.col(parent).isNotNull() & F.col("active"))
    q = q.where(F.col("hyde_version") == version) if version is not None else q
    return code.join(q.select(F.col(parent).alias("_p")).distinct(), code[key] == F.col("_p"), "left_anti")


def merged_replies(inputs: DataFrame, replies: DataFrame, key: str) -> DataFrame:
    """Every input with its reply (the first of its id), and whether it is missing."""
    r = first_of(replies, key, "ordinal").drop("ordinal")
    return inputs.join(r.withColumn("_has", F.lit(True)), key, "left").withColumn("missing", F.col("_has").isNull()).drop("_has")


def snapshot_id(files: DataFrame, group: str, path: str, size: str, digest: str) -> DataFrame:
    """The first 32 digits of the SHA-256 of a codebase's sorted (path, bytes, sha256) lines; a codebase of any size is hashed as its lines pass."""
    from trawl.operators.ordered import ordered_digest

    line = F.concat_ws("\t", path, F.col(size).cast("string"), digest)
    return ordered_digest(files, group, [path], line).select(group, F.left("digest", F.lit(32)).alias("snapshot_id"), F.col("n").alias("files"))


def backfill_hashes(records: DataFrame, chunks: DataFrame, key: str, version: str) -> DataFrame:
    """Old side-car records (key, content_hash, hyde_version, line_range) with the hash of the chunk of their id.

    The chunk's hash replaces the record's; a version or line range fills in only where the record has none. Records
    without a chunk stay as they are (found is false). updated counts the hash and version that changed.
    """
    own = chunks.select(F.col(key).alias("_k"), F.col("content_hash").alias("_hash"), F.col("line_range").alias("_range"))
    both = records.join(own, F.col(key) == F.col("_k"), "left")
    found = F.col("_k").isNotNull()
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    new_hash, new_version = found & ~F.col("content_hash").eqNullSafe(F.col("_hash")), found & blank("hyde_version")
    return both.withColumns(
        {
            "updated": new_hash.cast("int") + new_version.cast("int"),
            "found": found,
            "content_hash": F.when(new_hash, F.col("_hash")).otherwise(F.col("content_hash")),
            "hyde_version": F.when(new_version, F.lit(version)).otherwise(F.col("hyde_version")),
            "line_range": F.when(found & blank("line_range"), F.coalesce("_range", "line_range")).otherwise(F.col("line_range")),
        }
    ).drop("_k", "_hash", "_range")
