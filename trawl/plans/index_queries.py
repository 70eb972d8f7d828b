"""Incremental indexing, jobs, streams and the relational surface over events, documents, conversations and orders."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from trawl.functions import paths
from trawl.operators import batches, incremental, jobs, ordered, questions, renames
from trawl.plans.registry import PATH, joined, load, query, with_path
from trawl.streaming import watch

#: The old snapshot has documents whose id is not divisible by 10, the new one those not by 7; some change between them.
OLD, NEW = "doc_id % 10 <> 0", "doc_id % 7 <> 0"


def _snapshots(spark, sf):
    d = load(spark, sf, "documents")
    v = lambda n, m: F.concat(F.lit("v"), (F.col("doc_id") % m == 0).cast("int").cast("string")).alias(n)
    old = d.where(OLD).select("doc_id", F.lit("v0").alias("metadata"), F.lit("v0").alias("hyde"), F.lit(1).alias("start_line"))
    return old, d.where(NEW).select("doc_id", v("metadata", 9), v("hyde", 11), F.when(F.col("doc_id") % 4 == 0, 2).otherwise(1).alias("start_line"))


@query(
    "incremental_plan",
    f"""WITH a AS (SELECT doc_id, 'v0' AS m, 'v0' AS h, 1 AS s FROM documents WHERE {OLD}), b AS (SELECT doc_id, 'v' || (doc_id % 9 = 0)::INT AS m, 'v' || (doc_id % 11 = 0)::INT AS h, CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 1 END AS s FROM documents WHERE {NEW})
 SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'insert' WHEN b.doc_id IS NULL THEN 'delete' WHEN a.m <> b.m OR a.h <> b.h THEN 'reindex' WHEN a.s <> b.s THEN 'backfill' ELSE 'skip' END AS action FROM a FULL JOIN b ON a.doc_id = b.doc_id""",
)
def incremental_plan(spark, sf):
    old, new = _snapshots(spark, sf)
    return incremental.plan(old, new, "doc_id", ["metadata", "hyde"], ["start_line"])


@query("incremental_stale", f"SELECT doc_id FROM documents WHERE {OLD} AND NOT ({NEW})")
def incremental_stale(spark, sf):
    return incremental.stale(*_snapshots(spark, sf), "doc_id")


@query("delete_guard", f"SELECT existing, stale, round(stale / existing, 6) AS share, stale / existing <= 0.2 AS allowed FROM (SELECT count(*) FILTER ({OLD}) AS existing, count(*) FILTER ({OLD} AND NOT ({NEW})) AS stale FROM documents)")
def delete_guard(spark, sf):
    return incremental.delete_guard(*_snapshots(spark, sf), "doc_id")


def _files(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.concat("text", F.col("doc_id").cast("string")).alias("t"))
    base = d.where(OLD).select("path", F.sha2("t", 256).alias("sha256"))
    moved = F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))
    changed = F.when(F.col("doc_id") % 17 == 0, F.concat("t", F.lit("!"))).otherwise(F.col("t"))
    return base, d.where(NEW).select(moved.alias("path"), F.sha2(changed, 256).alias("sha256"))


MANIFEST = f"""WITH d AS (SELECT doc_id, source || '/' || doc_id AS p, text || doc_id AS t FROM documents), a AS (SELECT p, sha256(t) AS h FROM d WHERE {OLD}),
 b AS (SELECT CASE WHEN doc_id % 13 = 0 THEN 'moved/' || p ELSE p END AS p, sha256(CASE WHEN doc_id % 17 = 0 THEN t || '!' ELSE t END) AS h FROM d WHERE {NEW}),
 g AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY p) AS i FROM a WHERE p NOT IN (SELECT p FROM b)), n AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY p) AS i FROM b WHERE p NOT IN (SELECT p FROM a)),
 m AS (SELECT 'modified' AS action, b.p AS file_path, NULL AS previous_path FROM a JOIN b ON a.p = b.p WHERE a.h <> b.h
 UNION ALL SELECT CASE WHEN g.p IS NULL THEN 'added' WHEN n.p IS NULL THEN 'deleted' ELSE 'renamed' END, coalesce(n.p, g.p), CASE WHEN n.p IS NOT NULL THEN g.p END FROM g FULL JOIN n ON g.h = n.h AND g.i = n.i)"""


@query("diff_manifest", f"{MANIFEST} SELECT action, file_path, coalesce(previous_path, '') AS previous_path FROM m")
def diff_manifest(spark, sf):
    return incremental.diff_manifest(*_files(spark, sf)).withColumn("previous_path", F.coalesce("previous_path", F.lit("")))


@query("manifest_summary", f"{MANIFEST} SELECT count(*) FILTER (action = 'added') AS added, count(*) FILTER (action = 'modified') AS modified, count(*) FILTER (action = 'deleted') AS deleted, count(*) FILTER (action = 'renamed') AS renamed, count(*) AS total FROM m")
def manifest_summary(spark, sf):
    return incremental.manifest_summary(incremental.diff_manifest(*_files(spark, sf)))


@query("soft_delete", f"{MANIFEST}, t AS (SELECT file_path AS p FROM m UNION SELECT previous_path FROM m) SELECT a.p AS file_path, a.p NOT IN (SELECT p FROM t WHERE p IS NOT NULL) AS active FROM a")
def soft_delete(spark, sf):
    base, target = _files(spark, sf)
    return incremental.deactivate(base.select(F.col("path").alias("file_path"), F.lit(True).alias("active")), incremental.diff_manifest(base, target))


@query("upsert_latest", f"SELECT doc_id, CASE WHEN {NEW} THEN 'new' ELSE 'old' END AS origin FROM documents WHERE ({OLD}) OR ({NEW})")
def upsert_latest(spark, sf):
    old, new = _snapshots(spark, sf)
    return incremental.upsert(old.withColumn("origin", F.lit("old")), new.withColumn("origin", F.lit("new")), "doc_id", "start_line").select("doc_id", "origin")


@query("counter_upsert", "SELECT event_type, count(*) AS n FROM (SELECT event_type FROM events UNION ALL SELECT event_type FROM events WHERE user_id % 2 = 0) GROUP BY 1")
def counter_upsert(spark, sf):
    e = load(spark, sf, "events").withColumn("n", F.lit(1).cast("long"))
    return incremental.bumped(e, e.where("user_id % 2 = 0"), "event_type", "n")


@query("checkpoint_latest", "SELECT conv_id, arg_max(role, turn) AS role, max(turn) AS turn FROM conversations GROUP BY 1")
def checkpoint_latest(spark, sf):
    return incremental.latest(load(spark, sf, "conversations"), "conv_id", "turn", ["role", "turn"])


@query("stage_counts", "SELECT role AS stage, count(*) AS n FROM (SELECT conv_id, arg_max(role, turn) AS role FROM conversations GROUP BY 1) GROUP BY 1")
def stage_counts(spark, sf):
    return checkpoint_latest(spark, sf).groupBy(F.col("role").alias("stage")).agg(F.count("*").alias("n"))


@query("dedup_queries", "SELECT item_id FROM (SELECT item_id, row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY item_id) AS r FROM benchmark) WHERE r = 1")
def dedup_queries(spark, sf):
    b = load(spark, sf, "benchmark").withColumn("k", F.lower(F.trim("text")))
    return incremental.first_of(b, "k", "item_id").select("item_id")


@query("collect_by_file", "SELECT source, md5(string_agg(doc_id::VARCHAR, ' ' ORDER BY doc_id)) AS ids_md5, count(*) AS n FROM documents GROUP BY 1")
def collect_by_file(spark, sf):
    found = ordered.ordered_digest(load(spark, sf, "documents"), "source", ["doc_id"], F.col("doc_id").cast("string"), " ", "md5")
    return found.select("source", F.col("digest").alias("ids_md5"), "n")


@query("embedding_run_manifest", "SELECT label, left(sha256(concat('model-a', 64, label, count(*))), 32) AS embedding_run_id, count(*) AS vector_count FROM embeddings GROUP BY 1")
def embedding_run_manifest(spark, sf):
    g = load(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("vector_count"))
    return g.withColumn("embedding_run_id", F.left(F.sha2(F.concat(F.lit("model-a"), F.lit("64"), F.col("label").cast("string"), F.col("vector_count").cast("string")), 256), F.lit(32)))


@query("snapshot_manifest", "SELECT source, left(sha256(string_agg(concat(doc_id, chr(9), n_chars, chr(9), sha256(text)), chr(10) ORDER BY doc_id::VARCHAR COLLATE \"POSIX\")), 32) AS snapshot_id, count(*) AS files FROM documents GROUP BY 1")
def snapshot_manifest(spark, sf):
    d = load(spark, sf, "documents").select("source", F.col("doc_id").cast("string").alias("p"), "n_chars", F.sha2("text", 256).alias("h"))
    return incremental.snapshot_id(d, "source", "p", "n_chars", "h")


@query("hyde_gap_anti", "SELECT doc_id FROM documents WHERE doc_id % 2 = 0 AND doc_id NOT IN (SELECT doc_id - 1 FROM documents WHERE doc_id % 2 = 1 AND doc_id % 3 <> 0)")
def hyde_gap_anti(spark, sf):
    d = load(spark, sf, "documents")
    q = d.where("doc_id % 2 = 1").select((F.col("doc_id") - 1).alias("parent"), (F.col("doc_id") % 3 != 0).alias("active"), F.col("lang").alias("hyde_version"))
    return incremental.without_questions(d.where("doc_id % 2 = 0").select("doc_id"), q, "doc_id", "parent")


@query("hyde_gap_version", "SELECT doc_id FROM documents WHERE doc_id % 2 = 0 AND doc_id NOT IN (SELECT doc_id - 1 FROM documents WHERE doc_id % 2 = 1 AND doc_id % 3 <> 0 AND lang = 'en')")
def hyde_gap_version(spark, sf):
    d = load(spark, sf, "documents")
    q = d.where("doc_id % 2 = 1").select((F.col("doc_id") - 1).alias("parent"), (F.col("doc_id") % 3 != 0).alias("active"), F.col("lang").alias("hyde_version"))
    return incremental.without_questions(d.where("doc_id % 2 = 0").select("doc_id"), q, "doc_id", "parent", "en")


@query(
    "hyde_cache_lookup",
    """WITH c AS (SELECT doc_id, md5(text) AS h, lang AS v, 'm' || doc_id % 2 AS m FROM documents), k AS (SELECT c.*, doc_id % 3 <> 0 AS ok, 'q' || doc_id AS q FROM c WHERE doc_id % 4 = 0 AND doc_id % 3 <> 0),
 e1 AS (SELECT h, v, m, arg_min(q, doc_id) AS q FROM k GROUP BY 1, 2, 3), e2 AS (SELECT h, v, arg_min(q, doc_id) AS q FROM k GROUP BY 1, 2)
 SELECT c.doc_id, coalesce(e1.q, e2.q) AS questions, CASE WHEN e1.q IS NOT NULL THEN 'exact' WHEN e2.q IS NOT NULL THEN 'any_model' ELSE 'fallback' END AS lookup FROM c LEFT JOIN e1 ON c.h = e1.h AND c.v = e1.v AND c.m = e1.m LEFT JOIN e2 ON c.h = e2.h AND c.v = e2.v""",
)
def hyde_cache_lookup(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"), F.col("lang").alias("v"), F.concat(F.lit("m"), (F.col("doc_id") % 2).cast("string")).alias("m"), F.concat(F.lit("id"), F.col("doc_id").cast("string")).alias("i"))
    cache = d.where("doc_id % 4 = 0").withColumns({"ok": F.col("doc_id") % 3 != 0, "questions": F.concat(F.lit("q"), F.col("doc_id").cast("string")), "line_no": F.col("doc_id")}).drop("doc_id")
    return incremental.cached_questions(d, cache, "h", "v", "m", "i").select("doc_id", "questions", "lookup")


@query("reply_merge", "SELECT d.doc_id, coalesce(l.quality, -1)::INT AS quality, l.doc_id IS NULL AS missing FROM documents d LEFT JOIN labels l USING (doc_id)")
def reply_merge(spark, sf):
    r = load(spark, sf, "labels").select("doc_id", "quality").withColumn("ordinal", F.lit(0))
    return incremental.merged_replies(load(spark, sf, "documents").select("doc_id"), r, "doc_id").withColumn("quality", F.coalesce("quality", F.lit(-1)))


@query("batch_reply_quality", "WITH e AS (SELECT DISTINCT doc_id % 20 AS b, doc_id AS k FROM documents), g AS (SELECT doc_id % 20 AS b, doc_id + CASE WHEN doc_id % 31 = 0 THEN 1000000 ELSE 0 END AS k, max(CASE WHEN text LIKE '%?' AND length(text) >= 40 THEN 1 ELSE 0 END) AS ok FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2) SELECT coalesce(e.b, g.b) AS batch, count(e.k) AS expected, count(g.k) AS \"unique\", count(*) FILTER (g.k IS NULL) AS missing, count(*) FILTER (e.k IS NULL) AS extra, count(*) FILTER (ok = 1) AS validish FROM e FULL JOIN g ON e.b = g.b AND e.k = g.k GROUP BY 1")
def batch_reply_quality(spark, sf):
    d, w = load(spark, sf, "documents"), load(spark, sf, "labels").select("doc_id")
    e = d.select((F.col("doc_id") % 20).alias("batch"), F.col("doc_id").alias("k"))
    g = d.join(w, "doc_id").select((F.col("doc_id") % 20).alias("batch"), (F.col("doc_id") + F.when(F.col("doc_id") % 31 == 0, 1_000_000).otherwise(0)).alias("k"), "text")
    return questions.reply_quality(e, g, "batch", "k", "text")


@query("job_progress", "SELECT source, total, published, CASE WHEN published >= total THEN 'published' ELSE 'publishing' END AS status FROM (SELECT source, count(*) - 1 AS total, count(*) FILTER (doc_id % 20 <> 0) AS published FROM documents GROUP BY 1)")
def job_progress(spark, sf):
    d = load(spark, sf, "documents").withColumn("active", F.col("doc_id") % 20 != 0)
    return jobs.progress(d, "source", d.groupBy("source").agg((F.count("*") - 1).alias("total")))


@query("shard_rollup", "SELECT user_id % 50 AS job, count(*) FILTER (event_type <> 'error' AND value > 50)::BIGINT AS done, count(*) FILTER (value > 95)::BIGINT AS errors, count(*) AS shards, CASE WHEN count(*) FILTER (value > 95) = 0 THEN 'published' WHEN count(*) FILTER (event_type <> 'error' AND value > 50) > 0 THEN 'partial' ELSE 'failed' END AS status FROM events GROUP BY 1")
def shard_rollup(spark, sf):
    e = load(spark, sf, "events").select((F.col("user_id") % 50).alias("job"), ((F.col("event_type") != "error") & (F.col("value") > 50)).cast("int").alias("done"), (F.col("value") > 95).cast("int").alias("errors"))
    return jobs.rollup(e, "job")


@query("batch_validity", "SELECT source AS batch, count(*) AS rows, count(*) FILTER (coalesce(lang, '') = '' OR coalesce(text, '') = '') AS invalid, count(*) <= 50 AND count(*) FILTER (coalesce(lang, '') = '' OR coalesce(text, '') = '') = 0 AS ok FROM documents GROUP BY 1")
def batch_validity(spark, sf):
    return batches.valid_batches(load(spark, sf, "documents").withColumnRenamed("source", "batch"), "batch", 50, "text", "lang")


@query(
    "shard_machine",
    """WITH RECURSIVE e AS (SELECT user_id % 40 AS job, event_id % 3 AS seq, event_id::VARCHAR AS output, CASE WHEN event_type IN ('click', 'view') THEN 'running' WHEN value > 60 THEN 'done' ELSE 'failed' END AS event, row_number() OVER (PARTITION BY user_id % 40, event_id % 3 ORDER BY ts) AS i FROM events),
 s AS (SELECT DISTINCT job, seq, 0::BIGINT AS i, 'pending' AS status, 0 AS attempts, NULL::VARCHAR AS output FROM e
 UNION ALL SELECT s.job, s.seq, e.i, CASE WHEN moves THEN e.event ELSE status END, attempts + CASE WHEN moves AND e.event = 'running' THEN 1 ELSE 0 END, CASE WHEN moves AND e.event = 'done' THEN e.output ELSE s.output END
 FROM s JOIN e ON e.job = s.job AND e.seq = s.seq AND e.i = s.i + 1 CROSS JOIN LATERAL (SELECT (status IN ('pending', 'failed') AND e.event = 'running') OR status = 'running' AS moves))
 SELECT job, seq, arg_max(status, i) AS status, max(attempts)::INT AS attempts, max(output) AS output FROM s GROUP BY 1, 2""",
)
def shard_machine(spark, sf):
    """Shards after all their events."""
    e = load(spark, sf, "events").select((F.col("user_id") % 40).alias("job"), (F.col("event_id") % 3).alias("seq"), F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_type").isin("click", "view"), "running").when(F.col("value") > 60, "done").otherwise("failed").alias("event"), F.col("event_id").cast("string").alias("output"))
    return batches.applied(e.select("job", "seq").distinct(), e, "job", "seq", "at").select("job", "seq", "status", "attempts", "output")


@query("shard_assign", "SELECT doc_id, (doc_id % 16)::INT AS shard, (doc_id % 16 % 3)::INT AS account, doc_id // 100 AS batch FROM documents")
def shard_assign(spark, sf):
    return jobs.assign(load(spark, sf, "documents").select("doc_id"), "doc_id", 16, 3, 100)


@query("shard_lease_pending", "WITH n AS (SELECT max(ts) AS now FROM events), s AS (SELECT event_id, ts, CASE event_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' ELSE 'done' END AS st FROM events) SELECT event_id, st AS status FROM s, n WHERE st = 'pending' OR (st = 'running' AND epoch_us(now) - epoch_us(ts) > 600 * 1000000)")
def shard_lease_pending(spark, sf):
    e = load(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.select("event_id", "ts", F.when(F.col("event_id") % 3 == 0, "pending").when(F.col("event_id") % 3 == 1, "running").otherwise("done").alias("status"))
    now = e.agg(F.max("ts").alias("now"))
    return jobs.claimable(s.join(now, F.lit(True)), "status", "ts", F.col("now")).select("event_id", "status")


@query("pending_claim", "SELECT doc_id FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 8 = 3 ORDER BY doc_id LIMIT 25")
def pending_claim(spark, sf):
    return jobs.claim(load(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 5 == 0).alias("done")), "done", "doc_id", 8, 3, 25).select("doc_id")


@query("throughput", "SELECT event_type, count(*) AS n, min(value) AS least, max(value) AS most, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) AS per_second FROM events GROUP BY 1")
def throughput(spark, sf):
    e = load(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.throughput(e, ["event_type"], "ts", "value")


@query("sweep_rank", "WITH c AS (SELECT l_suppkey, l_linenumber, count(*) AS n, round(sum(l_quantity), 2) AS rate FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, l_linenumber, n, rate, row_number() OVER (ORDER BY rate DESC, l_suppkey, l_linenumber, n) AS place FROM c WHERE n > 60")
def sweep_rank(spark, sf):
    c = load(spark, sf, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("rate"))
    return jobs.sweep_rank(c, "rate", F.col("n") > 60)


@query(
    "anchored_batches",
    """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
 r AS (SELECT user_id, t, i, t AS a, 0 AS batch FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.t, e.i, CASE WHEN e.t - r.a > 3600000 THEN e.t ELSE r.a END, CASE WHEN e.t - r.a > 3600000 THEN r.batch + 1 ELSE r.batch END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
 SELECT user_id, batch::BIGINT AS batch, count(*) AS size, min(t) AS first_ms, max(t) AS last_ms, max(t) - min(t) AS spread_ms FROM r GROUP BY 1, 2""",
)
def anchored_batches(spark, sf):
    e = load(spark, sf, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"))
    return jobs.anchored_batches(e, "user_id", "t", 3_600_000)


@query(
    "slice_digest",
    f"""WITH d AS (SELECT 'src/' || source AS slice_id, p, lower(p) AS l, regexp_extract(p, '[^.]*$') AS ext, sha256(coalesce(text, '')) AS h FROM (SELECT source, text, {PATH} AS p FROM documents)),
 f AS (SELECT *, CASE WHEN l LIKE '%/tests/%' THEN 'tests' WHEN regexp_matches(l, '/docs/|readme|[.]md') THEN 'docs' WHEN regexp_matches(l, 'wrangler|package[.]json|tsconfig|config|[.]yml|[.]yaml|[.]json') THEN 'configuration' WHEN regexp_matches(l, 'worker|handler|route|api|server') THEN 'runtime code' ELSE 'source code' END AS role FROM d),
 r AS (SELECT slice_id, array_to_string(list(role ORDER BY n DESC, first)[1:3], ', ') AS roles FROM (SELECT slice_id, role, count(*) AS n, min(p) AS first FROM f GROUP BY 1, 2) GROUP BY 1),
 x AS (SELECT slice_id, array_to_string(list(ext ORDER BY n DESC, first)[1:3], ', ') AS exts FROM (SELECT slice_id, ext, count(*) AS n, min(p) AS first FROM f GROUP BY 1, 2) GROUP BY 1),
 w AS (SELECT slice_id, count(*) AS files, sha256(string_agg(p || ':' || h, chr(10) ORDER BY p)) AS slice_content_hash FROM f GROUP BY 1)
 SELECT slice_id, files, left(concat(slice_id, ' groups ', roles, ' for the ', replace(slice_id, '/', ' '), ' area; primary file types are ', exts, '.'), 320) AS module_purpose, slice_content_hash FROM w JOIN r USING (slice_id) JOIN x USING (slice_id)""",
)
def slice_digest(spark, sf):
    return questions.slice_digest(with_path(load(spark, sf, "documents")), "path", "text")


@query("digest_join", f"WITH d AS (SELECT doc_id, {PATH} AS p FROM documents) SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'late' WHEN doc_id % 3 = 0 THEN 'early' END AS module_purpose FROM d")
def digest_join(spark, sf):
    d = with_path(load(spark, sf, "documents")).select("doc_id", F.col("path").alias("file_path"))
    row = lambda n, name, line: d.where(F.col("doc_id") % n == 0).select(F.lit("s").alias("slice_id"), F.array("file_path").alias("files"), F.lit(name).alias("module_purpose"), F.lit(line).alias("line_no"))
    return questions.with_digest(d, row(3, "early", 1).unionByName(row(6, "late", 2))).select("doc_id", "module_purpose")


@query("slice_roles", f"SELECT doc_id, 'src/' || source AS slice_id, CASE WHEN p LIKE '%/tests/%' THEN 'tests' WHEN regexp_matches(p, '/docs/|readme|[.]md') THEN 'docs' WHEN regexp_matches(p, 'wrangler|package[.]json|tsconfig|config|[.]yml|[.]yaml|[.]json') THEN 'configuration' WHEN regexp_matches(p, 'worker|handler|route|api|server') THEN 'runtime code' ELSE 'source code' END AS role FROM (SELECT doc_id, source, lower({PATH}) AS p FROM documents)")
def slice_roles(spark, sf):
    return with_path(load(spark, sf, "documents")).select("doc_id", paths.slice_id("path").alias("slice_id"), paths.digest_role("path").alias("role"))


def _stream(spark, sf):
    from trawl.sources.files import fresh_folder

    return watch.read_events(spark, f"{sf}/events.parquet"), fresh_folder(spark, f"stream-{uuid.uuid4().hex}")


@query("stream_window", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_window(spark, sf):
    """Hourly counts by a stream that has read all there is; complete mode, so no window waits for the watermark."""
    events, folder = _stream(spark, sf)
    out = watch.windowed(events, "ts", ["event_type"], "1 hour", "1 day")
    watch.run_once(out, f"{folder}/checkpoint", watch.snapshot_sink(f"{folder}/out"), "complete")
    return watch.last_snapshot(spark, f"{folder}/out").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark, sf):
    events, folder = _stream(spark, sf)
    return watch.to_table(watch.once(events.select("ts", "user_id", "event_type"), "ts", ["user_id", "event_type"], "36500 days").select("user_id", "event_type"), f"{folder}/out", f"{folder}/checkpoint")


@query(
    "stream_session_debounce",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
 SELECT user_id, changed, n FROM (SELECT user_id, max(ts) AS changed, count(*) AS n FROM s GROUP BY user_id, k) WHERE changed + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)""",
)
def stream_session_debounce(spark, sf):
    """Bursts that the watermark has closed, two hours behind the last event."""
    events, folder = _stream(spark, sf)
    out = watch.to_table(watch.debounced(events, "ts", "user_id", "2 hours", "30 minutes"), f"{folder}/out", f"{folder}/checkpoint")
    return out.select("user_id", F.col("changed").cast("timestamp_ntz").alias("changed"), "n")


@query(
    "stateful_lease",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 600 SECOND THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
 SELECT user_id, expired_at, renewals FROM (SELECT user_id, max(ts) + INTERVAL 600 SECOND AS expired_at, count(*) AS renewals FROM s GROUP BY user_id, k) WHERE expired_at <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
)
def stateful_lease(spark, sf):
    """Leases that ran out, by event time: those that the watermark has closed, an hour behind the last event."""
    events, folder = _stream(spark, sf)
    out = watch.to_table(watch.expired_leases(events, "user_id", "ts", 600, "1 hour"), f"{folder}/out", f"{folder}/checkpoint")
    return out.select("user_id", F.col("expired_at").cast("timestamp_ntz").alias("expired_at"), "renewals")


@query("rel_pricing", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def rel_pricing(spark, sf):
    x = load(spark, sf, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'")
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("rel_star_join", "SELECT r_name, o_orderstatus, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def rel_star_join(spark, sf):
    t = lambda n: load(spark, sf, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("rel_rollup", "SELECT coalesce(o_orderstatus, '-') AS status, coalesce(o_orderpriority, '-') AS priority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rel_rollup(spark, sf):
    g = load(spark, sf, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return g.select(F.coalesce("o_orderstatus", F.lit("-")).alias("status"), F.coalesce("o_orderpriority", F.lit("-")).alias("priority"), "n")


@query("rel_cube", "SELECT coalesce(l_returnflag, '-') AS flag, coalesce(l_linestatus, '-') AS status, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def rel_cube(spark, sf):
    g = load(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return g.select(F.coalesce("l_returnflag", F.lit("-")).alias("flag"), F.coalesce("l_linestatus", F.lit("-")).alias("status"), "n")


@query("rel_window", "SELECT event_id, value - lag(value) OVER w AS step, row_number() OVER w AS nth, ntile(4) OVER w AS quarter FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def rel_window(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return load(spark, sf, "events").select("event_id", (F.col("value") - F.lag("value").over(w)).alias("step"), F.row_number().over(w).cast("long").alias("nth"), F.ntile(4).over(w).cast("long").alias("quarter"))


@query("rel_set_ops", "(SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) EXCEPT SELECT doc_id FROM labels WHERE toxic = 1")
def rel_set_ops(spark, sf):
    d, w = load(spark, sf, "documents").select("doc_id"), load(spark, sf, "labels")
    return d.intersect(w.select("doc_id")).subtract(w.where("toxic = 1").select("doc_id"))


@query(
    "fan_out",
    """WITH s AS (SELECT o_custkey % 40 AS job, CASE WHEN o_orderkey % 2 = 0 THEN 'code' ELSE 'hyde' END AS side, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderkey % 7 END AS done, CASE WHEN o_orderkey % 89 = 0 THEN 1 ELSE 0 END AS errors FROM orders),
 t AS (SELECT job, side, coalesce(done, 0) AS done, CASE WHEN done IS NULL THEN 1 ELSE errors END AS errors FROM s),
 g AS (SELECT job, sum(CASE WHEN side = 'code' THEN done ELSE 0 END)::BIGINT AS completed, sum(CASE WHEN side = 'hyde' THEN done ELSE 0 END)::BIGINT AS hyde_completed, sum(CASE WHEN side = 'code' THEN errors ELSE 0 END) AS c, sum(CASE WHEN side = 'hyde' THEN errors ELSE 0 END) AS h FROM t GROUP BY 1)
 SELECT job, CASE WHEN c = 0 THEN 'live' ELSE 'partial' END AS code_status, CASE WHEN h = 0 THEN 'live' ELSE 'partial' END AS hyde_status, completed, hyde_completed, CASE WHEN c = 0 AND h = 0 THEN 'published' ELSE 'partial' END AS status FROM g""",
)
def fan_out(spark, sf):
    k = F.col("o_orderkey")
    s = load(spark, sf, "orders").select((F.col("o_custkey") % 40).alias("job"), F.when(k % 2 == 0, "code").otherwise("hyde").alias("side"), F.when(k % 97 != 0, k % 7).alias("done"), F.when(k % 89 == 0, 1).otherwise(0).alias("errors"))
    return jobs.fan_out(s, "job")


@query(
    "shard_counters",
    "SELECT o_custkey % 40 AS job, count(*) AS shards, sum(o_orderkey % 5)::BIGINT AS vectors, sum(CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE 1 END)::BIGINT AS calls, sum(o_orderkey % 3)::BIGINT AS errors FROM orders GROUP BY 1",
)
def shard_counters(spark, sf):
    k = F.col("o_orderkey")
    counters = F.struct((k % 5).alias("vectors"), F.when(k % 11 != 0, F.lit(1)).cast("long").alias("calls"), (k % 3).alias("errors"))
    return jobs.summed(load(spark, sf, "orders").select((F.col("o_custkey") % 40).alias("job"), counters.alias("counters")), "job", "counters")


@query(
    "hash_backfill",
    """WITH c AS (SELECT doc_id, sha256(text) AS h, '1-' || n_chars AS r FROM documents WHERE doc_id % 6 <> 0),
 o AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN sha256(text) WHEN doc_id % 4 = 1 THEN 'old' END AS content_hash, CASE doc_id % 3 WHEN 0 THEN 'v0' WHEN 1 THEN '' END AS hyde_version, CASE WHEN doc_id % 5 = 0 THEN '7-9' END AS line_range FROM documents)
 SELECT doc_id, coalesce(h, content_hash) AS content_hash, CASE WHEN h IS NOT NULL AND coalesce(hyde_version, '') = '' THEN 'v2' ELSE hyde_version END AS hyde_version, coalesce(line_range, r) AS line_range,
 (CASE WHEN h IS NOT NULL AND content_hash IS DISTINCT FROM h THEN 1 ELSE 0 END + CASE WHEN h IS NOT NULL AND coalesce(hyde_version, '') = '' THEN 1 ELSE 0 END)::INT AS updated, h IS NOT NULL AS found FROM o LEFT JOIN c USING (doc_id)""",
)
def hash_backfill(spark, sf):
    d, k = load(spark, sf, "documents"), F.col("doc_id")
    hashed = F.sha2("text", 256)
    chunks = d.where("doc_id % 6 <> 0").select("doc_id", hashed.alias("content_hash"), F.concat(F.lit("1-"), F.col("n_chars").cast("string")).alias("line_range"))
    old = d.select("doc_id", F.when(k % 4 == 0, hashed).when(k % 4 == 1, "old").alias("content_hash"), F.when(k % 3 == 0, "v0").when(k % 3 == 1, "").alias("hyde_version"), F.when(k % 5 == 0, "7-9").alias("line_range"))
    return incremental.backfill_hashes(old, chunks, "doc_id", "v2")


@query(
    "watch_queue",
    """WITH e AS (SELECT concat('f', user_id) AS path, CASE event_id % 7 WHEN 0 THEN 'unlink' WHEN 1 THEN 'change' ELSE 'add' END AS kind, event_id AS t FROM events),
 i AS (SELECT DISTINCT path FROM e WHERE substr(path, 2)::INT % 3 = 0), u AS (SELECT path, max(CASE WHEN kind = 'unlink' THEN t END) AS gone FROM e GROUP BY 1),
 q AS (SELECT path, min(t) AS added_at FROM e JOIN u USING (path) LEFT JOIN (SELECT path, true AS known FROM i) USING (path) WHERE (gone IS NULL OR t > gone) AND (kind = 'change' OR (kind = 'add' AND (known IS NULL OR gone IS NOT NULL))) GROUP BY 1),
 b AS (SELECT path, row_number() OVER (ORDER BY added_at, path) <= 10 AS taken, substr(path, 2)::INT % 2 = 0 AS ok FROM q)
 SELECT path, CASE WHEN taken AND NOT ok THEN 999999999 ELSE added_at END AS added_at, CASE WHEN taken AND NOT ok THEN 1 ELSE 0 END AS retries, CASE WHEN taken AND ok THEN 'indexed' ELSE 'queued' END AS state FROM q JOIN b USING (path)""",
)
def watch_queue(spark, sf):
    """The watcher's queue after all events of a table, and after the first batch, in which every second file fails."""
    from trawl.streaming import watch

    k = F.col("event_id") % 7
    e = load(spark, sf, "events").select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("path"), F.when(k == 0, "unlink").when(k == 1, "change").otherwise("add").alias("kind"), F.col("event_id").alias("at"))
    number = F.substring("path", F.lit(2), F.length("path")).cast("int")
    queue = watch.queue_of(e, e.where(number % 3 == 0).select("path").distinct(), "path", "kind", "at")
    tried = watch.next_batch(queue, "path").select("path", (number % 2 == 0).alias("ok"))
    return watch.after_batch(queue, tried, "path", F.lit(999999999).cast("long"))


#: A later state of the tree: every fifth file moved and changed at its ends, every seventh gone, every eleventh new with a neighbour's last lines.
LATER = "SELECT concat(CASE WHEN doc_id % 5 = 0 THEN 'moved/' WHEN doc_id % 11 = 3 THEN 'new/' ELSE '' END, p) AS path, CASE WHEN doc_id % 5 = 0 THEN concat('changed', chr(10), text, chr(10), 'changed') WHEN doc_id % 13 = 1 THEN concat(text, '.') ELSE text END AS text FROM s WHERE doc_id % 7 <> 4"


@query(
    "diff_similar",
    f"""WITH RECURSIVE s AS (SELECT doc_id, {PATH} AS p, coalesce(text, '') AS text FROM documents), a AS (SELECT p AS path, text FROM s), b AS ({LATER}),
 j AS (SELECT a.path AS p, b.path AS q, a.text AS x, b.text AS y FROM a FULL JOIN b ON a.path = b.path),
 g AS (SELECT p, x, row_number() OVER (PARTITION BY x ORDER BY p) AS i FROM j WHERE q IS NULL), n AS (SELECT q, y, row_number() OVER (PARTITION BY y ORDER BY q) AS i FROM j WHERE p IS NULL),
 m AS (SELECT p, x, q, y FROM g FULL JOIN n ON x = y AND g.i = n.i),
 l AS (SELECT path, old, line, count(*) AS n, octet_length(encode(line)) + 1 AS each FROM (SELECT p AS path, true AS old, unnest(string_split(x, chr(10))) AS line FROM m WHERE q IS NULL UNION ALL SELECT q, false, unnest(string_split(y, chr(10))) FROM m WHERE p IS NULL) GROUP BY ALL),
 z AS (SELECT path, old, sum(n * each) AS size FROM l GROUP BY ALL),
 c AS (SELECT u.path AS p, v.path AS q, sum(least(u.n, v.n) * u.each) AS share FROM l u JOIN l v ON u.old AND NOT v.old AND u.line = v.line GROUP BY ALL),
 d AS (SELECT c.p, c.q, round(share / greatest(u.size, v.size), 6) AS similarity FROM c JOIN z u ON u.old AND u.path = c.p JOIN z v ON NOT v.old AND v.path = c.q WHERE share >= 0.5 * greatest(u.size, v.size)),
 o AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, p, q) AS k FROM d),
 r(k, ps, qs, ks) AS (SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[], []::BIGINT[] UNION ALL SELECT k2, CASE WHEN free THEN list_append(ps, p2) ELSE ps END, CASE WHEN free THEN list_append(qs, q2) ELSE qs END, CASE WHEN free THEN list_append(ks, k2) ELSE ks END
  FROM (SELECT r.ps, r.qs, r.ks, o.p AS p2, o.q AS q2, o.k AS k2, NOT list_contains(r.ps, o.p) AND NOT list_contains(r.qs, o.q) AS free FROM r JOIN o ON o.k = r.k + 1)),
 w AS (SELECT p, q, similarity FROM o WHERE list_contains((SELECT arg_max(ks, k) FROM r), k))
 SELECT 'modified' AS action, q AS file_path, '' AS previous_path, -1.0::DOUBLE AS similarity FROM j WHERE p = q AND x <> y
 UNION ALL SELECT 'renamed', q, p, 1.0 FROM m WHERE p IS NOT NULL AND q IS NOT NULL
 UNION ALL SELECT 'renamed', q, p, similarity FROM w
 UNION ALL SELECT 'deleted', p, '', -1.0 FROM m WHERE q IS NULL AND p NOT IN (SELECT p FROM w) UNION ALL SELECT 'added', q, '', -1.0 FROM m WHERE p IS NULL AND q NOT IN (SELECT q FROM w)""",
)
def diff_similar(spark, sf):
    """Renames also of files that changed by a few lines."""
    s = with_path(load(spark, sf, "documents")).select("doc_id", F.col("path").alias("p"), F.coalesce("text", F.lit("")).alias("text"))
    s.createOrReplaceTempView(view := f"s_{uuid.uuid4().hex}")
    later = spark.sql(LATER.replace("FROM s ", f"FROM {view} "))
    found = renames.diff_similar(s.select(F.col("p").alias("path"), "text"), later)
    return found.select("action", "file_path", F.coalesce("previous_path", F.lit("")).alias("previous_path"), F.coalesce("similarity", F.lit(-1.0)).alias("similarity"))


@query(
    "hyde_cache_branches",
    """WITH c AS (SELECT doc_id, md5(CASE WHEN doc_id % 7 = 0 THEN text || ' changed' ELSE text END) AS h, lang AS v, 'm' || doc_id % 2 AS m, 'id' || doc_id // 2 * 2 AS i FROM documents),
 k AS (SELECT doc_id, md5(text) AS h, lang AS v, 'm' || CASE WHEN doc_id % 3 = 0 THEN 9 ELSE doc_id % 2 END AS m, 'id' || doc_id // 2 * 2 AS i, 'q' || doc_id AS q FROM documents WHERE doc_id % 5 <> 0),
 e1 AS (SELECT h, v, m, arg_min(q, doc_id) AS q FROM k GROUP BY 1, 2, 3), e2 AS (SELECT h, v, arg_min(q, doc_id) AS q FROM k GROUP BY 1, 2), e3 AS (SELECT i, arg_min(q, doc_id) AS q FROM k GROUP BY 1)
 SELECT c.doc_id, coalesce(e1.q, e2.q, e3.q) AS questions, CASE WHEN e1.q IS NOT NULL THEN 'exact' WHEN e2.q IS NOT NULL THEN 'any_model' WHEN e3.q IS NOT NULL THEN 'source_id' ELSE 'fallback' END AS lookup
 FROM c LEFT JOIN e1 ON c.h = e1.h AND c.v = e1.v AND c.m = e1.m LEFT JOIN e2 ON c.h = e2.h AND c.v = e2.v LEFT JOIN e3 ON c.i = e3.i""",
)
def hyde_cache_branches(spark, sf):
    """A cache that is met by content and model, by content under another model, by the source's id after its text changed, or not at all."""
    d = load(spark, sf, "documents")
    id_ = F.concat(F.lit("id"), (F.floor(F.col("doc_id") / 2) * 2).cast("string"))
    model = lambda x: F.concat(F.lit("m"), x.cast("string"))
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))
    chunks = d.select("doc_id", F.md5(text).alias("h"), F.col("lang").alias("v"), model(F.col("doc_id") % 2).alias("m"), id_.alias("i"))
    other = F.when(F.col("doc_id") % 3 == 0, F.lit(9)).otherwise(F.col("doc_id") % 2)
    cache = d.where("doc_id % 5 <> 0").select(F.md5("text").alias("h"), F.col("lang").alias("v"), model(other).alias("m"), id_.alias("i"), F.lit(True).alias("ok"), F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("questions"), F.col("doc_id").alias("line_no"))
    return incremental.cached_questions(chunks, cache, "h", "v", "m", "i").select("doc_id", "questions", "lookup")
