"""Artifacts, filters, the catalog's façade, model calls and golden sets over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.functions import paths, text
from trawl.functions.helpers import strings
from trawl.operators import batches, incremental, jobs
from trawl.plans import catalog
from trawl.plans.catalog import Catalog, Codebase
from trawl.plans.registry import PATH, joined, load, query, with_path
from trawl.plans.search_queries import DENSE, codebase, queries_of
from trawl.sources import files


def _folder(spark, name):
    return files.fresh_folder(spark, f"{name}-{uuid.uuid4().hex}")


#: A path for each rule of the file filters; {} stands for the document's id.
SHAPES = (
    "src/app/main_{}.py", "node_modules/x/{}.js", "vendor/lib_{}.ts", "docs/guide_{}.md", "web/static/css/tailwind.css", "dist/bundle_{}.min.js", "web/package-lock.json", ".github/workflows/ci_{}.yml",
    "img/logo_{}.png", "deploy/Dockerfile", "a/README", "coverage/{}.json", "logs/run_{}.log", "src/x_{}.map", "uv.lock", "conf/local.env.example", "build/out_{}.css", "pkg/Makefile", "src/__pycache__/m_{}.pyc",
    "styles/site_{}.scss", "conf/app_{}.toml", "noext_{}", "venv/x_{}.sql", "src/Page_{}.TSX", "web/site_{}.min.css", "vendors/a_{}.py", "fonts/a_{}.woff2", "src/run_{}.sh",
)
SHAPE = f"replace([{', '.join(repr(s) for s in SHAPES)}][(doc_id % {len(SHAPES)} + 1)::INT], '{{}}', doc_id::VARCHAR)"


@query(
    "path_rules",
    rf"""WITH p AS (SELECT doc_id, {SHAPE} AS p FROM documents), x AS (SELECT *, regexp_extract(p, '[^/]*$') AS name, regexp_matches(p, '(^|/)([.]git|[.]next|[.]venv|__pycache__|build|coverage|dist|node_modules|vendor|vendors)(/|$)') AS dir,
 regexp_matches(lower(p), '(^|/)(bun[.]lockb|package-lock[.]json|pnpm-lock[.]yaml|yarn[.]lock)$|[.](log|map)$|[.]min[.](css|js)$') AS named FROM p)
 SELECT doc_id, p AS path, dir OR named OR p LIKE '%/static/%tailwind.css' AS excluded,
 NOT regexp_matches(p, '^([.]|node_modules|venv|__pycache__|dist|build)') AND NOT regexp_matches(lower(p), '[.](lock|map|min[.]js|min[.]css|woff2?|ttf|eot|ico|png|jpg|jpeg|gif|svg|pdf|zip|tar|gz|pyc)$') AND NOT contains(p, 'node_modules') AND NOT contains(p, '__pycache__') AS source_file,
 NOT regexp_matches(p, '(^|/)([.]agents|[.]claude|[.]cursor|[.]git|[.]github|[.]venv|__pycache__|build|coverage|dist|node_modules|venv)(/|$)') AND NOT regexp_matches(lower(p), '[.](png|jpe?g|gif|ico|pdf|zip|gz|db)$|(^|/)(uv|yarn|poetry)[.]lock$') AND (regexp_matches(lower(p), '[.](py|js|ts|tsx|html|css|scss|json|ya?ml|toml|md|txt|sh|sql|env[.]example)$') OR name IN ('Dockerfile', 'Makefile', 'README')) AS indexable,
 regexp_matches(p, '[^/][.](ts|tsx|js|jsx|json|prisma|md|mdx|css|scss|sql|sh|yml|yaml|py|html|xml|txt)$') AND NOT dir AND NOT named AND p NOT LIKE 'src/run%' AS digest_included FROM x""",
)
def path_rules(spark, sf):
    """Every rule of the four file filters, on paths made to meet them."""
    shape = F.element_at(strings(SHAPES), (F.col("doc_id") % len(SHAPES) + 1).cast("int"))
    d = load(spark, sf, "documents").select("doc_id", F.replace(shape, F.lit("{}"), F.col("doc_id").cast("string")).alias("path"))
    return d.select("doc_id", "path", paths.excluded("path").alias("excluded"), paths.source_file("path").alias("source_file"), paths.indexable("path").alias("indexable"), paths.digest_included("path", exclude="src/run*").alias("digest_included"))


@query("payload_filter", "SELECT doc_id FROM documents WHERE lang = 'en' AND source IN (SELECT DISTINCT source FROM documents WHERE doc_id % 3 = 0) AND (doc_id % 4 = 1 OR doc_id % 6 = 2)")
def payload_filter(spark, sf):
    """A value, a list of values, and a list against an array column."""
    d = load(spark, sf, "documents")
    d = d.withColumn("tags", F.array(F.concat(F.lit("a"), (F.col("doc_id") % 4).cast("string")), F.concat(F.lit("b"), (F.col("doc_id") % 6).cast("string"))))
    known = d.where("doc_id % 3 = 0").select("source").distinct()
    return catalog.payload_filter(d, {"lang": "en", "tags": ["a1", "b2"]}).join(known, "source", "left_semi").select("doc_id")


@query("codebase_info", "SELECT CASE WHEN doc_id % 2 = 1 THEN 'hyde' ELSE 'code' END AS kind, count(*) AS rows, count(*) FILTER (doc_id % 3 <> 0) AS active FROM documents GROUP BY 1")
def codebase_info(spark, sf):
    return _catalog(spark, sf).info()


@query("active_rows", f"SELECT doc_id AS chunk_id, {PATH} AS file_path FROM documents WHERE doc_id % 3 <> 0")
def active_rows(spark, sf):
    return _catalog(spark, sf).active_rows().select("chunk_id", "file_path")


def _catalog(spark, sf):
    book = Catalog()
    book.register("docs", Codebase(codebase(spark, sf), load(spark, sf, "embeddings")))
    return book.use("docs")


@query(
    "search_shape",
    f"""WITH h AS ({DENSE.format(k=20)}), d AS (SELECT doc_id, {PATH} AS p, text FROM documents WHERE doc_id % 3 <> 0),
 s AS (SELECT query_id, rank, p, text, vec_id, score AS raw, round(score * CASE WHEN regexp_matches(lower(p), '[.](json|toml|yaml|yml)$') THEN 0.5::DOUBLE WHEN regexp_matches(lower(p), '[.]md$') THEN 0.6 ELSE 1.0 END, 9) AS score FROM h JOIN d ON vec_id = doc_id)
 SELECT query_id, vec_id::VARCHAR AS id, rank::INT AS rank, p AS file, score, raw AS raw_score, CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.45 THEN 'medium' ELSE 'low' END AS confidence, replace(left(text, 200), chr(10), ' ') AS snippet FROM s""",
)
def search_shape(spark, sf):
    """A search's hits in the shape that callers are given."""
    book = Catalog()
    chunks = codebase(spark, sf).join(load(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id")
    book.register("docs", Codebase(chunks, load(spark, sf, "embeddings")))
    return catalog.shaped(book.use("docs").search(queries_of(spark, sf), 20))


@query("argument_clamps", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 5 ELSE least(greatest(doc_id - 100, 1), 20) END AS k, least(greatest(CASE WHEN doc_id % 7 = 0 THEN 50 ELSE doc_id END, CASE WHEN doc_id % 5 = 0 THEN 5 ELSE least(greatest(doc_id - 100, 1), 20) END), 200) AS candidates FROM documents")
def argument_clamps(spark, sf):
    i = F.col("doc_id")
    k, most = catalog.clamped_columns(F.when(i % 5 != 0, i - 100), F.when(i % 7 != 0, i))
    return load(spark, sf, "documents").select("doc_id", k.cast("long").alias("k"), most.cast("long").alias("candidates"))


LETTERS = "aeinorst"


@query(
    "similar_files",
    f"""WITH v AS (SELECT doc_id, list_transform(string_split('{'-'.join(LETTERS)}', '-'), lambda c: (length(text) - length(replace(text, c, '')))::DOUBLE) AS w, list_transform(string_split('{'-'.join(LETTERS)}', '-'), lambda c: (length(left(text, 1000)) - length(replace(left(text, 1000), c, '')))::DOUBLE) AS q FROM documents),
 n AS (SELECT doc_id, w, q, sqrt(list_dot_product(w, w)) AS nw, sqrt(list_dot_product(q, q)) AS nq FROM v),
 s AS (SELECT b.doc_id AS query_id, a.doc_id AS vec_id, round(list_dot_product(a.w, b.q) / (a.nw * b.nq), 6) AS score FROM n a JOIN n b ON a.nw > 0 AND b.nq > 0 AND b.doc_id % 100 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
 SELECT query_id, vec_id, rank::INT AS rank FROM r WHERE rank <= 10 AND vec_id % 3 <> 0""",
)
def similar_files(spark, sf):
    """Chunks like a text's first 1,000 characters; the vector counts letters, as no model is here."""
    d = load(spark, sf, "documents").select("doc_id", "text")
    counted = lambda t: F.array(*[(F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))).cast("double") for c in LETTERS])
    book = Catalog()
    book.register("docs", Codebase(codebase(spark, sf), d.select(F.col("doc_id").alias("vec_id"), counted(F.col("text")).alias("embedding"))))
    return book.use("docs").similar(d.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text"), counted).select("query_id", "vec_id", "rank")


@query(
    "symbol_search",
    f"WITH h AS ({DENSE.format(k=20)}) SELECT query_id, vec_id, rank::INT AS rank FROM h WHERE vec_id IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) AND vec_id % 4 = query_id // 100 % 4",
)
def symbol_search(spark, sf):
    """The hits that define a symbol, case apart."""
    chunks = codebase(spark, sf).withColumn("symbols_defined", F.array(F.lit("Main"), F.concat(F.lit("Load_"), (F.col("chunk_id") % 4).cast("string"))))
    book = Catalog()
    book.register("docs", Codebase(chunks, load(spark, sf, "embeddings")))
    asked = queries_of(spark, sf).withColumn("symbol", F.concat(F.lit("LOAD_"), (F.floor(F.col("query_id") / 100) % 4).cast("string")))
    return book.use("docs").by_symbol(asked).select("query_id", "vec_id", "rank")


@query(
    "session_selection",
    "SELECT 'even' AS slug, 'even odd' AS slugs, count(*) AS rows FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 <> 0 UNION ALL SELECT 'odd', 'even odd', count(*) FROM documents WHERE doc_id % 2 = 1 AND doc_id % 3 <> 0",
)
def session_selection(spark, sf):
    """Two registered codebases and a third that goes again; each selected in turn."""
    book, whole, vectors = Catalog(), codebase(spark, sf), load(spark, sf, "embeddings")
    for slug, rest in (("odd", 1), ("even", 0), ("gone", 2)):
        book.register(slug, Codebase(whole.where(F.col("chunk_id") % 2 == rest), vectors))
    book.unregister("gone")
    one = lambda s: book.use(s).active_rows().agg(F.count("*").alias("rows")).select(F.lit(book.current).alias("slug"), F.lit(" ".join(book.slugs())).alias("slugs"), "rows")
    return one("odd").unionByName(one("even"))


def _lists(rows, key, value, folder):
    """Files of one JSON value each, which is their format, of a thousand ids at most."""
    rows.groupBy(F.floor(F.col(key) / 1000).alias("block")).agg(value.alias("value")).write.partitionBy("block").text(folder)


RECORDS = f"SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN {PATH} END AS p, CASE WHEN doc_id % 11 <> 0 THEN text ELSE '' END AS t FROM documents"


def _records(spark, sf):
    i, d = F.col("doc_id"), with_path(load(spark, sf, "documents"))
    return d.select("doc_id", i.cast("string").alias("chunk_id"), F.lit("repo").alias("repo_slug"), F.when(i % 7 != 0, F.col("path")).alias("file_path"), F.sha2("text", 256).alias("source_sha256"), F.when(i % 11 != 0, F.col("text")).otherwise("").alias("text"))


@query("artifact_records", f"SELECT doc_id::VARCHAR AS chunk_id, p AS file_path, md5(t) AS text_md5 FROM ({RECORDS}) WHERE p IS NOT NULL AND t <> ''")
def artifact_records(spark, sf):
    """A full artifact in two appended parts, read again without its invalid records."""
    folder, r = _folder(spark, "records"), _records(spark, sf)
    for part in (r.where("doc_id % 2 = 0"), r.where("doc_id % 2 = 1")):
        files.append_json(part.drop("doc_id"), folder)
    return files.read_records(spark, folder).select("chunk_id", "file_path", F.md5("text").alias("text_md5"))


@query("artifact_changes", f"SELECT CASE WHEN doc_id % 5 = 0 THEN 'tombstone' ELSE 'record' END AS kind, p AS file_path, CASE WHEN doc_id % 5 <> 0 THEN doc_id::VARCHAR ELSE '' END AS chunk_id FROM ({RECORDS}) WHERE p IS NOT NULL AND (doc_id % 5 = 0 OR t <> '')")
def artifact_changes(spark, sf):
    """An incremental artifact: records, and tombstones of paths."""
    i, folder = F.col("doc_id"), _folder(spark, "changes")
    r = _records(spark, sf).withColumn("action", F.when(i % 5 == 0, "tombstone").when(i % 5 == 1, "modified")).withColumn("manifest_id", F.lit("m"))
    files.replace_json(r.drop("doc_id"), folder)
    kept, gone = files.read_changes(spark, folder)
    kept = kept.select(F.lit("record").alias("kind"), "file_path", "chunk_id")
    return kept.unionByName(gone.select(F.lit("tombstone").alias("kind"), "file_path", F.lit("").alias("chunk_id")))


@query("sidecar_scan", "SELECT CASE WHEN doc_id % 6 IN (1, 2) THEN 'bad' ELSE doc_id::VARCHAR END AS id, count(*) AS n FROM documents WHERE doc_id % 6 <> 0 GROUP BY 1")
def sidecar_scan(spark, sf):
    """Side-car lines of which some are blank, cut off, or not ok."""
    i, folder = F.col("doc_id"), _folder(spark, "sidecar")
    good = F.to_json(F.struct(i.cast("string").alias("id"), (i % 6 != 1).alias("ok"), F.array(F.left("text", F.lit(80))).alias("hyde_questions")))
    line = F.when(i % 6 == 0, "  ").when(i % 6 == 2, F.left(good, F.length(good) - 3)).otherwise(good)
    load(spark, sf, "documents").select(line.alias("value")).write.text(folder)
    return files.read_tolerant(spark, folder).groupBy(F.when(F.col("_bad"), "bad").otherwise(F.col("id")).alias("id")).agg(F.count("*").alias("n"))


@query("golden_scan", "SELECT CASE WHEN item_id % 2 = 0 THEN item_id::VARCHAR ELSE left(sha256(text), 12) END AS id, text AS query, CASE WHEN item_id % 3 = 0 THEN 'a.py b.py' ELSE 'c.py' END AS files, CASE WHEN item_id % 3 = 0 THEN 2 ELSE 3 END::BIGINT AS grades FROM benchmark")
def golden_scan(spark, sf):
    """A golden file with items of both forms: graded ranges, and bare answer files."""
    i, folder = F.col("item_id"), _folder(spark, "golden")
    graded = F.array(F.struct(F.lit("c.py").alias("file"), F.lit(1).alias("start_line"), F.lit(9).alias("end_line"), F.lit(3).alias("grade")))
    item = F.struct(F.when(i % 2 == 0, i.cast("string")).alias("id"), F.col("text").alias("query"), F.when(i % 3 != 0, graded).alias("relevant"), F.when(i % 3 == 0, F.array(F.lit("a.py"), F.lit("b.py"))).alias("answer_files"))
    _lists(load(spark, sf, "benchmark"), "item_id", F.to_json(F.collect_list(item)), folder)
    g = files.read_golden(spark, folder)
    return g.select("id", "query", joined(F.transform("relevant", lambda x: x["file"])).alias("files"), F.aggregate("relevant", F.lit(0).cast("long"), lambda a, x: a + x["grade"]).alias("grades"))


@query("chunk_file_scan", f"SELECT doc_id, {PATH} AS file_path FROM documents")
def chunk_file_scan(spark, sf):
    """Chunks as JSON lines and as an object that wraps a list, by half of the documents each."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("file_path", T.StringType())])
    d = with_path(load(spark, sf, "documents")).select("doc_id", F.col("path").alias("file_path"))
    lines, wrapped = f"{_folder(spark, 'chunks')}.jsonl", _folder(spark, "chunks")
    files.replace_json(d.where("doc_id % 2 = 0"), lines)
    _lists(d.where("doc_id % 2 = 1"), "doc_id", F.to_json(F.struct(F.collect_list(F.struct("doc_id", "file_path")).alias("chunks"))), wrapped)
    return files.read_chunks(spark, lines, schema).unionByName(files.read_chunks(spark, wrapped, schema))


@query("snapshot_upsert", "SELECT doc_id, source, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE 'old' END AS state FROM documents WHERE doc_id % 10 <> 1 OR doc_id % 4 = 0")
def snapshot_upsert(spark, sf):
    """A published snapshot, by source, and the next one with every fourth document anew."""
    d, old, new = load(spark, sf, "documents").select("doc_id", "source"), _folder(spark, "snapshot"), _folder(spark, "snapshot")
    files.publish(d.where("doc_id % 10 <> 1").withColumn("state", F.lit("old")), old, "source")
    more = d.where("doc_id % 4 = 0").withColumn("state", F.lit("new"))
    return files.upsert_parquet(spark, old, new, more, "doc_id", "state").select("doc_id", F.col("source").cast("string").alias("source"), "state")


@query("shard_resume", "SELECT doc_id FROM documents WHERE doc_id % 8 = 3 AND doc_id % 5 <> 0")
def shard_resume(spark, sf):
    """A shard's rows whose artifact is not there yet."""
    d = load(spark, sf, "documents").select("doc_id")
    return files.to_do(files.shard_of(d, "doc_id", 8, 3), d.where("doc_id % 5 = 0"), "doc_id")


@query("registry_prefix", f"SELECT p AS path, CASE WHEN p LIKE '%/tests/%' AND p LIKE 'src/src1/%' THEN 'tests' WHEN p LIKE 'src/src1/%' THEN 'one' ELSE 'all' END AS slug FROM (SELECT {PATH} AS p FROM documents)")
def registry_prefix(spark, sf):
    """The registered project with the longest root above each path."""
    roots = spark.createDataFrame([("all", "src"), ("one", "src/src1"), ("tests", "src/src1/tests"), ("other", "lib")], "slug string, root string")
    return files.longest_prefix(with_path(load(spark, sf, "documents")).select("path"), roots, "path", "root").select("path", "slug")


@query("state_advance", "SELECT source AS slug, CASE WHEN count(*) % 3 = 0 OR count(*) % 2 = 1 THEN 'c1' ELSE 'c0' END AS active_commit FROM documents GROUP BY 1")
def state_advance(spark, sf):
    """A codebase's commit moves on where its job had no records or is wholly published."""
    g = load(spark, sf, "documents").groupBy(F.col("source").alias("slug")).agg(F.count("*").alias("n"))
    done = g.select("slug", F.when(F.col("n") % 3 == 0, 0).otherwise(F.col("n")).alias("total"), (F.col("n") - F.when(F.col("n") % 2 == 0, 1).otherwise(0)).alias("published"), F.lit("c1").alias("target_commit"))
    return incremental.advance_state(g.select("slug", F.lit("c0").alias("active_commit")), done, "slug")


def _choosy_model():
    """A model that refuses a batch with a text of 5 n characters, but takes fallback texts."""

    def call(texts):
        if any(len(t) % 5 == 0 and not t.startswith("Embedding fallback") for t in texts):
            raise RuntimeError("refused")
        return [[float(len(t)), float(len(t.encode()))] for t in texts]

    return call


@query(
    "embed_halving",
    "SELECT doc_id, length(t)::DOUBLE AS chars, octet_length(encode(t))::DOUBLE AS bytes FROM (SELECT doc_id, CASE WHEN length(text) % 5 = 0 THEN concat('Embedding fallback for code-search chunk.', chr(10), 'Original text sha256: ', sha256(text), chr(10), 'Preview:', chr(10), left(text, 1000)) ELSE text END AS t FROM documents)",
)
def embed_halving(spark, sf):
    """Texts by batches; a batch that is refused is halved, a text that is refused goes as its fallback."""
    out = batches.embed(load(spark, sf, "documents"), "doc_id", "text", _choosy_model, 8, tries=1)
    return out.select("doc_id", F.col("embedding")[0].alias("chars"), F.col("embedding")[1].alias("bytes"))


GOLDEN = """g AS (SELECT text AS query, item_id FROM benchmark UNION ALL SELECT concat('  ', text), item_id FROM benchmark WHERE item_id % 4 = 0),
 v AS (SELECT query, row_number() OVER (PARTITION BY lower(trim(query)) ORDER BY query) AS n FROM g WHERE item_id % 5 <> 0 AND item_id % 50 % 7 <> 0)"""


def _golden(spark, sf):
    b = load(spark, sf, "benchmark")
    file = F.struct(F.concat(F.lit("f"), (F.col("item_id") % 50).cast("string")).alias("file"))
    items = F.when(F.col("item_id") % 5 == 0, F.array().cast("array<struct<file:string>>")).otherwise(F.array(file))
    g = b.select(F.col("text").alias("query"), items.alias("relevant")).unionByName(b.where("item_id % 4 = 0").select(F.concat(F.lit("  "), F.col("text")).alias("query"), items.alias("relevant")))
    known = spark.range(50).where("id % 7 <> 0").select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"))
    return g, batches.valid_golden(g, known)


@query("golden_filters", f"WITH {GOLDEN} SELECT 'golden-' || left(sha256(query), 12) AS id, query FROM v WHERE n = 1")
def golden_filters(spark, sf):
    """Golden queries with files that exist, the first of each question."""
    return _golden(spark, sf)[1].select("id", "query")


@query("golden_drop_rate", f"WITH {GOLDEN} SELECT generated, valid, round(1 - valid / greatest(generated, 1), 6) AS drop_rate FROM (SELECT count(*) AS generated FROM g) CROSS JOIN (SELECT count(*) AS valid FROM v WHERE n = 1)")
def golden_drop_rate(spark, sf):
    return batches.drop_rate(*_golden(spark, sf))


@query("claims_stop", "SELECT source, count(*) AS total, sum(doc_id % 25)::BIGINT AS generated, sum(doc_id % 25) >= count(*) * 12 AS done FROM documents GROUP BY 1")
def claims_stop(spark, sf):
    g = load(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("total"), F.sum(F.col("doc_id") % 25).alias("generated"))
    return g.withColumn("done", jobs.claims_done("generated", "total"))


@query("safe_names", r"SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(left(text, 60), '[^\pL\pN_-]', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'slice') AS name FROM documents")
def safe_names(spark, sf):
    """File names from the first words of a text."""
    return load(spark, sf, "documents").select("doc_id", text.safe_filename(F.left("text", F.lit(60))).alias("name"))
