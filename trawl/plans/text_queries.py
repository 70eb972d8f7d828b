"""Functions over documents, one query for each family."""

from __future__ import annotations

from pyspark.sql import functions as F

from trawl.functions import code, paths, text, vectors
from trawl.operators import chunking, lexical, questions
from trawl.plans.registry import PATH, joined, load, query, with_path

#: The tokenizer in RE2, which has no look-ahead: capitals before a capitalised word are split off first, and a capital before a digit or underscore drops.
TOKENS = r"""list_filter(flatten(list_transform(regexp_extract_all({0}, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+'), lambda t:
 list_concat([lower(t)], list_filter(regexp_split_to_array(lower(t), '[_\\-]+'), lambda p: p <> '' AND p <> lower(t)),
 list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(t, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([A-Z]+)[A-Z]([0-9_])', '\1 \2', 'g'), '(^|[^A-Z])[A-Z]([0-9_])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda p: lower(p)), lambda p: p <> '' AND p <> lower(t))))), lambda t: length(t) > 1)"""
BUCKET = "CAST(('0x' || substr(sha256({0}), 1, 16))::UBIGINT % 1000003 AS INT)"


@query("lexical_tokens", f"SELECT doc_id, len(t)::INT AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents)")
def lexical_tokens(spark, sf):
    t = load(spark, sf, "documents").select("doc_id", text.lexical_tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.md5(joined("t")).alias("tokens_md5"))


@query("query_terms", f"SELECT item_id, array_to_string(list_sort(list_distinct({TOKENS.format('text')})), ' ') AS terms FROM benchmark")
def query_terms(spark, sf):
    return load(spark, sf, "benchmark").select("item_id", joined(text.query_terms("text")).alias("terms"))


SPARSE = f"""SELECT {{0}}, idx, c / sqrt(sum(c * c) OVER (PARTITION BY {{0}})) AS w FROM (SELECT {{0}}, {BUCKET.format('term')} AS idx, count(*)::DOUBLE AS c
 FROM (SELECT {{0}}, unnest({TOKENS.format('text')}) AS term FROM {{1}}) GROUP BY 1, 2)"""


@query("sparse_vector", f"SELECT doc_id, idx, round(w, 6) AS w FROM ({SPARSE.format('doc_id', 'documents')})")
def sparse_vector(spark, sf):
    return lexical.sparse_vectors(load(spark, sf, "documents"), "doc_id", "text").select("doc_id", "idx", F.round("w", 6).alias("w"))


@query(
    "sparse_topk",
    f"""WITH d AS ({SPARSE.format('doc_id', 'documents')}), q AS ({SPARSE.format('item_id', 'benchmark')}),
 s AS (SELECT item_id, doc_id, round(sum(d.w * q.w), 6) AS score FROM d JOIN q USING (idx) GROUP BY 1, 2)
 SELECT item_id, doc_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""",
)
def sparse_topk(spark, sf):
    q = lexical.sparse_blocks(load(spark, sf, "benchmark"), "item_id", "text", "q_")
    d = lexical.sparse_blocks(load(spark, sf, "documents"), "doc_id", "text")
    return lexical.sparse_top_k(q, d, "item_id", "doc_id", 10)


WORDS = "regexp_extract_all(lower({0}), '[a-z0-9_]+')"
BM25 = """WITH t AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM (SELECT doc_id, {words} AS w FROM documents)),
 p AS (SELECT doc_id, term, count(*) AS tf, first(dl) AS dl FROM t GROUP BY 1, 2),
 n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM (SELECT DISTINCT doc_id, dl FROM p)),
 q AS (SELECT DISTINCT item_id, unnest(list_filter({qwords}, lambda x: length(x) > 1)[1:8]) AS qterm FROM benchmark),
 m AS ({matched}),
 df AS (SELECT qterm, count(*) AS df FROM m GROUP BY 1),
 s AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM m JOIN df USING (qterm) JOIN q USING (qterm) CROSS JOIN n GROUP BY 1, 2)
 SELECT item_id, doc_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10"""


def _bm25(spark, sf, prefix):
    w = F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9_]+)"), F.lit(1))
    posts = lexical.postings(load(spark, sf, "documents"), "doc_id", w)
    q = load(spark, sf, "benchmark").select("item_id", F.explode(lexical.fts_terms("text")).alias("qterm"))
    return lexical.bm25(q, posts, "item_id", 10, prefix)


@query("bm25_topk", BM25.format(words=WORDS.format("text"), qwords=WORDS.format("text"), matched="SELECT doc_id, term AS qterm, tf, dl FROM p WHERE term IN (SELECT qterm FROM q)"))
def bm25_topk(spark, sf):
    return _bm25(spark, sf, False)


@query(
    "bm25_prefix_topk",
    BM25.format(words=WORDS.format("text"), qwords=WORDS.format("text"), matched="SELECT doc_id, qterm, sum(tf)::BIGINT AS tf, first(dl) AS dl FROM p JOIN (SELECT DISTINCT qterm, term FROM (SELECT DISTINCT qterm FROM q) a JOIN (SELECT DISTINCT term FROM p) b ON starts_with(b.term, a.qterm)) USING (term) GROUP BY 1, 2"),
)
def bm25_prefix_topk(spark, sf):
    return _bm25(spark, sf, True)


@query("or_terms", r"SELECT item_id, array_to_string(CASE WHEN len(w) > 0 THEN w[1:5] ELSE [text] END, ' ') AS terms FROM (SELECT item_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: length(x) > 2 AND lower(x) NOT IN ('the', 'and', 'for', 'how', 'does', 'what', 'where', 'when', 'which', 'that', 'this', 'with', 'from')) AS w FROM benchmark)")
def or_terms(spark, sf):
    return load(spark, sf, "benchmark").select("item_id", joined(lexical.or_terms("text")).alias("terms"))


@query(
    "trigram_search",
    """WITH q AS (SELECT item_id, unnest(list_distinct(list_transform(generate_series(1, length(text) - 2), lambda i: substr(lower(text), i, 3)))) AS g FROM benchmark WHERE length(text) >= 3),
 d AS (SELECT doc_id, unnest(list_distinct(list_transform(generate_series(1, length(text) - 2), lambda i: substr(lower(text), i, 3)))) AS g FROM documents WHERE length(text) >= 3),
 n AS (SELECT item_id, count(*) AS n FROM q GROUP BY 1),
 s AS (SELECT item_id, doc_id, round(count(*) / first(n), 6) AS score FROM q JOIN d USING (g) JOIN n USING (item_id) GROUP BY 1, 2)
 SELECT item_id, doc_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""",
)
def trigram_search(spark, sf):
    return lexical.trigram_search(load(spark, sf, "benchmark"), load(spark, sf, "documents"), "item_id", "doc_id", 10)


OR_TERMS = """SELECT item_id, lower(unnest(CASE WHEN len(w) > 0 THEN w[1:5] ELSE [text] END)) AS qterm FROM (SELECT item_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: length(x) > 2 AND lower(x) NOT IN ('the', 'and', 'for', 'how', 'does', 'what', 'where', 'when', 'which', 'that', 'this', 'with', 'from')) AS w FROM benchmark)"""


@query(
    "trigram_or_topk",
    f"""WITH q AS (SELECT DISTINCT item_id, qterm FROM ({OR_TERMS}) WHERE length(qterm) >= 3), l AS (SELECT doc_id, lower(text) AS low, greatest(length(text) - 2, 0) AS dl FROM documents),
 n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l WHERE dl > 0),
 m AS (SELECT doc_id, dl, qterm, (length(low) - length(replace(low, qterm, ''))) / length(qterm) AS tf FROM l JOIN (SELECT DISTINCT qterm FROM q) ON contains(low, qterm)),
 df AS (SELECT qterm, count(*) AS df FROM m GROUP BY 1),
 s AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM m JOIN df USING (qterm) JOIN q USING (qterm) CROSS JOIN n GROUP BY 1, 2)
 SELECT item_id, doc_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""",
)
def trigram_or_topk(spark, sf):
    return lexical.or_search(load(spark, sf, "benchmark"), load(spark, sf, "documents"), "item_id", "doc_id")


FIELDS = """t AS (SELECT doc_id, len(a) + len(b) + len(c) AS dl, unnest(list_concat(list_transform(a, lambda x: {'term': x, 'w': 1.0}), list_transform(b, lambda x: {'term': x, 'w': 3.0}), list_transform(c, lambda x: {'term': x, 'w': 1.0})), recursive := true)
 FROM (SELECT doc_id, regexp_extract_all(lower(PATH), '[a-z0-9_]+') AS a, regexp_extract_all(lower(concat(lang, ' ', source)), '[a-z0-9_]+') AS b, regexp_extract_all(lower(text), '[a-z0-9_]+') AS c FROM documents))""".replace("PATH", PATH)


@query(
    "bm25_fields_topk",
    f"""WITH {FIELDS}, n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM (SELECT DISTINCT doc_id, dl FROM t)),
 q AS (SELECT DISTINCT item_id, unnest(list_concat(list_filter({WORDS.format('text')}, lambda x: length(x) > 1)[1:8], [CASE item_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'tests' ELSE 'py' END])) AS qterm FROM benchmark),
 m AS (SELECT doc_id, qterm, sum(w)::DOUBLE AS tf, max(dl) AS dl FROM t JOIN (SELECT DISTINCT qterm FROM q) ON starts_with(term, qterm) GROUP BY 1, 2),
 df AS (SELECT qterm, count(*) AS df FROM m GROUP BY 1),
 s AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM m JOIN df USING (qterm) JOIN q USING (qterm) CROSS JOIN n GROUP BY 1, 2)
 SELECT item_id, doc_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5""",
)
def bm25_fields_topk(spark, sf):
    """Path, symbols (here the language and source) and body, weighted 1, 3, 1, by prefixes of the query's words."""
    w = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9_]+)"), F.lit(1))
    posts = lexical.postings(with_path(load(spark, sf, "documents")), "doc_id", (w(F.col("path")), 1.0), (w(F.concat_ws(" ", "lang", "source")), 3.0), (w(F.col("text")), 1.0))
    more = F.when(F.col("item_id") % 3 == 0, "en").when(F.col("item_id") % 3 == 1, "tests").otherwise("py")
    q = load(spark, sf, "benchmark").select("item_id", F.explode(F.concat(lexical.fts_terms("text"), F.array(more))).alias("qterm"))
    return lexical.bm25(q, posts, "item_id", 5, True)


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash, 'chunk-' || substr(sha256(concat(doc_id, ':', 0)), 1, 16) AS chunk_id, substr(sha256(concat(source, ':', lang, ':', doc_id)), 1, 16) AS manifest_id FROM documents")
def content_hash(spark, sf):
    return load(spark, sf, "documents").select("doc_id", text.content_hash("text").alias("content_hash"), text.chunk_id(F.col("doc_id").cast("string"), F.lit(0)).alias("chunk_id"), text.manifest_id("source", "lang", F.col("doc_id").cast("string")).alias("manifest_id"))


@query(
    "uuid5_ids",
    """SELECT doc_id, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3), lower(hex(('0x' || substr(h, 17, 1))::INT & 3 | 8))[-1:] || substr(h, 18, 3), substr(h, 21, 12)) AS point_id
 FROM (SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(concat(source, '_', doc_id))) AS h FROM documents)""",
)
def uuid5_ids(spark, sf):
    """Checked against the standard library in the tests, too."""
    return load(spark, sf, "documents").select("doc_id", text.uuid5(F.concat_ws("_", "source", F.col("doc_id").cast("string"))).alias("point_id"))


@query("slugs", "SELECT page_id, substr(regexp_replace(regexp_replace(lower(url), '[^a-z0-9-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40) AS slug FROM pages")
def slugs(spark, sf):
    return load(spark, sf, "pages").select("page_id", text.slug("url").alias("slug"))


@query(
    "sanitize_text",
    r"""SELECT doc_id, length(t)::INT AS n, md5(t) AS text_md5 FROM (SELECT doc_id, CASE WHEN s = '' THEN '[empty embedding input]' WHEN length(s) > 12000
 THEN concat(left(s, 6000), chr(10), chr(10), '[... embedding text truncated ...]', chr(10), chr(10), right(s, 6000)) ELSE s END AS t FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B-\x1F]', ' ', 'g'), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS s FROM documents))""",
)
def sanitize_text(spark, sf):
    t = load(spark, sf, "documents").select("doc_id", text.sanitize("text").alias("t"))
    return t.select("doc_id", F.length("t").alias("n"), F.md5("t").alias("text_md5"))


@query("truncations", "SELECT doc_id, md5(left(text, 500)) AS snippet_md5, md5(left(text, 4000)) AS chunk_md5, md5(concat('Embedding fallback for code-search chunk.', chr(10), 'Original text sha256: ', sha256(text), chr(10), 'Preview:', chr(10), left(text, 1000))) AS fallback_md5 FROM documents")
def truncations(spark, sf):
    d = load(spark, sf, "documents")
    return d.select("doc_id", F.md5(F.left("text", F.lit(500))).alias("snippet_md5"), F.md5(F.left("text", F.lit(4000))).alias("chunk_md5"), F.md5(text.fallback_text("text")).alias("fallback_md5"))


@query(
    "question_normalize",
    r"""SELECT conv_id, turn, md5(CASE WHEN q = '' OR q LIKE '%?' THEN q ELSE regexp_replace(q, '[.:;]+$', '') || '?' END) AS question_md5 FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS q FROM conversations)""",
)
def question_normalize(spark, sf):
    return load(spark, sf, "conversations").select("conv_id", "turn", F.md5(text.normalize_question("text")).alias("question_md5"))


@query("hyde_keys", "SELECT doc_id, concat('content:', sha256(text), ':hyde:', lang, ':model:', source) AS hyde_key FROM documents")
def hyde_keys(spark, sf):
    return load(spark, sf, "documents").select("doc_id", text.hyde_key(text.content_hash("text"), "lang", "source").alias("hyde_key"))


WORDS_120 = r"array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')[1:120], ' ')"


@query(
    "digest_context_hash",
    f"""SELECT doc_id, sha256('{{"digest_model": ' || to_json(lang)::VARCHAR || ', "digest_version": "v1", "module_purpose": ' || to_json({WORDS_120})::VARCHAR || ', "slice_content_hash": "' || sha256(text) || '", "slice_id": ' || to_json(source)::VARCHAR || '}}') AS context_hash,
 sha256('{{"n":' || n_chars || ',"path":' || to_json(source)::VARCHAR || '}}') AS stable_hash FROM documents""",
)
def digest_context_hash(spark, sf):
    purpose = F.array_join(F.slice(F.filter(F.split("text", r"\s+"), lambda x: x != ""), 1, 120), " ")
    d = load(spark, sf, "documents").withColumns({"purpose": purpose, "version": F.lit("v1")})
    context = text.digest_context_hash("source", "purpose", "version", "lang", text.content_hash("text"))
    return d.select("doc_id", context.alias("context_hash"), text.stable_json_hash(path=F.col("source"), n=F.col("n_chars")).alias("stable_hash"))


KEYWORDS = """SELECT doc_id, term, count, row_number() OVER (PARTITION BY doc_id ORDER BY count DESC, term) AS rank FROM (SELECT doc_id, term, count(*) AS count
 FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]{2,}')) AS term FROM documents) WHERE term NOT IN ('from', 'import', 'return', 'const', 'let', 'var', 'this', 'that', 'with', 'then', 'else', 'true', 'false', 'none', 'null', 'self') GROUP BY 1, 2)"""


@query("keywords_topk", f"SELECT doc_id, term, count, rank::INT AS rank FROM ({KEYWORDS}) WHERE rank <= 6")
def keywords_topk(spark, sf):
    return questions.keywords(load(spark, sf, "documents"), "doc_id", "text")


@query(
    "hyde_template",
    f"""WITH k AS (SELECT doc_id, list(term ORDER BY rank) AS t FROM ({KEYWORDS}) WHERE rank <= 6 GROUP BY 1), d AS (SELECT doc_id, {PATH} AS p, len(string_split(text, chr(10))) AS e FROM documents),
 j AS (SELECT d.*, coalesce(t, []) AS t, regexp_extract(p, '[^/]*$') AS b FROM d LEFT JOIN k USING (doc_id))
 SELECT doc_id, 0 AS hyde_index, concat('Where is ', CASE WHEN len(t) > 0 THEN array_to_string(t, ' ') ELSE b END, ' handled in ', p, '?') AS question FROM j
 UNION ALL SELECT doc_id, 1, concat('What code around lines 1-', e, ' implements ', coalesce(t[1], b), '?') FROM j
 UNION ALL SELECT doc_id, 2, concat('How does ', p, ' use ', CASE WHEN len(t) > 0 THEN array_to_string(t[1:3], ', ') ELSE 'this logic' END, '?') FROM j""",
)
def hyde_template(spark, sf):
    d = with_path(load(spark, sf, "documents")).withColumn("start_line", F.lit(1)).withColumn("end_line", F.size(F.split("text", "\n")))
    return questions.template_questions(d, "doc_id", "path")


@query(
    "question_quality",
    """SELECT conv_id, array_to_string(list_filter([CASE WHEN len(q) <> 2 THEN 'count' END, CASE WHEN len(list_filter(q, lambda x: length(trim(x)) < 40)) > 0 THEN 'short' END,
 CASE WHEN len(list_filter(q, lambda x: NOT (trim(x) LIKE '%?'))) > 0 THEN 'no_mark' END, CASE WHEN len(list_distinct(list_transform(q, lambda x: lower(trim(x))))) < len(q) THEN 'repeated' END], lambda x: x IS NOT NULL), ' ') AS errors
 FROM (SELECT conv_id, list(text ORDER BY turn) AS q FROM conversations WHERE role = 'user' GROUP BY 1)""",
)
def question_quality(spark, sf):
    c = load(spark, sf, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("q"))
    return c.select("conv_id", joined(questions.question_errors("q", 2)).alias("errors"))


LANGUAGE = """CASE regexp_extract(p, '[.][^.]*$') WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.prisma' THEN 'prisma' WHEN '.json' THEN 'json' WHEN '.tsx' THEN 'typescriptreact' WHEN '.md' THEN 'markdown' WHEN '.sh' THEN 'shell' WHEN '.js' THEN 'javascript' ELSE 'unknown' END"""
ROLE = """CASE WHEN regexp_matches(lower(p), '/test/|/tests/|__tests__|[.]test[.]|[.]spec[.]') THEN 'test' WHEN regexp_matches(lower(p), '/route|/routes|/api/|controller') THEN 'route'
 WHEN regexp_matches(lower(p), 'model|schema|prisma') THEN 'model' WHEN regexp_matches(lower(p), 'config|[.]env|settings') OR lang2 IN ('json', 'yaml') THEN 'config'
 WHEN lang2 IN ('typescriptreact', 'javascriptreact', 'html', 'css', 'scss') OR lower(p) LIKE '%.tsx' OR lower(p) LIKE '%.jsx' THEN 'ui' WHEN lang2 IN ('markdown', 'mdx', 'text') THEN 'docs'
 WHEN lang2 IN ('shell', 'sql') THEN 'script' WHEN regexp_matches(lower(p), 'service|client|adapter|worker') THEN 'service' ELSE 'unknown' END"""


@query("file_role", f"SELECT doc_id, lang2 AS language, {ROLE} AS file_role, array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_split_to_array(p, '[^A-Za-z0-9_]+'), lambda x: x <> ''), lambda x: lower(x)))), ' ') AS path_tokens FROM (SELECT doc_id, p, {LANGUAGE} AS lang2 FROM (SELECT doc_id, {PATH} AS p FROM documents))")
def file_role(spark, sf):
    d = with_path(load(spark, sf, "documents")).withColumn("language", code.language("path"))
    return d.select("doc_id", "language", code.file_role("path", "language").alias("file_role"), joined(code.path_tokens("path")).alias("path_tokens"))


@query(
    "path_filters",
    f"""SELECT doc_id, regexp_extract(p, '[.][^.]*$') IN ('.ts', '.tsx', '.js', '.json', '.prisma', '.md', '.sh', '.py') AND octet_length(encode(text)) <= 1000000 AND NOT (list_max(list_transform(string_split(text, chr(10)), lambda l: length(l))) > 20000 AND regexp_matches(p, '[.](css|js|json|xml)$')) AS should_index,
 regexp_matches(p, '[.](py|ts|tsx|js|json|md|sh)$') AS indexable, regexp_matches(p, '^src/src1.*[.]py$') AS in_glob, p NOT LIKE '%/tests/%' AS not_test FROM (SELECT doc_id, text, {PATH} AS p FROM documents)""",
)
def path_filters(spark, sf):
    d = with_path(load(spark, sf, "documents"))
    return d.select("doc_id", paths.should_index("path", "text").alias("should_index"), paths.indexable("path").alias("indexable"), paths.matches_any("path", "src/src1*.py").alias("in_glob"), (~paths.matches_any("path", "*/tests/*")).alias("not_test"))


@query("path_penalty", f"SELECT doc_id, CASE WHEN regexp_matches(p, '[.](json|toml|yaml|yml)$') THEN 0.5::DOUBLE WHEN regexp_matches(p, '[.]config[.](ts|js|mjs)$|[.]md$') THEN 0.6 WHEN regexp_matches(p, '[.]test[.](ts|js|tsx|jsx)$|[.]spec[.](ts|js)$') THEN 0.7 WHEN regexp_matches(p, '[.](css|html|svg)$') THEN 0.6 WHEN regexp_matches(p, '[.](lock|gitignore)$') THEN 0.3 ELSE 1.0 END AS penalty FROM (SELECT doc_id, lower({PATH}) AS p FROM documents)")
def path_penalty(spark, sf):
    return with_path(load(spark, sf, "documents")).select("doc_id", paths.path_penalty("path").alias("penalty"))


@query("chunk_metadata", None)
def chunk_metadata(spark, sf):
    """Symbols, imports, signature, type and effects; the tests hold each against plain Python."""
    d = code.describe(with_path(load(spark, sf, "documents")))
    lists = ("symbols_defined", "symbols_used", "imports", "side_effects", "next_queries")
    return d.select("doc_id", "language", "file_role", "chunk_type", "signature", "what_it_does", "when_to_use", "file_skeleton", *[joined(c).alias(c) for c in lists])


@query(
    "chunk_lines",
    r"""SELECT doc_id, i::INT AS chunk_index, (i * 10 + 1)::INT AS start_line, least((i + 1) * 10, len(l))::INT AS end_line, md5(c) AS chunk_md5 FROM (SELECT doc_id, l, i, left(array_to_string(l[i * 10 + 1 : i * 10 + 10], chr(10)), 12000) AS c
 FROM (SELECT doc_id, l, unnest(generate_series(0, (len(l) - 1) // 10)) AS i FROM (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM documents))) WHERE regexp_replace(c, '\s+', '', 'g') <> ''""",
)
def chunk_lines(spark, sf):
    out = chunking.by_lines(load(spark, sf, "documents"), "doc_id", "text", lines=10)
    return out.select("doc_id", "chunk_index", "start_line", F.col("end_line").cast("int").alias("end_line"), F.md5("chunk").alias("chunk_md5"))


@query("chunk_windows", r"SELECT doc_id, i::INT AS chunk_index, md5(c) AS chunk_md5 FROM (SELECT doc_id, i, substr(text, i * 400 + 1, 400) AS c FROM (SELECT doc_id, text, unnest(generate_series(0, least(greatest(ceil(length(text) / 400)::INT, 1), 8) - 1)) AS i FROM documents)) WHERE regexp_replace(c, '\s+', '', 'g') <> ''")
def chunk_windows(spark, sf):
    return chunking.by_characters(load(spark, sf, "documents"), "doc_id", "text", 400).select("doc_id", "chunk_index", F.md5("chunk").alias("chunk_md5"))


CHUNKED = """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, c[1].n AS start_line, c[-1].n AS end_line, CASE WHEN c[1].n = c[-1].n THEN c[1].n::VARCHAR ELSE concat(c[1].n, '-', c[-1].n) END AS line_range,
 md5(array_to_string(list_transform(c, lambda x: x.t), chr(10))) AS chunk_md5 FROM o"""


@query("chunk_whole", "SELECT doc_id, 0 AS chunk_index, md5(left(text, 4000)) AS chunk_md5 FROM documents")
def chunk_whole(spark, sf):
    return chunking.whole(load(spark, sf, "documents"), "doc_id", "text").select("doc_id", "chunk_index", F.md5("chunk").alias("chunk_md5"))


@query(
    "chunk_greedy",
    f"""WITH RECURSIVE u AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
 p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n, k) AS i, {{'n': n, 't': substr(line, k * 1500 + 1, 1500)}} AS piece FROM (SELECT *, unnest(range(0, greatest(1, (length(line) + 1499) // 1500))) AS k FROM u)),
 s AS (SELECT doc_id, i, [piece] AS held, length(piece.t) + 1 AS size, CAST(NULL AS STRUCT(n BIGINT, t VARCHAR)[]) AS closed FROM p WHERE i = 1
 UNION ALL SELECT doc_id, i, held, list_sum(list_transform(held, lambda x: length(x.t) + 1))::BIGINT, closed FROM (
 SELECT s.doc_id, p.i, list_append(CASE WHEN size + length(piece.t) + 1 > 1500 THEN list_filter(held, lambda x, j: list_sum(list_transform(held[j:], lambda y: length(y.t) + 1)) <= 200) ELSE held END, piece) AS held, CASE WHEN size + length(piece.t) + 1 > 1500 THEN held END AS closed FROM s JOIN p ON p.doc_id = s.doc_id AND p.i = s.i + 1)),
 o AS (SELECT doc_id, i, closed AS c FROM s WHERE closed IS NOT NULL UNION ALL SELECT doc_id, max(i) + 1, arg_max(held, i) FROM s GROUP BY 1) {CHUNKED}""",
)
def chunk_greedy(spark, sf):
    return chunking.greedy(load(spark, sf, "documents"), "doc_id", "text").select("doc_id", "chunk_index", "start_line", "end_line", "line_range", F.md5("chunk").alias("chunk_md5"))


@query(
    "chunk_greedy_late",
    f"""WITH RECURSIVE p AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
 s AS (SELECT doc_id, 0::BIGINT AS i, CAST([] AS STRUCT(n BIGINT, t VARCHAR)[]) AS held, 0::BIGINT AS size, CAST(NULL AS STRUCT(n BIGINT, t VARCHAR)[]) AS closed FROM documents
 UNION ALL SELECT doc_id, i, kept, CASE WHEN size >= 1500 THEN coalesce(list_sum(list_transform(kept, lambda x: length(x.t))), 0) ELSE size END::BIGINT, CASE WHEN size >= 1500 THEN held END FROM (
 SELECT *, CASE WHEN size >= 1500 THEN list_filter(held, lambda x, j: list_sum(list_transform(held[j:], lambda y: length(y.t))) <= 200) ELSE held END AS kept FROM (
 SELECT s.doc_id, p.i, list_append(held, {{'n': p.i, 't': line}}) AS held, size + length(line) + 1 AS size FROM s JOIN p ON p.doc_id = s.doc_id AND p.i = s.i + 1))),
 o AS (SELECT doc_id, i, closed AS c FROM s WHERE closed IS NOT NULL UNION ALL SELECT * FROM (SELECT doc_id, max(i) + 1, arg_max(held, i) AS c FROM s GROUP BY 1) WHERE regexp_matches(array_to_string(list_transform(c, lambda x: x.t), ''), '[^\\s]')) {CHUNKED}""",
)
def chunk_greedy_late(spark, sf):
    return chunking.greedy(load(spark, sf, "documents"), "doc_id", "text", late=True).select("doc_id", "chunk_index", "start_line", "end_line", "line_range", F.md5("chunk").alias("chunk_md5"))


_SCRIPT = r"export\s+(async\s+)?function\s+\w+|(export\s+)?(async\s+)?function\s+\w+|(export\s+)?class\s+\w+|\s*(static\s+)?(async\s+)?\w+\s*\([^)]*\)\s*\{|(export\s+)?(const|let|var)\s+\w+\s*=\s*(async\s+)?\(|(export\s+)?interface\s+\w+|(export\s+)?type\s+\w+\s*="


@query(
    "chunk_boundary",
    rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, CASE doc_id % 8 WHEN 0 THEN '(async\s+)?def\s+\w+|class\s+\w+' WHEN 1 THEN '{_SCRIPT}|(export\s+)?enum\s+\w+' WHEN 4 THEN '{_SCRIPT}|(export\s+)?enum\s+\w+' WHEN 6 THEN '\s*\w+\s*\(\)\s*\{{|\s*function\s+\w+' WHEN 7 THEN '{_SCRIPT}' END AS r FROM documents),
 l AS (SELECT doc_id, text, r, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM (SELECT *, string_split(text, chr(10)) AS ls FROM d)),
 a AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM l),
 b AS (SELECT doc_id, pos FROM a WHERE r IS NOT NULL AND regexp_matches(substr(text, pos + 1), '^(' || r || ')') UNION SELECT doc_id, 0 FROM d UNION SELECT doc_id, length(text) FROM d),
 c AS (SELECT doc_id, pos AS s, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS e FROM b),
 t AS (SELECT doc_id, s, e, left(trim(substr(text, s + 1, e - s), e' \t\n\r\x0b\x0c'), 4000) AS chunk FROM c JOIN d USING (doc_id) WHERE e IS NOT NULL),
 k AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM t WHERE chunk <> '')
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk_index, s AS start, e AS "end", md5(chunk) AS chunk_md5 FROM k WHERE n > 1
 UNION ALL SELECT doc_id, 0, 0, length(text), md5(left(text, 4000)) FROM d WHERE doc_id NOT IN (SELECT doc_id FROM k WHERE n > 1)""",
)
def chunk_boundary(spark, sf):
    return chunking.by_boundary(with_path(load(spark, sf, "documents")), "doc_id", "text", "path").select("doc_id", "chunk_index", "start", "end", F.md5("chunk").alias("chunk_md5"))


@query("bundle_files", None)
def bundle_files(spark, sf):
    out = chunking.pack_bundles(with_path(load(spark, sf, "documents")), "path", "text", 16)
    return out.select("bundle", F.size("members").alias("members"), "chars", F.md5(joined("members")).alias("members_md5"))


@query("vector_norm", "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, true AS valid FROM embeddings")
def vector_norm(spark, sf):
    return load(spark, sf, "embeddings").select("vec_id", F.round(vectors.norm("embedding"), 6).alias("norm"), vectors.valid("embedding", 64).alias("valid"))


@query("pseudo_embedding", "SELECT doc_id, array_to_string(list_transform(generate_series(0, 7), lambda k: (w[k + 1] - CASE WHEN w[k + 1] >= 32768 THEN 65536 ELSE 0 END)::VARCHAR), ' ') AS head FROM (SELECT doc_id, list_transform(generate_series(0, 7), lambda k: ('0x' || substr(h, k * 4 + 1, 4))::BIGINT) AS w FROM (SELECT doc_id, sha256(concat(source, '-', doc_id, ':0')) AS h FROM documents))")
def pseudo_embedding(spark, sf):
    v = load(spark, sf, "documents").select("doc_id", F.slice(vectors.pseudo_embedding(F.concat_ws("-", "source", F.col("doc_id").cast("string")), 32), 1, 8).alias("v"))
    return v.select("doc_id", joined(F.transform("v", lambda x: F.round(x * 32768).cast("int").cast("string"))).alias("head"))


@query(
    "reply_parse",
    """SELECT conv_id, turn, CASE WHEN turn % 4 < 3 THEN format('{{"conv_id": {}, "turn": {}}}', conv_id, turn) END AS parsed, CASE turn % 4 WHEN 0 THEN 'direct' WHEN 3 THEN 'error' ELSE 'extracted' END AS parse_mode FROM conversations""",
)
def reply_parse(spark, sf):
    """Replies made of conversation texts: plain, fenced, embedded and broken JSON."""
    c = load(spark, sf, "conversations")
    body = F.to_json(F.struct("conv_id", "turn"))
    reply = F.when(F.col("turn") % 4 == 0, body).when(F.col("turn") % 4 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("turn") % 4 == 2, F.concat("text", F.lit(" "), body, F.lit(" end"))).otherwise(F.col("text"))
    return questions.parse_replies(c.select("conv_id", "turn", reply.alias("reply")), "reply").select("conv_id", "turn", "parsed", "parse_mode")


#: Documents as code: a class for each, with a method of one line for each line that has letters.
AS_CODE = r"""SELECT doc_id, concat('class C', doc_id, ':', chr(10), array_to_string(list_transform(l, lambda x, i: concat('    def f', i, '():', chr(10), '        x = ', x, chr(10))), '')) AS code, l FROM
 (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(regexp_replace(x, '[^A-Za-z0-9]+', ' ', 'g'), '^ | $', '', 'g')), lambda x: x <> '') AS l FROM documents)"""


@query(
    "chunk_nested",
    rf"""WITH a AS ({AS_CODE}), w AS (SELECT doc_id, code, l, length(code) > 200 AS large FROM a),
 m AS (SELECT doc_id, i, x, length(concat('    def f', i, '():', chr(10), '        x = ', x, chr(10))) > 200 AS long_ FROM (SELECT doc_id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS i FROM w WHERE large)),
 p AS (SELECT doc_id, 0 AS i, 0 AS j, 0 AS level, trim(code, chr(10) || ' ') AS c FROM w WHERE NOT large
  UNION ALL SELECT doc_id, 0, 0, CASE WHEN len(l) > 0 THEN 1 ELSE 0 END, concat('class C', doc_id, ':') FROM w WHERE large
  UNION ALL SELECT doc_id, i, 0, 1, CASE WHEN long_ THEN concat('def f', i, '():') ELSE concat('def f', i, '():', chr(10), '        x = ', x) END FROM m
  UNION ALL SELECT doc_id, i, 1, 1, concat('x = ', x) FROM m WHERE long_)
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS chunk_index, level::BIGINT AS level, md5(c) AS chunk_md5 FROM p""",
)
def chunk_nested(spark, sf):
    """Nested declarations: a class over the cap is cut at its methods, and a method over it after its lines."""
    from trawl.operators import nesting

    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, "[^A-Za-z0-9]+", " "), "^ | $", ""))
    method = lambda x, i: F.concat(F.lit("    def f"), (i + 1).cast("string"), F.lit("():\n        x = "), x, F.lit("\n"))
    code = F.concat(F.lit("class C"), F.col("doc_id").cast("string"), F.lit(":\n"), F.array_join(F.transform(F.filter(lines, lambda x: x != ""), method), ""))
    docs = load(spark, sf, "documents").select("doc_id", code.alias("code"), F.lit("a.py").alias("path"))
    return nesting.by_nesting(docs, "doc_id", "code", "path", 200).select("doc_id", "chunk_index", "level", F.md5("chunk").alias("chunk_md5"))


@query(
    "pseudo_embedding_whole",
    "SELECT doc_id, array_to_string(list_transform(generate_series(0, 31), lambda k: (w[k + 1] - CASE WHEN w[k + 1] >= 32768 THEN 65536 ELSE 0 END)::VARCHAR), ' ') AS vector FROM (SELECT doc_id, list_transform(generate_series(0, 31), lambda k: ('0x' || substr(h, k * 4 + 1, 4))::BIGINT) AS w FROM (SELECT doc_id, sha256(concat(source, '-', doc_id, ':0')) || sha256(concat(source, '-', doc_id, ':1')) AS h FROM documents))",
)
def pseudo_embedding_whole(spark, sf):
    """All values, of two digests."""
    v = load(spark, sf, "documents").select("doc_id", vectors.pseudo_embedding(F.concat_ws("-", "source", F.col("doc_id").cast("string")), 32).alias("v"))
    return v.select("doc_id", joined(F.transform("v", lambda x: F.round(x * 32768).cast("int").cast("string"))).alias("vector"))


@query(
    "reply_shapes",
    r"""SELECT conv_id, turn, CASE k WHEN 0 THEN l WHEN 1 THEN o WHEN 2 THEN '{"p": "C:\\dir\\' || conv_id || '"}' WHEN 3 THEN '{"p": "a\\q b"}' WHEN 4 THEN l WHEN 5 THEN '{"a": {"b": "}"}}' END AS parsed,
 CASE k WHEN 0 THEN 'direct' WHEN 1 THEN 'extracted' WHEN 2 THEN 'repaired_escapes' WHEN 3 THEN 'repaired_escapes' WHEN 4 THEN 'extracted' WHEN 5 THEN 'extracted' ELSE 'error' END AS parse_mode
 FROM (SELECT *, (conv_id + turn) % 7 AS k, format('[{}, {}]', conv_id, turn) AS l, format('{{"id": {}}}', conv_id) AS o FROM conversations)""",
)
def reply_shapes(spark, sf):
    """Lists, a later fence after a broken one, escapes that are none (in a fence, in prose), a list in prose, a brace in a string, no JSON."""
    c = load(spark, sf, "conversations")
    list_ = F.concat(F.lit("["), F.col("conv_id"), F.lit(", "), F.col("turn"), F.lit("]"))
    fence = lambda x: F.concat(F.lit("```json\n"), x, F.lit("\n```"))
    shapes = [
        list_,
        F.concat(fence(F.lit('{"id": ')), F.lit("\nor\n"), fence(F.concat(F.lit('{"id": '), F.col("conv_id"), F.lit("}")))),
        fence(F.concat(F.lit('{"p": "C:\\dir\\'), F.col("conv_id"), F.lit('"}'))),
        F.lit('see {"p": "a\\q b"} there'),
        F.concat(F.lit("these: "), list_, F.lit(" fit")),
        F.lit('so {"a": {"b": "}"}} it is'),
    ]
    reply = F.lit("nothing to parse { here")
    for i, shape in enumerate(shapes):
        reply = F.when((F.col("conv_id") + F.col("turn")) % 7 == i, shape).otherwise(reply)
    return questions.parse_replies(c.select("conv_id", "turn", reply.alias("reply")), "reply").select("conv_id", "turn", "parsed", "parse_mode")
