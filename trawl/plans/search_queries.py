"""Search, fusion, re-ranking and evaluation over embeddings, documents and benchmark texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from trawl.functions import text
from trawl.operators import evals, graph, lexical, search, tuning
from trawl.plans.catalog import Catalog, Codebase
from trawl.plans.registry import PATH, joined, load, query, with_path
from trawl.plans.text_queries import BM25, TOKENS, WORDS
from trawl.sources.files import written

#: Queries are the vectors whose id is divisible by 100.
DENSE = """SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
 FROM (SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6) AS score
 FROM embeddings e CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q)) WHERE rank <= {k}"""
PENALTY = "CASE WHEN regexp_matches(p, '[.](json|toml|yaml|yml)$') THEN 0.5::DOUBLE WHEN regexp_matches(p, '[.]md$') THEN 0.6 ELSE 1.0 END"


def queries_of(spark, sf):
    return load(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


def dense(spark, sf, k=10):
    return search.dense_top_k(queries_of(spark, sf), load(spark, sf, "embeddings"), "query_id", "vec_id", "embedding", "query_vec", k)


@query("dense_topk", DENSE.format(k=10).replace("score, rank FROM", "score, rank::INT AS rank FROM"))
def dense_topk(spark, sf):
    return dense(spark, sf)


def codebase(spark, sf):
    """Documents as chunks: every third inactive; odd ids are questions of the even id before them."""
    d = with_path(load(spark, sf, "documents"))
    kind = F.when(F.col("doc_id") % 2 == 1, "hyde").otherwise("code")
    parent = F.when(F.col("doc_id") % 2 == 1, F.col("doc_id") - 1)
    return d.select(F.col("doc_id").alias("chunk_id"), F.col("path").alias("file_path"), (F.col("doc_id") % 3 != 0).alias("active"), kind.alias("kind"), parent.alias("parent_chunk_id"), "source", "lang")


@query(
    "search_dense_hydrated",
    f"WITH h AS ({DENSE.format(k=10)}), c AS (SELECT doc_id, source, {PATH} AS p FROM documents WHERE doc_id % 3 <> 0) SELECT query_id, vec_id, rank::INT AS rank, round(score * {PENALTY.replace('(p,', '(lower(p),')}, 9) AS score, p AS file_path FROM h JOIN c ON vec_id = doc_id",
)
def search_dense_hydrated(spark, sf):
    book = Catalog()
    book.register("docs", Codebase(codebase(spark, sf), load(spark, sf, "embeddings")))
    return book.use("docs").search(queries_of(spark, sf)).select("query_id", "vec_id", "rank", "score", "file_path")


HYBRID = f"""WITH h AS ({DENSE.format(k=40)}), o AS (SELECT query_id, CASE WHEN vec_id % 2 = 1 THEN vec_id - 1 ELSE vec_id END AS chunk_id, CASE WHEN vec_id % 2 = 1 THEN 0 ELSE score END AS c, CASE WHEN vec_id % 2 = 1 THEN score ELSE 0 END AS y FROM h),
 g AS (SELECT query_id, chunk_id, greatest(max(c), 0) AS code_score, greatest(max(y), 0) AS hyde_boost FROM o GROUP BY 1, 2),
 s AS (SELECT *, round(code_score::DOUBLE + 0.5::DOUBLE * hyde_boost, 7) AS score FROM g),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s)"""


def _kinds(vectors):
    """Odd vectors are questions of the even one before them."""
    odd = F.col("vec_id") % 2 == 1
    return vectors.withColumn("kind", F.when(odd, "hyde").otherwise("code")).withColumn("parent_chunk_id", F.when(odd, F.col("vec_id") - 1))


@query("hyde_parent_boost", f"{HYBRID} SELECT query_id, chunk_id, code_score::DOUBLE AS code_score, hyde_boost::DOUBLE AS hyde_boost, score::DOUBLE AS score, rank::INT AS rank FROM r WHERE rank <= 10")
def hyde_parent_boost(spark, sf):
    return search.parent_boost(_kinds(dense(spark, sf, 40)), "query_id", "vec_id", "kind", "parent_chunk_id")


@query("search_hybrid", f"{HYBRID} SELECT query_id, chunk_id, rank::INT AS rank, round(score * {PENALTY.replace('(p,', '(lower(p),')}, 9)::DOUBLE AS score FROM r JOIN (SELECT doc_id, {PATH} AS p FROM documents WHERE doc_id % 3 <> 0) ON chunk_id = doc_id WHERE rank <= 10")
def search_hybrid(spark, sf):
    book = Catalog()
    book.register("docs", Codebase(codebase(spark, sf), _kinds(load(spark, sf, "embeddings"))))
    return book.use("docs").search_hybrid(queries_of(spark, sf)).select("query_id", "chunk_id", "rank", "score")


def words_hits(spark, sf, k=10):
    w = F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9_]+)"), F.lit(1))
    q = load(spark, sf, "benchmark").select("item_id", F.explode(lexical.fts_terms("text")).alias("qterm"))
    return lexical.bm25(q, lexical.postings(load(spark, sf, "documents"), "doc_id", w), "item_id", k)


def shape_hits(spark, sf, k=10):
    q = lexical.sparse_blocks(load(spark, sf, "benchmark"), "item_id", "text", "q_")
    return lexical.sparse_top_k(q, lexical.sparse_blocks(load(spark, sf, "documents"), "doc_id", "text"), "item_id", "doc_id", k)


BM = BM25.format(words=WORDS.format("text"), qwords=WORDS.format("text"), matched="SELECT doc_id, term AS qterm, tf, dl FROM p WHERE term IN (SELECT qterm FROM q)")
from trawl.plans.text_queries import SPARSE  # noqa: E402

SP = f"""WITH d AS ({SPARSE.format('doc_id', 'documents')}), q AS ({SPARSE.format('item_id', 'benchmark')}), s AS (SELECT item_id, doc_id, round(sum(d.w * q.w), 6) AS score FROM d JOIN q USING (idx) GROUP BY 1, 2)
 SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10"""
BOTH = f"a AS ({BM}), b AS ({SP})"


@query("rrf_fusion", f"WITH {BOTH}, u AS (SELECT item_id, doc_id, rank FROM a UNION ALL SELECT item_id, doc_id, rank FROM b), s AS (SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM u GROUP BY 1, 2) SELECT item_id, doc_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 30")
def rrf_fusion(spark, sf):
    u = words_hits(spark, sf).unionByName(shape_hits(spark, sf))
    return search.rrf(u, "item_id", ["doc_id"])


@query("rrf_by_file", f"WITH {BOTH}, u AS (SELECT item_id, doc_id, rank, 1.0 AS w FROM a UNION ALL SELECT item_id, doc_id, rank, 0.8 FROM b), s AS (SELECT item_id, source, round(sum(w::DOUBLE / (20 + rank)), 8) AS score FROM u JOIN documents USING (doc_id) GROUP BY 1, 2) SELECT item_id, source, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, source) AS rank FROM s) WHERE rank <= 30")
def rrf_by_file(spark, sf):
    u = words_hits(spark, sf).withColumn("w", F.lit(1.0)).unionByName(shape_hits(spark, sf).withColumn("w", F.lit(0.8)))
    return search.rrf(u.join(load(spark, sf, "documents").select("doc_id", "source"), "doc_id"), "item_id", ["source"], k=20, weight="w")


@query("hybrid_additive", f"WITH {BOTH} SELECT item_id, doc_id, score, reasons, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM (SELECT coalesce(a.item_id, b.item_id) AS item_id, coalesce(a.doc_id, b.doc_id) AS doc_id, round(coalesce(b.score, 0) + CASE WHEN a.doc_id IS NOT NULL THEN 1.0 ELSE 0 END, 6) AS score, concat_ws('+', CASE WHEN b.doc_id IS NOT NULL THEN 'vector' END, CASE WHEN a.doc_id IS NOT NULL THEN 'fts' END) AS reasons FROM a FULL JOIN b ON a.item_id = b.item_id AND a.doc_id = b.doc_id)")
def hybrid_additive(spark, sf):
    return search.additive(shape_hits(spark, sf), words_hits(spark, sf), "item_id", "doc_id")


@query("candidate_union", f"WITH {BOTH} SELECT coalesce(a.item_id, b.item_id) AS item_id, coalesce(a.doc_id, b.doc_id) AS doc_id, greatest(a.score, b.score) AS score, concat_ws('+', CASE WHEN a.doc_id IS NOT NULL THEN 'words' END, CASE WHEN b.doc_id IS NOT NULL THEN 'sparse' END) AS source FROM a FULL JOIN b ON a.item_id = b.item_id AND a.doc_id = b.doc_id")
def candidate_union(spark, sf):
    return search.candidate_union(words_hits(spark, sf).withColumn("source", F.lit("words")), shape_hits(spark, sf).withColumn("source", F.lit("sparse")), "item_id", "doc_id")


PARTS = f"""q AS (SELECT item_id, list_sort(list_distinct({TOKENS.format('text')})) AS terms FROM benchmark),
 c AS (SELECT doc_id, text, {PATH} AS p, list_sort(list_distinct(regexp_extract_all(text, '[A-Za-z]+'))) AS symbols FROM documents),
 k AS (SELECT *, list_sort(list_distinct(list_transform(list_filter(regexp_split_to_array(p, '[^A-Za-z0-9_]+'), lambda x: x <> ''), lambda x: lower(x)))) AS path_tokens FROM c),
 e AS (SELECT item_id, doc_id, max(o) AS o, min(o) AS f FROM (SELECT DISTINCT item_id, unnest(terms[1:40]) AS t FROM q) JOIN (SELECT doc_id, 0 AS o, unnest(symbols) AS t FROM k UNION ALL SELECT doc_id, 1, unnest(path_tokens) FROM k) USING (t) GROUP BY 1, 2),
 x AS (SELECT item_id, doc_id, 1.0::DOUBLE AS score, CASE o WHEN 0 THEN 'symbols_defined' ELSE 'path_tokens' END AS source FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY f, doc_id) AS r FROM e) WHERE r <= 50)"""


def _chunks(spark, sf, only=None):
    from trawl.functions import code

    d = with_path(load(spark, sf, "documents"))
    d = d if only is None else d.join(only, "doc_id", "left_semi")
    s = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))))
    return d.select("doc_id", F.col("text").alias("content"), "path", s.alias("symbols_defined"), code.path_tokens("path").alias("path_tokens"))


def _terms(spark, sf):
    return load(spark, sf, "benchmark").select("item_id", text.query_terms("text").alias("terms"))


@query("exact_candidates", f"WITH {PARTS} SELECT item_id, doc_id, score, source FROM x")
def exact_candidates(spark, sf):
    return search.exact_candidates(_terms(spark, sf), _chunks(spark, sf), "item_id", "doc_id")


@query(
    "rerank_deterministic",
    f"""WITH {PARTS}, y AS (SELECT item_id, doc_id, score, source, terms, lower(left(text, 60)) AS sign, lower(text) AS body, symbols, path_tokens, CASE WHEN doc_id % 8 = 0 THEN 'test' ELSE 'x' END AS role, CASE WHEN doc_id % 5 = 0 THEN 'function' ELSE 'module' END AS typ, doc_id % 2 = 1 AS hq FROM x JOIN q USING (item_id) JOIN k USING (doc_id)),
 z AS (SELECT *, list_has_any(list_transform(symbols, lambda s: lower(s)), terms) AS r1, list_has_any(path_tokens, terms) AS r2, len(list_filter(terms, lambda t: contains(sign, t))) > 0 AS r3, len(list_filter(terms[1:20], lambda t: contains(body, t))) > 0 AS r4 FROM y),
 w AS (SELECT *, round(score + CASE WHEN r1 THEN 0.35 ELSE 0 END + CASE WHEN r3 THEN 0.2 ELSE 0 END + CASE WHEN r2 THEN 0.15 ELSE 0 END + CASE WHEN r4 THEN 0.08 ELSE 0 END + CASE WHEN role = 'test' THEN CASE WHEN list_has_any(terms, ['test', 'tests', 'spec', 'coverage']) THEN 0.1 ELSE -0.08 END ELSE 0 END + CASE WHEN typ = 'function' THEN 0.05 ELSE 0 END, 6) AS total FROM z)
 SELECT item_id, doc_id, total::DOUBLE AS score, rank::INT AS rank, CASE WHEN total >= 0.75 OR r1 THEN 'high' WHEN total >= 0.45 THEN 'medium' ELSE 'low' END AS confidence,
 concat_ws(' ', source, CASE WHEN r1 THEN 'exact_symbol' END, CASE WHEN r2 THEN 'path_token' END, CASE WHEN r3 THEN 'signature' END, CASE WHEN r4 THEN 'lexical_content' END, CASE WHEN hq THEN 'semantic_hyde' END, CASE WHEN NOT (r1 OR r2 OR r3 OR r4 OR hq) THEN 'semantic_similarity' END) AS match_reasons
 FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY total DESC, doc_id) AS rank FROM w) WHERE rank <= 5""",
)
def rerank_deterministic(spark, sf):
    found = search.exact_candidates(_terms(spark, sf), _chunks(spark, sf), "item_id", "doc_id")
    of = _chunks(spark, sf, found.select("doc_id").distinct())  # what a chunk says of itself is worked out for candidates alone
    found = found.join(_terms(spark, sf), "item_id").join(of, "doc_id")
    role = F.when(F.col("doc_id") % 8 == 0, "test").otherwise("x")
    kind = F.when(F.col("doc_id") % 5 == 0, "function").otherwise("module")
    found = found.withColumns({"signature": F.left("content", F.lit(60)), "file_role": role, "chunk_type": kind, "has_questions": F.col("doc_id") % 2 == 1})
    return search.rerank(found, "item_id", "doc_id").select("item_id", "doc_id", "score", "rank", "confidence", joined("match_reasons").alias("match_reasons"))


@query("overlap_rerank", f"WITH a AS ({BM}), w AS (SELECT a.item_id, a.doc_id, a.rank, list_distinct({WORDS.format('b.text')}) AS t, list_distinct({WORDS.format('d.text')}) AS u FROM a JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id)) SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY len(list_intersect(t, u)) / greatest(len(t), 1) DESC, rank)::INT AS rank FROM w")
def overlap_rerank(spark, sf):
    w = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9_]+)"), F.lit(1)))
    hits = words_hits(spark, sf).join(load(spark, sf, "benchmark").select("item_id", w("text").alias("t")), "item_id").join(load(spark, sf, "documents").select("doc_id", w("text").alias("u")), "doc_id")
    return search.scored_rerank(search.overlap_scorer(hits, "t", "u"), "item_id").select("item_id", "doc_id", "rank")


PARTED = f"""WITH h AS ({DENSE.format(k=40)}), c AS (SELECT *, CASE WHEN vec_id % 2 = 1 THEN 'hyde' ELSE 'code' END AS kind FROM h),
 r AS (SELECT query_id, kind, CASE WHEN kind = 'hyde' THEN vec_id - 1 ELSE vec_id END AS chunk_id, row_number() OVER (PARTITION BY query_id, kind ORDER BY score DESC, vec_id) AS rank FROM c)"""
FUSED = "SELECT query_id, chunk_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= "


@query("channel_rrf", f"{PARTED}, b AS (SELECT query_id, kind, chunk_id, min(rank) AS rank FROM r GROUP BY 1, 2, 3), s AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM b GROUP BY 1, 2) {FUSED} 10")
def channel_rrf(spark, sf):
    return search.channel_rrf(_kinds(dense(spark, sf, 40)), "query_id", "vec_id", "kind", "parent_chunk_id").select("query_id", "chunk_id", "score", "rank")


SELF = f"""SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM
 (SELECT q.doc_id AS query_id, d.doc_id, round(sum(d.w * q.w), 6) AS score FROM sv d JOIN sv q USING (idx) WHERE q.doc_id % 100 = 0 GROUP BY 1, 2)) WHERE rank <= 40"""
KEYS = {"hyde": "vec_id % 2 = 1", "code": "vec_id % 2 = 0", "summary": "vec_id % 4 = 0"}


@query(
    "multi_channel_rrf",
    f"WITH e AS ({DENSE.format(k=1000000)}), sv AS ({SPARSE.format('doc_id', 'documents')}), u AS (SELECT query_id, doc_id AS vec_id, rank FROM ({SELF}) UNION ALL "
    + " UNION ALL ".join(f"SELECT query_id, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT query_id, vec_id, score FROM e WHERE {cond})) WHERE rank <= {20 if name == 'summary' else 40}" for name, cond in KEYS.items())
    + "), s AS (SELECT query_id, vec_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM u GROUP BY 1, 2) SELECT query_id, vec_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 40",
)
def multi_channel_rrf(spark, sf):
    """Question, code and summary vectors (here by id) and sparse text, each ranked by itself, then fused."""
    e, q = load(spark, sf, "embeddings"), queries_of(spark, sf)
    channels = {name: search.dense_top_k(q, e.where(cond), "query_id", "vec_id", "embedding", "query_vec", 40) for name, cond in KEYS.items()}
    d = load(spark, sf, "documents")
    asked = lexical.sparse_blocks(d.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"), "query_id", "text", "q_")
    channels["sparse"] = lexical.sparse_top_k(asked, lexical.sparse_blocks(d, "doc_id", "text"), "query_id", "doc_id", 40).withColumnRenamed("doc_id", "vec_id")
    return search.channels_rrf(channels, "query_id", "vec_id")


@query(
    "rerank_listwise",
    f"""WITH a AS ({BM}), b AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rank) - 1 AS i, count(*) OVER (PARTITION BY item_id) AS n FROM a),
 v AS (SELECT item_id, n, list_filter(CASE WHEN item_id % 3 = 0 THEN [2, 0, 99, 0, -1, 1] ELSE [n - 1, 1, 0] END, lambda x: x >= 0 AND x < n)[1:5] AS l FROM (SELECT DISTINCT item_id, n FROM b)),
 p AS (SELECT item_id, unnest(l) AS i, unnest(range(len(l))) + 1 AS rank FROM v WHERE n > 1 AND item_id % 5 <> 0)
 SELECT b.item_id, b.doc_id, p.rank::INT AS rank, true AS reranked, false AS fallback FROM b JOIN p USING (item_id, i)
 UNION ALL SELECT item_id, doc_id, (i + 1)::INT, false, n > 1 FROM b WHERE n <= 1 OR (item_id % 5 = 0 AND i < 5)""",
)
def rerank_listwise(spark, sf):
    """Places from a ranker that names some twice, some that are not there, and fails for every fifth text."""

    def ranker(hits):
        if hits[0]["item_id"] % 5 == 0:
            raise ValueError("no reply")
        return [2, 0, 99, 0, -1, 1] if hits[0]["item_id"] % 3 == 0 else [len(hits) - 1, 1, 0]

    return search.listwise_rerank(words_hits(spark, sf), "item_id", ranker, 5).select("item_id", "doc_id", "rank", "reranked", "fallback")


@query("publication_cutover", f"WITH h AS ({DENSE.format(k=10)}), p AS (SELECT source, 'run-' || max(doc_id) % 2 AS active_run FROM documents GROUP BY 1) SELECT query_id, vec_id, rank::INT AS rank, active_run FROM h JOIN documents d ON d.doc_id = vec_id JOIN p USING (source) WHERE 'run-' || (vec_id // 2) % 2 = active_run")
def publication_cutover(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "source")
    pointer = d.groupBy("source").agg(F.concat(F.lit("run-"), (F.max("doc_id") % 2).cast("string")).alias("run_id"))
    hits = dense(spark, sf).join(d, F.col("vec_id") == F.col("doc_id")).withColumn("run_id", F.concat(F.lit("run-"), (F.floor(F.col("vec_id") / 2) % 2).cast("string")))
    return search.routed(hits, pointer, "source").select("query_id", "vec_id", "rank", "active_run")


#: A golden document for each benchmark text: those that hold it; the grade is their quality plus one.
GOLD = "gold AS (SELECT item_id, doc_id, coalesce(quality, 0) + 1 AS grade FROM benchmark b JOIN documents d ON contains(d.text, b.text) LEFT JOIN labels USING (doc_id))"


def golden(spark, sf):
    held = evals.holders(load(spark, sf, "benchmark"), load(spark, sf, "documents"), "item_id", "doc_id")
    return held.join(load(spark, sf, "labels"), "doc_id", "left").select("item_id", "doc_id", (F.coalesce("quality", F.lit(0)) + 1).alias("grade"))


MRR = f"WITH a AS ({BM}), {GOLD}, h AS (SELECT a.item_id, a.rank, g.doc_id IS NOT NULL AS hit FROM a LEFT JOIN gold g ON g.item_id = a.item_id AND g.doc_id = a.doc_id) SELECT item_id, max(CASE WHEN hit THEN 1 ELSE 0 END)::INT AS success, round(coalesce(1.0::DOUBLE / min(CASE WHEN hit THEN rank END), 0), 6) AS mrr FROM h GROUP BY 1"


def _flagged(spark, sf):
    g = golden(spark, sf).withColumn("hit", F.lit(True))
    return words_hits(spark, sf).join(g, ["item_id", "doc_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


@query("eval_mrr", MRR)
def eval_mrr(spark, sf):
    return evals.binary_metrics(_flagged(spark, sf), "item_id", "hit")


@query(
    "eval_ndcg",
    f"""WITH a AS ({BM}), {GOLD}, i AS (SELECT item_id, sum((pow(2, grade) - 1) / log2(r + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY grade DESC, doc_id) AS r FROM gold) WHERE r <= 10 GROUP BY 1),
 g AS (SELECT a.item_id, sum((pow(2, grade) - 1) / log2(rank + 1)) AS got FROM a JOIN gold ON gold.item_id = a.item_id AND gold.doc_id = a.doc_id GROUP BY 1) SELECT item_id, round(coalesce(got, 0) / ideal, 6) AS ndcg FROM i LEFT JOIN g USING (item_id)""",
)
def eval_ndcg(spark, sf):
    return evals.graded_ndcg(words_hits(spark, sf), golden(spark, sf), "item_id", "doc_id")


@query(
    "eval_greedy",
    f"""WITH a AS ({BM}), {GOLD}, i AS (SELECT item_id, sum((pow(2, grade) - 1) / log2(r + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY grade DESC) AS r FROM gold) WHERE r <= 10 GROUP BY 1),
 g AS (SELECT gold.item_id, min(rank) AS first, sum((pow(2, grade) - 1) / log2(rank + 1)) AS got FROM a JOIN gold ON gold.item_id = a.item_id AND gold.doc_id = a.doc_id WHERE rank <= 10 GROUP BY 1)
 SELECT item_id, (first IS NOT NULL)::INT::DOUBLE AS recall, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr, round(coalesce(got, 0) / ideal, 6) AS ndcg FROM i LEFT JOIN g USING (item_id)""",
)
def eval_greedy(spark, sf):
    """Greedy graded matching, which is sequential; equal to eval_ndcg where each document is one item."""
    g = golden(spark, sf).groupBy("item_id").agg(F.collect_list(F.struct(F.col("doc_id").cast("string").alias("file"), F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"), "grade")).alias("relevant"))
    r = words_hits(spark, sf).select("item_id", "rank", F.col("doc_id").cast("string").alias("file"), F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"))
    return evals.evaluate(r, g, "item_id").select("item_id", "recall", F.round("mrr", 6).alias("mrr"), F.round("ndcg", 6).alias("ndcg"))


@query("eval_summary", f"SELECT count(*) AS n, round(avg(success), 6) AS recall, round(avg(mrr), 6) AS mrr FROM ({MRR})")
def eval_summary(spark, sf):
    return eval_mrr(spark, sf).agg(F.count("*").alias("n"), F.round(F.avg("success"), 6).alias("recall"), F.round(F.avg("mrr"), 6).alias("mrr"))


@query("eval_by_type", f"SELECT 'type' || (item_id % 6)::INT AS type, count(*) AS n, round(avg(success), 6) AS recall, round(avg(mrr), 6) AS mrr FROM ({MRR}) GROUP BY 1")
def eval_by_type(spark, sf):
    return eval_mrr(spark, sf).groupBy(F.concat(F.lit("type"), (F.col("item_id") % 6).cast("string")).alias("type")).agg(F.count("*").alias("n"), F.round(F.avg("success"), 6).alias("recall"), F.round(F.avg("mrr"), 6).alias("mrr"))


@query("eval_compare", f"WITH x AS ({MRR}), y AS (WITH b AS ({SP}), {GOLD}, h AS (SELECT b.item_id, b.rank, g.doc_id IS NOT NULL AS hit FROM b LEFT JOIN gold g ON g.item_id = b.item_id AND g.doc_id = b.doc_id) SELECT item_id, round(coalesce(1.0::DOUBLE / min(CASE WHEN hit THEN rank END), 0), 6) AS mrr FROM h GROUP BY 1) SELECT item_id, x.mrr AS a, y.mrr AS b, CASE WHEN x.mrr - y.mrr > 0.01 THEN 'a' WHEN y.mrr - x.mrr > 0.01 THEN 'b' ELSE 'tie' END AS verdict FROM x JOIN y USING (item_id)")
def eval_compare(spark, sf):
    g = golden(spark, sf).withColumn("hit", F.lit(True))
    flag = lambda h: h.join(g, ["item_id", "doc_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    a = evals.binary_metrics(flag(words_hits(spark, sf)), "item_id", "hit").select("item_id", F.col("mrr").alias("a"))
    b = evals.binary_metrics(flag(shape_hits(spark, sf)), "item_id", "hit").select("item_id", F.col("mrr").alias("b"))
    return a.join(b, "item_id").withColumn("verdict", evals.verdict("a", "b"))


@query("eval_linear_ndcg", f"WITH a AS ({BM}), {GOLD}, h AS (SELECT a.item_id, a.rank, coalesce(grade, 0) AS grade FROM a LEFT JOIN gold g ON g.item_id = a.item_id AND g.doc_id = a.doc_id), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY grade DESC, rank) AS best FROM h) SELECT item_id, round(CASE WHEN sum(grade / log2(best + 1)) > 0 THEN sum(grade / log2(rank + 1)) / sum(grade / log2(best + 1)) ELSE 0 END, 6)::DOUBLE AS ndcg FROM r GROUP BY 1")
def eval_linear_ndcg(spark, sf):
    h = words_hits(spark, sf).join(golden(spark, sf), ["item_id", "doc_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    return evals.linear_ndcg(h, "item_id", "grade")


@query("eval_range_join", "WITH r AS (SELECT doc_id, source AS file, doc_id % 50 AS s, doc_id % 50 + 10 AS e FROM documents), g AS (SELECT source AS file, (doc_id * 7) % 60 AS s, (doc_id * 7) % 60 + 5 AS e, doc_id AS gold_id FROM documents) SELECT doc_id, count(*) AS n, min(gold_id) AS first_gold FROM r JOIN g ON r.file = g.file AND r.s <= g.e AND r.e >= g.s GROUP BY 1")
def eval_range_join(spark, sf):
    d = load(spark, sf, "documents")
    r = d.select("doc_id", F.col("source").alias("file"), (F.col("doc_id") % 50).alias("s"), (F.col("doc_id") % 50 + 10).alias("e"))
    own = [F.col("source").alias("gfile"), ((F.col("doc_id") * 7) % 60).alias("gs"), ((F.col("doc_id") * 7) % 60 + 5).alias("ge")]
    g = d.groupBy(*own).agg(F.count("*").alias("_n"), F.min("doc_id").alias("_first"))  # a row for each range, not for each document
    return r.join(g, evals.overlaps("file", "s", "e", "gfile", "gs", "ge")).groupBy("doc_id").agg(F.sum("_n").alias("n"), F.min("_first").alias("first_gold"))


@query("latency_p95", "SELECT event_type, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.5) AS p50 FROM events GROUP BY 1")
def latency_p95(spark, sf):
    return load(spark, sf, "events").groupBy("event_type").agg(evals.nearest_rank("value", 0.95).alias("p95"), evals.nearest_rank("value", 0.5).alias("p50"))


@query("latency_p95_floor", "SELECT event_type, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE r = least(floor(0.95 * n), n - 1)")
def latency_p95_floor(spark, sf):
    return evals.floor_rank(load(spark, sf, "events"), ["event_type"], "value", 0.95)


@query("identifier_hits", r"WITH i AS (SELECT conv_id, list_distinct(regexp_extract_all(text, '[A-Za-z_]{5,}')) AS ids FROM conversations WHERE turn = 0) SELECT c.conv_id, c.turn, len(list_filter(ids, lambda x: contains(c.text, x)))::INT AS hits FROM conversations c JOIN i USING (conv_id)")
def identifier_hits(spark, sf):
    c = load(spark, sf, "conversations")
    i = c.where("turn = 0").select("conv_id", F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Za-z_]{5,})"), F.lit(1))).alias("ids"))
    return c.join(i, "conv_id").select("conv_id", "turn", evals.identifier_hits("text", "ids").alias("hits"))


#: The form of a query, as tuning.query_type has it.
TYPES = r"""CASE WHEN regexp_matches(t, '(^|\s)[\w.-]*/[\w./-]+(\s|$)') OR (n = 1 AND regexp_matches(t, '^[\w-]+(\.[a-z]{2,5})+$')) THEN 'path'
 WHEN n = 1 AND (regexp_matches(t, '[a-z][A-Z0-9]') OR regexp_matches(t, '\w_\w') OR regexp_matches(t, '\w(\.|::)\w') OR regexp_matches(t, '\w\(.*\)$')) THEN 'symbol'
 WHEN regexp_matches(t, '(?i)\b(error|exception|traceback|failed|fatal|undefined|cannot)\b') OR regexp_matches(t, '\b0x[0-9a-fA-F]{4,}\b') THEN 'error'
 WHEN regexp_replace(lower(ws[1]), '[^a-z]', '', 'g') IN ('how', 'what', 'where', 'when', 'why', 'which', 'who', 'does', 'do', 'is', 'are', 'can', 'should') OR ends_with(t, '?') THEN 'question'
 WHEN n <= 3 THEN 'keywords' ELSE 'prose' END"""
ASKED = r"""(SELECT item_id, CASE item_id % 7 WHEN 0 THEN w[1] WHEN 1 THEN concat('src/', w[1], '/', w[2], '.py') WHEN 2 THEN concat('how ', text) WHEN 3 THEN concat(w[1], '_', w[2]) WHEN 4 THEN concat(w[1], ' ', w[2]) WHEN 5 THEN concat(text, ' failed') ELSE text END AS asked
 FROM (SELECT item_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM benchmark))"""
TYPED = rf"SELECT item_id, {TYPES} AS type FROM (SELECT *, len(ws) AS n FROM (SELECT item_id, trim(asked) AS t, list_filter(regexp_split_to_array(trim(asked), '\s+'), lambda x: x <> '') AS ws FROM {ASKED}))"


def typed(spark, sf):
    """A form for each benchmark text, in turn: a word, a path, a question, a symbol, two words, an error, the text itself."""
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    word = lambda i: F.coalesce(F.try_element_at(w, F.lit(i)), F.lit(""))
    forms = [word(1), F.concat(F.lit("src/"), word(1), F.lit("/"), word(2), F.lit(".py")), F.concat(F.lit("how "), "text"), F.concat(word(1), F.lit("_"), word(2)), F.concat(word(1), F.lit(" "), word(2)), F.concat("text", F.lit(" failed")), F.col("text")]
    asked = forms[-1]
    for i, form in enumerate(forms[:-1]):
        asked = F.when(F.col("item_id") % 7 == i, form).otherwise(asked)
    return load(spark, sf, "benchmark").select("item_id", tuning.query_type(asked).alias("type"))


@query("query_types", TYPED)
def query_types(spark, sf):
    return typed(spark, sf)


GRID = f"""{BOTH}, {GOLD}, c AS (SELECT k, w FROM (SELECT unnest([5, 10, 20, 30, 60]) AS k) CROSS JOIN (SELECT unnest([0.8, 1.0, 1.5, 2.0])::DOUBLE AS w)),
 j AS (SELECT item_id, doc_id, a.rank AS ra, b.rank AS rb FROM a FULL JOIN b USING (item_id, doc_id)),
 f AS (SELECT item_id, doc_id, k, w, coalesce(grade, 0) AS grade, round(coalesce(w / (k + ra), 0::DOUBLE) + coalesce(1::DOUBLE / (k + rb), 0::DOUBLE), 8) AS score FROM j LEFT JOIN gold USING (item_id, doc_id) CROSS JOIN c),
 r AS (SELECT *, row_number() OVER (PARTITION BY item_id, k, w ORDER BY score DESC, doc_id) AS r FROM f),
 g AS (SELECT item_id, k, w, sum((pow(2, grade) - 1) / log2(r + 1)) AS got FROM r WHERE r <= 10 GROUP BY ALL),
 i AS (SELECT item_id, sum((pow(2, grade) - 1) / log2(r + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY grade DESC, doc_id) AS r FROM gold) WHERE r <= 10 GROUP BY 1),
 s AS (SELECT i.item_id, c.k, c.w, round(coalesce(got, 0) / ideal, 6) AS ndcg FROM i CROSS JOIN c LEFT JOIN g ON g.item_id = i.item_id AND g.k = c.k AND g.w = c.w),
 y AS ({TYPED}), z AS (SELECT type, k, w, count(*) AS n, round(avg(ndcg), 6) AS ndcg FROM s JOIN y USING (item_id) GROUP BY ALL)"""


def _tuned(spark, sf, words, sparse):
    scores = tuning.grid_ndcg(words, sparse, golden(spark, sf), "item_id", "doc_id")
    return tuning.by_type(scores, typed(spark, sf), "item_id")


@query("fusion_grid", f"WITH {GRID} SELECT type, k, w, n, ndcg FROM z")
def fusion_grid(spark, sf):
    """A row for each cell of the grid and type of query: the mean nDCG of the fused word and sparse lists."""
    return _tuned(spark, sf, words_hits(spark, sf), shape_hits(spark, sf))


@query(
    "fusion_routed",
    f"""WITH {GRID}, o AS (SELECT type, k, w FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY ndcg DESC, k DESC, abs(w - 1), w) AS n1 FROM z) WHERE n1 = 1),
 u AS (SELECT item_id, doc_id, rank, true AS words FROM a UNION ALL SELECT item_id, doc_id, rank, false FROM b),
 h AS (SELECT item_id, doc_id, type, round(sum(CASE WHEN words THEN coalesce(w, 1) ELSE 1 END / (coalesce(k, 60) + rank)), 8) AS score FROM u JOIN y USING (item_id) LEFT JOIN o USING (type) GROUP BY ALL)
 SELECT item_id, doc_id, type, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM h) WHERE rank <= 10""",
)
def fusion_routed(spark, sf):
    """Each query fused with the constants that suit its type best."""
    channels = {"words": written(words_hits(spark, sf), "words"), "sparse": written(shape_hits(spark, sf), "sparse")}  # searched once, read twice
    routes = tuning.chosen(_tuned(spark, sf, channels["words"], channels["sparse"]))
    return tuning.routed_fusion(channels, "words", typed(spark, sf), routes, "item_id", "doc_id").select("item_id", "doc_id", "type", "score", "rank")


#: Documents as code: the long words of the first line are what it defines, those of the rest what it uses.
LINKS = r"""c AS (SELECT doc_id, list_distinct(regexp_extract_all(regexp_extract(coalesce(text, ''), '^[^\n]*'), '[A-Za-z]{4,}')) AS def, list_distinct(regexp_extract_all(regexp_replace(coalesce(text, ''), '^[^\n]*', ''), '[A-Za-z]{4,}')) AS use FROM documents),
 f AS (SELECT doc_id, symbol FROM (SELECT doc_id, symbol, count(*) OVER (PARTITION BY symbol) AS n FROM (SELECT doc_id, unnest(def) AS symbol FROM c)) WHERE n <= 8),
 e AS (SELECT DISTINCT u.doc_id AS caller, f.doc_id AS callee FROM (SELECT doc_id, unnest(list_filter(use, lambda x: NOT list_contains(def, x))) AS symbol FROM c) u JOIN f USING (symbol) WHERE u.doc_id <> f.doc_id)"""


def _code(spark, sf):
    first, rest = F.regexp_extract(F.coalesce("text", F.lit("")), r"^[^\n]*", 0), F.regexp_replace(F.coalesce("text", F.lit("")), r"^[^\n]*", "")
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("([A-Za-z]{4,})"), F.lit(1)))
    return load(spark, sf, "documents").select("doc_id", words(first).alias("symbols_defined"), words(rest).alias("symbols_used"), F.when(F.col("doc_id") % 8 == 0, "test").otherwise("x").alias("file_role"))


@query(
    "graph_context",
    f"""WITH h AS ({DENSE.format(k=10)}), {LINKS}, o AS (SELECT DISTINCT vec_id FROM h),
 b AS (SELECT caller AS vec_id, 'calls' AS kind, callee AS other FROM e UNION ALL SELECT callee, CASE WHEN caller % 8 = 0 THEN 'tests' ELSE 'called_by' END, caller FROM e),
 g AS (SELECT vec_id, kind, count(*) AS n, array_to_string(list(other ORDER BY other)[1:20], ' ') AS ids FROM b WHERE vec_id IN (SELECT vec_id FROM o) GROUP BY ALL)
 SELECT o.vec_id, coalesce(x.ids, '') AS calls, coalesce(y.ids, '') AS called_by, coalesce(z.ids, '') AS tests, coalesce(x.n, 0) AS n_calls, coalesce(y.n, 0) AS n_called_by, coalesce(z.n, 0) AS n_tests
 FROM o LEFT JOIN g x ON x.vec_id = o.vec_id AND x.kind = 'calls' LEFT JOIN g y ON y.vec_id = o.vec_id AND y.kind = 'called_by' LEFT JOIN g z ON z.vec_id = o.vec_id AND z.kind = 'tests'""",
)
def graph_context(spark, sf):
    """What the hits of dense search call, what calls them, and which tests do."""
    chunks = _code(spark, sf)
    found = graph.context(dense(spark, sf), graph.edges(chunks, "doc_id"), chunks, "vec_id", "doc_id")
    return found.select("vec_id", *(joined(F.transform(c, lambda x: x.cast("string"))).alias(c) for c in ("calls", "called_by", "tests")), "n_calls", "n_called_by", "n_tests")


@query(
    "graph_neighbours",
    f"""WITH h AS ({DENSE.format(k=10)}), {LINKS}, t AS (SELECT caller AS vec_id, callee AS other FROM e UNION ALL SELECT callee, caller FROM e),
 m AS (SELECT query_id, vec_id, score FROM h UNION ALL SELECT query_id, other, 0.5::DOUBLE * score FROM h JOIN t USING (vec_id)),
 s AS (SELECT query_id, vec_id, round(max(score), 6) AS score FROM m GROUP BY ALL)
 SELECT query_id, vec_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""",
)
def graph_neighbours(spark, sf):
    return graph.neighbours(dense(spark, sf), graph.edges(_code(spark, sf), "doc_id"), "query_id", "vec_id", k=20)
