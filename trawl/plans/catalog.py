"""Codebases by slug: list, register, select, search. A session remembers its selection."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions.paths import confidence
from trawl.functions.text import clamp
from trawl.operators import search as S

LIMIT, LIMIT_MOST, CANDIDATES, CANDIDATES_MOST, GATEWAY_MOST = 5, 20, 50, 200, 50
#: What a shaped hit carries of its chunk, as far as the chunks have it.
SHOWN = ("start_line", "end_line", "line_range", "chunk_type", "language", "file_role", "signature", "symbols_defined", "what_it_does", "file_skeleton", "match_reasons", "next_queries")


def clamped(limit: int | None = None, candidates: int | None = None) -> tuple[int, int]:
    """limit to 1..20 (default 5), candidates to limit..200 (default 50)."""
    k = min(max(LIMIT if limit is None else limit, 1), LIMIT_MOST)
    return k, min(max(CANDIDATES if candidates is None else candidates, k), CANDIDATES_MOST)


def clamped_columns(limit: Column, candidates: Column) -> tuple[Column, Column]:
    """The same for columns; null takes the default."""
    k = clamp(F.coalesce(limit, F.lit(LIMIT)), 1, LIMIT_MOST)
    return k, F.least(F.greatest(F.coalesce(candidates, F.lit(CANDIDATES)), k), F.lit(CANDIDATES_MOST))


def shaped(found: DataFrame, snippet: int = 200) -> DataFrame:
    """Hits as callers see them: query_id, id, rank, file, score, raw_score, confidence, snippet, and the metadata that the chunks have."""
    known = [c for c in SHOWN if c in found.columns]
    start = F.replace(F.left(F.coalesce("text", F.lit("")), F.lit(snippet)), F.lit("\n"), F.lit(" ")) if "text" in found.columns else F.lit(None).cast("string")
    exact = F.array_contains("match_reasons", "exact_symbol") if "match_reasons" in found.columns else F.lit(False)
    raw = "raw_score" if "raw_score" in found.columns else "score"
    return found.select("query_id", F.col("vec_id").cast("string").alias("id"), "rank", F.col("file_path").alias("file"), "score", F.col(raw).alias("raw_score"), confidence("score", exact).alias("confidence"), start.alias("snippet"), *known)


def payload_filter(df: DataFrame, conditions: dict | None) -> DataFrame:
    """All conditions hold: a value equals (or an array holds it), a list matches any."""
    arrays = {f.name for f in df.schema if f.dataType.typeName() == "array"}
    for name, value in (conditions or {}).items():
        many = list(value) if isinstance(value, (list, tuple, set)) else [value]
        df = df.where(F.arrays_overlap(F.col(name), F.array(*map(F.lit, many))) if name in arrays else F.col(name).isin(*many))
    return df


@dataclass
class Codebase:
    """chunks: chunk_id, file_path, active, kind, parent_chunk_id ...; vectors: vec_id (a chunk_id), embedding, and kind and parent_chunk_id if the index knows them."""

    chunks: DataFrame
    vectors: DataFrame


@dataclass
class Catalog:
    books: dict[str, Codebase] = field(default_factory=dict)
    current: str | None = None

    def register(self, slug: str, book: Codebase) -> None:
        self.books[slug] = book

    def unregister(self, slug: str) -> int:
        self.current = None if self.current == slug else self.current
        return int(self.books.pop(slug, None) is not None)

    def slugs(self) -> list[str]:
        return sorted(self.books)

    def use(self, slug: str) -> Catalog:
        if slug not in self.books:
            raise KeyError(slug)
        self.current = slug
        return self

    def search(self, queries: DataFrame, k: int = 10, conditions: dict | None = None, resort: bool = False) -> DataFrame:
        """queries: query_id, query_vec. Dense search, then the active chunks of the hits, then the path's penalty (ranks stay unless resort)."""
        book = self._book()
        hits = S.dense_top_k(queries, book.vectors, "query_id", "vec_id", "embedding", "query_vec", min(k, GATEWAY_MOST))
        found = S.hydrate(hits, book.chunks, "vec_id", "chunk_id", F.col("active"))
        return S.penalised(payload_filter(found, conditions), "file_path", "query_id", resort)

    def search_hybrid(self, queries: DataFrame, k: int = 10, candidates: int = S.CANDIDATES) -> DataFrame:
        """Code and question hits of the candidates nearest, added up per parent chunk."""
        book = self._book()
        hits = S.dense_top_k(queries, book.vectors, "query_id", "vec_id", "embedding", "query_vec", candidates)
        owner = book.vectors.withColumnRenamed("vec_id", "chunk_id") if "kind" in book.vectors.columns else book.chunks
        known = hits.join(owner.select("chunk_id", "kind", "parent_chunk_id"), hits["vec_id"] == F.col("chunk_id"), "left").drop("chunk_id")
        known = known.withColumn("kind", F.coalesce("kind", F.lit("code")))
        ranked = S.parent_boost(known, "query_id", "vec_id", "kind", "parent_chunk_id", k)
        found = S.hydrate(ranked.withColumnRenamed("chunk_id", "hit_id"), book.chunks, "hit_id", "chunk_id", F.col("active"))
        return S.penalised(found, "file_path", "query_id")

    def rerank(self, queries: DataFrame, ranker=None, k: int = 10) -> DataFrame:
        """The hybrid search's first 20 in the order of a model."""
        return S.listwise_rerank(self.search_hybrid(queries, 20), "query_id", ranker, k)

    def by_symbol(self, queries: DataFrame, k: int = 20) -> DataFrame:
        """queries: query_id, query_vec, symbol. The first k hits that define the symbol, case apart."""
        found = self.search(queries.select("query_id", "query_vec"), k).join(queries.select("query_id", F.lower("symbol").alias("_s")), "query_id")
        return found.where(F.array_contains(F.transform("symbols_defined", F.lower), F.col("_s"))).drop("_s")

    def similar(self, texts: DataFrame, embed, k: int = 10) -> DataFrame:
        """texts: query_id, text. Searches with the vector that embed gives each text's first 1000 characters."""
        return self.search(texts.select("query_id", embed(F.left("text", F.lit(1000))).alias("query_vec")), k)

    def chunk(self, chunk_id) -> DataFrame:
        return self._book().chunks.where(F.col("chunk_id") == chunk_id)

    def active_rows(self, path: str | None = None) -> DataFrame:
        rows = self._book().chunks.where("active")
        return rows.where(F.col("file_path") == path) if path else rows

    def info(self) -> DataFrame:
        return self._book().chunks.groupBy("kind").agg(F.count("*").alias("rows"), F.count_if("active").alias("active"))

    def _book(self) -> Codebase:
        if self.current is None:
            raise ValueError("no codebase selected")
        return self.books[self.current]
