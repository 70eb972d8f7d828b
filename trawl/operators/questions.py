"""Hypothetical questions: keywords, templates, validation, and the merging of model replies."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions.paths import basename, digest_role, slice_id
from trawl.functions.text import KEYWORD_STOP, normalize_question


def keywords(docs: DataFrame, id_col: str, text_col: str, k: int = 6) -> DataFrame:
    """The k commonest identifiers of three letters or more of each text: id, term, count, rank."""
    t = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit("([a-z_][a-z0-9_]{2,})"), F.lit(1))
    c = docs.select(id_col, F.explode(t).alias("term")).where(~F.col("term").isin(*KEYWORD_STOP)).groupBy(id_col, "term").count()
    return c.withColumn("rank", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("count"), "term"))).where(F.col("rank") <= k)


def template_questions(chunks: DataFrame, id_col: str, path: str = "file_path", start: str = "start_line", end: str = "end_line", text: str = "text") -> DataFrame:
    """Three questions of each chunk: id, hyde_index, question."""
    k = keywords(chunks, id_col, text).groupBy(F.col(id_col).alias("_i")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("_t"))
    out = chunks.join(k, chunks[id_col] == F.col("_i"), "left").withColumn("_t", F.coalesce("_t", F.array().cast("array<string>")))
    any_ = F.size("_t") > 0
    p = F.col(path)
    q = F.array(
        F.concat(F.lit("Where is "), F.when(any_, F.array_join("_t", " ")).otherwise(basename(p)), F.lit(" handled in "), p, F.lit("?")),
        F.concat(F.lit("What code around lines "), F.col(start).cast("string"), F.lit("-"), F.col(end).cast("string"), F.lit(" implements "), F.coalesce(F.get("_t", F.lit(0)), basename(p)), F.lit("?")),
        F.concat(F.lit("How does "), p, F.lit(" use "), F.when(any_, F.array_join(F.slice("_t", 1, 3), ", ")).otherwise("this logic"), F.lit("?")),
    )
    return out.select(id_col, F.posexplode(q).alias("hyde_index", "question"))


def question_rows(replies: DataFrame, id_col: str, questions: str = "questions", most: int = 12) -> DataFrame:
    """A row for each distinct question of a reply, normalised, most at most: chunk_id, parent_chunk_id, kind, hyde_index, text."""
    q = F.slice(F.array_distinct(F.filter(F.transform(questions, normalize_question), lambda x: x != "")), 1, most)
    out = replies.select(F.col(id_col).cast("string").alias("parent_chunk_id"), F.posexplode(q).alias("hyde_index", "text"))
    return out.select(F.concat(F.col("parent_chunk_id"), F.lit("-h"), F.col("hyde_index").cast("string")).alias("chunk_id"), "parent_chunk_id", F.lit("hyde").alias("kind"), "hyde_index", "text")


def question_errors(questions, expected: int, shortest: int = 40) -> Column:
    """What is wrong with a list of questions; empty if nothing is."""
    q = F.col(questions)
    found = F.array(
        F.when(F.size(q) != expected, F.lit("count")),
        F.when(F.exists(q, lambda x: F.length(F.trim(x)) < shortest), F.lit("short")),
        F.when(F.exists(q, lambda x: ~F.trim(x).endswith("?")), F.lit("no_mark")),
        F.when(F.size(F.array_distinct(F.transform(q, lambda x: F.lower(F.trim(x))))) < F.size(q), F.lit("repeated")),
    )
    return F.filter(found, lambda x: x.isNotNull())


_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.DOTALL | re.IGNORECASE)
#: A text in quotes, to its end or the end of all; a backslash and what follows it.
_QUOTED, _ESCAPE = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)', re.DOTALL), re.compile(r"\\(.?)", re.DOTALL)


def _balanced(t: str, opener: str, closer: str) -> str | None:
    """From the first opener to the closer that balances it, quoted text apart."""
    start = t.find(opener)
    if start < 0:
        return None
    depth = 0
    for m in re.finditer(f'{_QUOTED.pattern}|[{re.escape(opener + closer)}]', t[start:], re.DOTALL):
        depth += (m[0] == opener) - (m[0] == closer)
        if not depth and m[0] == closer:
            return t[start : start + m.end()]
    return None


def repaired_escapes(t: str) -> str:
    """Inside quotes, a backslash that starts no valid escape is doubled; pairs are taken from the left."""
    fixed = lambda m: m[0] if m[1] and m[1] in '"\\/bfnrtu' else "\\" + m[0]
    return _QUOTED.sub(lambda q: _ESCAPE.sub(fixed, q[0]), t)


def extract_json(text: str | None) -> tuple[str | None, str]:
    """The JSON in a model's reply and how it was found: direct, extracted, repaired_escapes, or error.

    What is tried: the whole text, each fenced block, the first balanced object, the first balanced list; each of the
    latter as it stands, then with its escapes repaired.
    """

    def loads(s: str) -> str | None:
        try:
            return json.dumps(json.loads(s))
        except ValueError:
            return None

    t = text or ""
    if found := loads(t):
        return found, "direct"
    tries = [m[1] for m in _FENCE.finditer(t)] + [x for pair in ("{}", "[]") if (x := _balanced(t, *pair))]
    for s in tries:
        if found := loads(s):
            return found, "extracted"
        if found := loads(repaired_escapes(s)):
            return found, "repaired_escapes"
    return None, "error"


def parse_replies(replies: DataFrame, text: str) -> DataFrame:
    """Adds parsed (JSON text) and parse_mode, in one Arrow pass: what a reply parses to is written anew, so every row is read there."""

    @F.pandas_udf("parsed string, parse_mode string")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract_json(x) for x in s], columns=["parsed", "parse_mode"])

    out = replies.withColumn("_j", run(F.col(text)))
    return out.withColumn("parsed", F.col("_j.parsed")).withColumn("parse_mode", F.col("_j.parse_mode")).drop("_j")


def reply_quality(expected: DataFrame, got: DataFrame, batch: str, key: str, question: str, shortest: int = 40) -> DataFrame:
    """Per batch: expected, unique, missing, extra and validish replies."""
    e, g = expected.select(batch, key).distinct(), got.select(batch, key, question)
    ids = g.groupBy(batch, key).agg(F.max((F.col(question).endswith("?") & (F.length(question) >= shortest)).cast("int")).alias("ok"))
    j = e.withColumn("_e", F.lit(1)).join(ids.withColumn("_g", F.lit(1)), [batch, key], "full_outer")
    count = lambda c, name: F.count_if(c).alias(name)
    return j.groupBy(batch).agg(count(F.col("_e").isNotNull(), "expected"), count(F.col("_g").isNotNull(), "unique"), count(F.col("_g").isNull(), "missing"), count(F.col("_e").isNull(), "extra"), count(F.col("ok") == 1, "validish"))


def slice_digest(files: DataFrame, path: str, text: str) -> DataFrame:
    """Per directory slice: files, module_purpose (three commonest roles and extensions) and the hash of its sorted contents."""
    ext = F.regexp_extract(basename(path), r"^.+\.([^.]+)$", 1)
    f = files.select(slice_id(path).alias("slice_id"), F.col(path).alias("p"), digest_role(path).alias("role"), F.when(ext == "", "no-extension").otherwise(ext).alias("ext"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("h"))

    def commonest(col: str, name: str) -> DataFrame:
        c = f.groupBy("slice_id", col).agg(F.count("*").alias("n"), F.min("p").alias("first"))
        top = c.withColumn("r", F.row_number().over(Window.partitionBy("slice_id").orderBy(F.desc("n"), "first"))).where("r <= 3")
        return top.groupBy("slice_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", col))), lambda x: x[col]), ", ").alias(name))

    lines = F.array_sort(F.collect_list(F.struct("p", "h")))
    whole = f.groupBy("slice_id").agg(F.count("*").alias("files"), F.sha2(F.array_join(F.transform(lines, lambda x: F.concat_ws(":", x["p"], x["h"])), "\n"), 256).alias("slice_content_hash"))
    out = whole.join(commonest("role", "_roles"), "slice_id").join(commonest("ext", "_exts"), "slice_id")
    purpose = F.concat(F.col("slice_id"), F.lit(" groups "), F.col("_roles"), F.lit(" for the "), F.replace(F.col("slice_id"), F.lit("/"), F.lit(" ")), F.lit(" area; primary file types are "), F.col("_exts"), F.lit("."))
    return out.select("slice_id", "files", F.left(purpose, F.lit(320)).alias("module_purpose"), "slice_content_hash")


def with_digest(chunks: DataFrame, digests: DataFrame, path: str = "file_path") -> DataFrame:
    """Chunks with the module purpose of their file: side-car rows (slice_id, files, module_purpose, line_no), the last line of a file wins."""
    by_file = digests.select(F.explode("files").alias("_f"), "slice_id", "module_purpose", "line_no").groupBy("_f").agg(F.max_by(F.struct("slice_id", "module_purpose"), "line_no").alias("_d"))
    return chunks.join(by_file, chunks[path] == F.col("_f"), "left").withColumn("slice_id", F.col("_d.slice_id")).withColumn("module_purpose", F.col("_d.module_purpose")).drop("_f", "_d")
