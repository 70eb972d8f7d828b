"""The corpus pipeline: quality rules, near-dedup, secret scans, mixing, tokenising.

Every stage reads COLUMNS alone, so other columns, whatever their names, make no difference and do not come back. An
empty table gives an empty result. Texts count whole, however long. What else a stage does with nulls, ties and
repeated rows stands in its docstring.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the
columns of documents. run writes each result to the shared folder and reads it again as the next one's docs.
"""

from __future__ import annotations

import functools
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm.bpe import decode_ids, encode_documents
from trawl.llm.mixing import mix_by_source, repeated
from trawl.llm.quality import judge_quality
from trawl.llm.queries import vocabularies
from trawl.llm.resemblance import one_of_each
from trawl.llm.secrets import redact, scan_secrets
from trawl.llm.shared import noting, remove, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: What the stage before has left in the shared folder. Its result has been written and read again by the time the
#: next stage begins, so nothing reads these tables any more.
_left = threading.local()


def staged(stage):
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not hasattr(_left, "paths"):
            _left.paths = []
        remove(spark, _left.paths)
        with noting(_left.paths):
            return stage(spark, docs, sf_dir)

    return run_stage


@staged
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their language's fertility bands reject go.

    A null or empty text fails the base rules and goes; a null language is judged by its script; null ids, sources and
    lengths stay as they are. Repeated rows are judged alike, each stays or goes.
    """
    return judge_quality(docs.select(*COLUMNS), vocabularies()).where("kept").select(*COLUMNS)


@staged
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id.

    Documents link at a Jaccard similarity of 0.8 or more of their five-word shingle sets, computed on the whole sets.
    The SimHash operator proposes pairs; the README says why MinHash bands propose more, and with what recall.
    Null and empty texts are one group; a null id is the smallest only of nulls; of rows that repeat the smallest id
    the least by all columns stays, once.
    """
    return one_of_each(docs.select(*COLUMNS), similarity=0.8, shingle=5)


@staged
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays.

    n_chars follows the text where it changed. A null text has no secret and stays null; repeated rows change alike.
    """
    clean = redact(scan_secrets(docs.select(*COLUMNS)))
    return clean.withColumn("n_chars", F.when(F.size("secrets") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


@staged
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mix of sources takes, up to three.

    A null source is a source, the last; a text without a word (or null) takes no part and goes. Rows that repeat an
    id are documents of their own; equal hashes stand by id, then size.
    """
    return repeated(mix_by_source(docs.select(*COLUMNS), keep=COLUMNS)).select(*COLUMNS)


@staged
def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the digest of what they decode to, of every copy.

    A null text counts as empty: no ids, the digest of no bytes. Repeated rows are encoded each.
    """
    _, path, pattern = vocabularies()
    coded = decode_ids(encode_documents(docs.select("doc_id", "text"), path, pattern), path)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("secret scans", secrets), ("mixing", mixing), ("byte-level BPE", tokenise)]

#: SQL has neither XXH64 nor the tokenisers; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
