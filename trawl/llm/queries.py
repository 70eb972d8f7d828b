"""One query for each operator over its whole intended table, with production parameters, and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trawl.llm import oracles
from trawl.llm.shared import fresh_path, table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trawl.llm.sharding import regular_tree, shard_documents, with_shard

    tree = regular_tree(8)
    return shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tree, with_shard(tree))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from trawl.llm.bpe import decode_ids, digests, encode_documents

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN)
    return digests(decode_ids(coded, path))


def op3_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from trawl.llm.packing import read_packed, write_packed

    folder = fresh_path(spark, "packed")
    manifest = write_packed(table(spark, sf_dir, "documents").select("doc_id", "text"), folder, public_tokenizers.path("word_bpe_49k.json"), 2)
    return read_packed(manifest, folder)


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trawl.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda i: i % 20 == 0)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trawl.llm.mixing import mix_by_source

    return mix_by_source(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trawl.llm.simhash import fingerprint_hex, near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", fingerprint_hex(found["fp"]).alias("fingerprint"), "component_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trawl.llm.toxicity import score_documents

    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def vocabularies() -> tuple[str, str, str]:
    """A piece vocabulary with byte fallback, a byte-level one and its pattern."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trawl.llm.quality import judge_quality

    return judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), vocabularies(), keep=["doc_id"])


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trawl.llm.suffixes import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trawl.llm.secrets import scan_secrets, secret_digest

    return secret_digest(scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"]))


def op11_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from trawl.llm.windows import pack_documents, piece_digest

    return piece_digest(pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), 0))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from trawl.llm.manifest import ascii_lower, dataset_manifest

    docs, columns = table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return dataset_manifest(docs.select(*columns), columns, other={"text": ascii_lower(F.col("text"))}, when=tampered).drop("lang", "place")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from trawl.llm.trie import prefix_trie

    conv = F.col("grp")
    shared = F.crc32(conv.cast("string").cast("binary")) % 6
    return prefix_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), conv - conv % 100, shared)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_sharding": op1_sharding, "op2_byte_bpe": op2_byte_bpe, "op3_token_packing": op3_token_packing, "op4_nearest": op4_nearest, "op5_mixing": op5_mixing, "op6_simhash": op6_simhash, "op7_toxicity": op7_toxicity, "op8_quality": op8_quality, "op9_suffix_dedup": op9_suffix_dedup, "op10_secrets": op10_secrets, "op11_window_packing": op11_window_packing, "op12_merkle_manifest": op12_merkle_manifest, "op13_prefix_trie": op13_prefix_trie}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
