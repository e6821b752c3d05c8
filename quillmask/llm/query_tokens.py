"""Queries on tokens: counts, pieces and packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmask.llm.packing import pack
from quillmask.llm.sentencepieces import decode_texts, encode_texts
from quillmask.llm.token_counts import token_counts

LIMIT_TOKENS = 2048


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT_TOKENS)


def op2_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, a digest of their ids (joined by blanks), and whether decoding gives the text again."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = decode_texts(encode_texts(docs, path), path)
    return both.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_pieces"),
        F.crc32(F.array_join(F.col("piece_ids").cast("array<string>"), " ")).alias("ids_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


def packed(docs: DataFrame) -> DataFrame:
    """The pieces of packed documents, with a digest of their ids."""
    pieces = pack(docs, public_tokenizers.path("byte_bpe_50k.json"), size=LIMIT_TOKENS)
    return pieces.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 2048 tokens."""
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op6_packing": op6_packing, "op2_sentencepieces": op2_sentencepieces, "op10_token_counts": op10_token_counts}
ORACLE_SQL: dict[str, str] = {}
