"""Queries of the tokenizer operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm.common import table
from quoin.llm.registry import query
from quoin.llm.sentence_pieces import decode, encode
from quoin.llm.token_counts import token_counts

MODEL = "piece_bpe_32k.model"
#: Tokens of a context window.
LIMIT = 4096


@query()
def op1_sentence_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the ids of every document and of what they decode to; ``n_bytes``: where the last span ends."""
    path = public_tokenizers.path(MODEL)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    encoded = encode(docs, path, keep=["doc_id"], end=True).select(
        "doc_id",
        "ids",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.element_at("ends", -1).cast("bigint").alias("n_bytes"),
    )
    return decode(encoded, path, keep=["doc_id", "n_tokens", "ids_sha256", "n_bytes"]).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"), "n_bytes"
    )


@query()
def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document, and whether they exceed a context window."""
    docs = table(spark, folder, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    counts = token_counts(docs, public_tokenizers.path(MODEL))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
