"""Queries of the operators that find copies and passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm.common import table
from quoin.llm.decontaminate import contamination
from quoin.llm.minhash import near_duplicates
from quoin.llm.registry import query
from quoin.llm.simhash import compared, likeness, within
from quoin.llm.suffixes import without_repeats
from quoin.session import durable

#: Bits in which fingerprints of near copies may differ.
RADIUS = 3


@query()
def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that lie in ten-word windows of benchmark items."""
    out = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), 10)
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query()
def op2_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components of all documents: three-word shingles, similarity 0.85."""
    out = near_duplicates(table(spark, folder, "documents"), width=3, percent=85)
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), "kept")


@query()
def op8_suffix_array(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of all documents under 100-byte strings that begin earlier."""
    out = without_repeats(table(spark, folder, "documents"), 100)
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query()
def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts.

    ``n_near``: for documents whose id is divisible by 20, how many documents (itself included) have a fingerprint
    within the radius; null for the others.
    """
    rows = durable(compared(table(spark, folder, "documents")))
    copies = rows.groupBy("fp").agg(F.count(F.lit(1)).alias("copies"))
    found = within(rows.where("doc_id % 20 = 0"), copies, RADIUS)
    near = found.join(copies.withColumnRenamed("fp", "other"), "other").groupBy("fp").agg(F.sum("copies").alias("n_near"))
    text = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return rows.join(near, "fp", "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        text("fp").alias("fingerprint"),
        text("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.when(F.col("doc_id") % 20 == 0, F.col("n_near")).alias("n_near"),
    )
