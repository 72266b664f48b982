"""Queries of the operators that learn from the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm.common import table
from quoin.llm.language_model import scored
from quoin.llm.languages import fold, identify, profiles
from quoin.llm.quality import judged, learn
from quoin.llm.registry import query


@query()
def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from those outside the held-out fold."""
    docs = table(spark, folder, "documents").withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)))
    return identify(docs.select("doc_id", "held_out", "text"), profiles(docs.where("not held_out")))


@query()
def op6_language_model(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of every document under a model of those outside the held-out fold."""
    return scored(table(spark, folder, "documents").select("doc_id", "text"), fold(F.col("doc_id"), 7) == 2)


#: Least score of a document predicted good.
GOOD = 0.7


@query()
def op11_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document, learned from the labels outside the held-out fold."""
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    docs = table(spark, folder, "documents").select("doc_id", "text", held_out.alias("held_out"))
    judge = learn(docs, table(spark, folder, "labels").where(~held_out))
    return judged(docs, judge).select("given.doc_id", "given.held_out", "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
