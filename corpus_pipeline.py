"""A training corpus from raw documents, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm.common import carried, table
from quoin.llm.decontaminate import without_contaminated
from quoin.llm.languages import identify, profiles
from quoin.llm.minhash import without_near_duplicates
from quoin.llm.sentence_pieces import encode
from quoin.llm.suffixes import deduplicated
from quoin.session import Scratch, durable

#: Documents that are surely less like the best language than this, as a share of its own texts, are in none.
LEAST_LIKENESS = 0.6


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of the labelled ones; null texts and texts without letters go.

    A text goes only with enough n-grams to tell; all documents stay where nothing was learned.
    """
    rows = docs.select(carried(docs, "text"), "text")
    judged = identify(rows, profiles(docs), likeness="_likeness", keep_text=True)
    stay = judged.where(F.col("_likeness").isNull() | (F.col("_likeness") >= LEAST_LIKENESS))
    return stay.select(*(F.col("text" if c == "text" else f"given.`{c}`") for c in docs.columns))


def minhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8."""
    return without_near_duplicates(docs, width=5, percent=80)


def suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without 100-byte strings that begin earlier; ``n_chars`` follows."""
    return deduplicated(docs, 100).withColumn("n_chars", F.char_length("text").cast("bigint"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"), 10)


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text with an end id, and whether they decode to it."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    keep = ["doc_id", "lang", "source", "n_chars"]
    rows = docs.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    encoded = encode(rows, path, keep=[*keep, "text_sha256"], end=True, decoded="decoded")
    return encoded.select(*keep, F.size("ids").cast("bigint").alias("n_tokens"), "ids", (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("minhash", minhash),
    ("suffix_array", suffix_array),
    ("decontamination", decontamination),
    ("sentence_pieces", sentence_pieces),
]

#: Models, signatures and tokenizers aren't expressible in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on what its predecessor stored."""
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for _, stage in STAGES[:-2]:
            docs = scratch.table(stage(spark, docs, sf_dir))
        docs = durable(STAGES[-2][1](spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
