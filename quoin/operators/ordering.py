"""Sampling, global row numbers and payload batches without a global sort in one task.

Rows are ordered by a digest of their id.  Its leading hex digits split the rows into many evenly
filled buckets; numbering happens inside buckets, and only the bucket counts are ever put in one
place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.session import durable

from quoin.functions.draws import key_digest

# Rows of a bucket, about.
BUCKET_ROWS = 100_000
# Payload budget of one batch, 3 MiB.
BATCH_BYTES = 3 * 1024 * 1024


def _digits(df: DataFrame) -> int:
    """Hex digits that leave about ``BUCKET_ROWS`` rows in a bucket."""
    rows = df.count()
    return max(1, math.ceil(math.log(max(1, rows / BUCKET_ROWS), 16)))


def add_row_index(
    df: DataFrame,
    id_col: str = "building_id",
    salt: str = "order",
    target: str = "sort_index",
    digits: int | None = None,
) -> DataFrame:
    """Gapless index from 0 in digest order, over 16 ** ``digits`` buckets; by default as the rows ask for."""
    digits = _digits(df) if digits is None else digits
    keyed = df.withColumn("_digest", key_digest(F.col(id_col), salt)).withColumn(
        "_bucket", F.substring("_digest", 1, digits)
    )
    counts = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # One row per bucket.
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_bucket").orderBy("_digest", id_col)
    numbered = keyed.withColumn("_rank", F.row_number().over(inside)).join(starts, "_bucket")
    return numbered.withColumn(target, F.col("_start") + F.col("_rank") - 1).drop(
        "_digest", "_bucket", "_rank", "_start"
    )


def sample_rows(df: DataFrame, size: int, id_col: str = "building_id", salt: str = "sample") -> DataFrame:
    """Reproducible random sample of exactly min(size, rows) rows: those first in digest order.

    Counts of digest beginnings say where the sample ends.  Rows before that are taken by a filter; only those
    of the one bucket in which it ends are ranked.
    """
    digits = _digits(df) + 1
    keyed = df.withColumn("_digest", key_digest(F.col(id_col), salt)).withColumn("_bucket", F.substring("_digest", 1, digits))
    counts = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    upto = counts.withColumn("_end", F.sum("_n").over(Window.orderBy("_bucket")))
    last = upto.where(F.col("_end") >= size).orderBy("_bucket").first()
    if last is None:
        return df
    ranked = keyed.where(F.col("_bucket") == last["_bucket"]).withColumn("_rank", F.row_number().over(Window.partitionBy("_bucket").orderBy("_digest", id_col)))
    edge = ranked.where(F.col("_rank") <= size - (last["_end"] - last["_n"])).drop("_rank")
    return keyed.where(F.col("_bucket") < last["_bucket"]).union(edge).drop("_digest", "_bucket")


def payload_bytes(*columns: str | Column) -> Column:
    """Size of a row as compact JSON."""
    return F.octet_length(F.to_json(F.struct(*columns)))


def payload_plan(specs: DataFrame, budget: int = BATCH_BYTES) -> DataFrame:
    """One row: specs, mean bytes per spec (over all specs, not a sample), specs per batch, batches."""
    size = payload_bytes(*specs.columns)
    sizes = specs.select(size.alias("b")).agg(
        F.count(F.lit(1)).alias("n_specs"), F.avg("b").alias("mean_bytes")
    )
    per = F.greatest(F.floor(F.lit(budget) / F.col("mean_bytes")), F.lit(1))
    return sizes.withColumn("specs_per_batch", per).withColumn(
        "n_batches", F.ceil(F.col("n_specs") / F.col("specs_per_batch"))
    )


def assign_batches(specs: DataFrame, budget: int = BATCH_BYTES, id_col: str = "building_id") -> DataFrame:
    """Column ``batch_id``: consecutive row indices, ``specs_per_batch`` at a time.

    Eager: the specs are stored once, since their sizes, their order and the rows themselves are all needed.
    """
    specs = durable(specs)
    per = payload_plan(specs, budget).select("specs_per_batch").scalar()
    indexed = add_row_index(specs, id_col, target="_at")
    return indexed.withColumn("batch_id", F.floor(F.col("_at") / per)).drop("_at")
