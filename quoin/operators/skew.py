"""Splitting hot join and grouping keys.

A single key may hold a third of all rows.  Hot keys are counted (with map-side partial counts) and
only they are split; everything else keeps its plain key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.session import durable

# Hot keys shipped to every task at a time; more of them take several joins, each as small.
BROADCAST_KEYS = 10_000


def hot_keys(df: DataFrame, keys: Sequence[str], rows_per_part: int) -> list[DataFrame]:
    """Keys with more than ``rows_per_part`` rows and the number of parts to split them in.

    Eager: runs one counting job.  No table when no key is hot, so that the common case plans without any
    salt.  More hot keys than one task should hold come in several tables, told apart by the key's hash, so
    that none of them has to be joined by the very keys that are hot.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows_per_part)
    hot = counts.select(*keys, F.ceil(F.col("_n") / rows_per_part).cast("int").alias("_parts"))
    rows = hot.limit(BROADCAST_KEYS + 1).collect()
    if len(rows) <= BROADCAST_KEYS:
        return [F.broadcast(df.sparkSession.createDataFrame(rows, hot.schema))] if rows else []
    hot = durable(hot)
    tables = -(-2 * hot.count() // BROADCAST_KEYS)
    place = F.pmod(F.xxhash64(*keys), F.lit(tables))
    return [F.broadcast(hot.where(place == k)) for k in range(tables)]


def _with_parts(df: DataFrame, tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Column ``_parts`` from whichever table has the key; null where none does."""
    for k, table in enumerate(tables):
        df = df.join(table.withColumnRenamed("_parts", f"_parts{k}"), keys, "left")
    found = [f"_parts{k}" for k in range(len(tables))]
    return df.withColumn("_parts", F.coalesce(*found)).drop(*found)


def part_of(row_key: Column, parts: Column) -> Column:
    """Stable part number of a row among ``parts`` (missing = 1)."""
    return F.pmod(F.xxhash64(row_key), F.coalesce(parts, F.lit(1))).cast("int")


def salted_join(
    probe: DataFrame, build: DataFrame, keys: Sequence[str], probe_id: str, rows_per_part: int
) -> DataFrame:
    """Inner equi-join in which hot probe keys are spread over several parts.

    Probe rows of a hot key go to one part each; the build rows of that key are repeated per part.
    """
    keys = list(keys)
    hot = hot_keys(probe, keys, rows_per_part)
    if not hot:
        return probe.join(build, keys)
    spread = _with_parts(probe, hot, keys).withColumn("_salt", part_of(F.col(probe_id), F.col("_parts")))
    copies = _with_parts(build, hot, keys).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    )
    return spread.drop("_parts").join(copies.drop("_parts"), [*keys, "_salt"]).drop("_salt")
