"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.session import Scratch


def _starred(edges: DataFrame, large: bool) -> DataFrame:
    """Link every larger neighbour (``large``), or every smaller one and the node, to the smallest of all of them."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(``node``, ``root``) of every node in ``links`` (``a``, ``b``) that isn't the smallest of its component.

    Each round writes its links to ``scratch``, which shrink to stars whose centres are the roots; the number of rounds grows
    with the logarithm of the links.  Only a count and a checksum reach the driver.
    """
    edges = scratch.table(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    before = state(edges)
    while True:
        edges = scratch.table(_starred(_starred(edges, True), False))
        after = state(edges)
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
