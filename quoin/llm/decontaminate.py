"""Benchmark decontamination: a prefix-filtered join of word windows with documents.

A window is contained in a document only if its rarest word is, so that word alone is its necessary prefix.
Words of the items are counted in the documents, windows take their rarest one, and only document words that
can be such a prefix leave the scan, each with the words around it.  After the join on the prefix word come the
bounds (the window must fit between the first and the last word) and the exact comparison of all its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoin.llm.common import flat, keyed, list_array, slices, texts_back
from quoin.llm.words import LETTERS, words
from quoin.session import Scratch, durable

#: Bits of the filter of words that tasks look for: 2 ** 23 at most, whatever the benchmark's size.
FILTER_BITS = 23


def item_windows(items: DataFrame, window: int, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (``item``, ``hashes``): every ``window`` consecutive words of an item, or all if it has fewer."""
    schema = T.StructType([T.StructField("item", T.StringType()), T.StructField("hashes", T.ArrayType(T.LongType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = words(*flat(batch.column("text")), LETTERS)
            count = np.diff(found.firsts)
            size = np.minimum(count, window)
            each = np.where(count > 0, count - size + 1, 0)
            row = np.repeat(np.arange(len(each)), each)
            start = found.firsts[row] + np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
            ends = np.cumsum(size[row])
            at = np.repeat(start - (ends - size[row]), size[row]) + np.arange(ends[-1] if len(ends) else 0)
            hashes = list_array(found.hashes[at].view(np.int64), np.concatenate([[0], ends]), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(row)), hashes], names=schema.fieldNames())

    return items.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema).distinct()


def word_filter(tokens: DataFrame) -> bytes:
    """A bit for the leading bits of each ``token``: at most ``2 ** FILTER_BITS`` of them reach the driver."""
    slots = tokens.select(F.shiftrightunsigned("token", 64 - FILTER_BITS).alias("slot")).distinct().toArrow()
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[slots.column("slot").to_numpy()] = True
    return np.packbits(bits).tobytes()


def _possible(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    slot = (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return np.flatnonzero(bits[slot >> 3] & (128 >> (slot & 7)))


def word_counts(rows: DataFrame, bits: bytes) -> DataFrame:
    """Occurrences (``token``, ``n``) of the words that pass the filter."""
    schema = T.StructType([T.StructField("token", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.frombuffer(bits, np.uint8)
        for batch in slices(batches, "_text"):
            hashes = words(*flat(batch.column("_text")), LETTERS).hashes
            token, n = np.unique(hashes[_possible(hashes, wanted)].view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(n.astype(np.int64))], names=schema.fieldNames())

    return rows.select("_text").mapInArrow(run, schema).groupBy("token").agg(F.sum("n").alias("n"))


_NEAR = T.ArrayType(T.StructType([T.StructField("token", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("around", T.ArrayType(T.LongType()))]))


def possible_prefixes(rows: DataFrame, bits: bytes, reach: int) -> DataFrame:
    """Each row's number of words, and its words that pass the filter with ``reach`` words on either side.

    ``around`` has 2 * reach + 1 entries; places outside the document are null.
    """
    schema = T.StructType([T.StructField("_key", T.LongType()), T.StructField("_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("near", _NEAR)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.frombuffer(bits, np.uint8)
        for batch in slices(batches, "_text"):
            found = words(*flat(batch.column("_text")), LETTERS)
            hit = _possible(found.hashes, wanted)
            row = np.searchsorted(found.firsts, hit, "right") - 1
            place = hit[:, None] + np.arange(-reach, reach + 1)
            outside = (place < found.firsts[row][:, None]) | (place >= found.firsts[row + 1][:, None])
            values = found.hashes.view(np.int64)[np.where(outside, 0, place)] if len(hit) else np.empty((0, 2 * reach + 1), np.int64)
            around = pa.ListArray.from_arrays(pa.array(np.arange(len(hit) + 1) * (2 * reach + 1), pa.int32()), pa.array(values.ravel(), mask=outside.ravel()))
            near = pa.StructArray.from_arrays(
                [pa.array(found.hashes.view(np.int64)[hit]), pa.array((hit - found.firsts[row]).astype(np.int32)), around], names=["token", "at", "around"]
            )
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(hit, found.firsts), pa.int32()), near)
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_id"), pa.array(np.diff(found.firsts).astype(np.int64)), lists], names=schema.fieldNames())

    return rows.select("_key", "_id", "_text").mapInArrow(run, schema)


def union_size(spans: str) -> Column:
    """Number of words under sorted spans of ``first`` and ``last`` (exclusive)."""
    zero = F.struct(F.lit(0).alias("reach"), F.lit(0).cast("bigint").alias("n"))
    step = lambda a, x: F.struct(
        F.greatest(a["reach"], x["last"]).alias("reach"), (a["n"] + F.greatest(F.lit(0), x["last"] - F.greatest(x["first"], a["reach"]))).alias("n")
    )
    return F.aggregate(F.col(spans), zero, step, lambda a: a["n"])


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: ``key``, ``n_words``, ``spans`` (word spans of occurring windows), ``n_hit``, ``items``.

    ``items`` are the sorted ids, as text, of items with an occurring window.  Null and empty texts have no words
    and hit nothing, nor does an empty benchmark; items of null id take part but aren't named.  Repeated documents
    and ids are judged row by row; repeated items are named once.  Other columns don't matter.
    """
    found = _judged(keyed(docs, key, text), items, window, item, item_text)
    return found.select(F.col("_id").alias(key), "n_words", "spans", "items", "n_hit")


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents, with all their columns, in which no window of an item occurs."""
    rows = keyed(docs, key, text, whole=True)
    hit = _judged(rows, items, window, item, item_text).where("n_hit > 0").select("_key")
    return texts_back(rows.join(hit, "_key", "left_anti"), docs, text)


def _judged(rows: DataFrame, items: DataFrame, window: int, item: str, item_text: str) -> DataFrame:
    with Scratch(rows.sparkSession) as scratch:
        return durable(_found(rows, items, window, item, item_text, scratch))


def _found(rows: DataFrame, items: DataFrame, window: int, item: str, item_text: str, scratch: Scratch) -> DataFrame:
    windows = scratch.table(item_windows(items, window, item, item_text))
    tokens = windows.select(F.explode("hashes").alias("token")).distinct()
    counts = word_counts(rows, word_filter(tokens))
    distinct = windows.select("hashes").distinct().select("hashes", F.posexplode("hashes").alias("place", "token"))
    rarest = distinct.join(counts, "token", "left").groupBy("hashes").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "place")).alias("rarest"))
    # A window whose rarest word occurs nowhere occurs nowhere.
    prefixes = scratch.table(rarest.where("rarest.n > 0").select("hashes", "rarest.token", "rarest.place"))
    found = scratch.table(possible_prefixes(rows, word_filter(prefixes), window - 1))
    near = found.select("_key", "n_words", F.inline("near"))
    first = F.col("at") - F.col("place")
    size = F.size("hashes")
    hits = (
        near.join(prefixes, "token")
        .where((first >= 0) & (first + size <= F.col("n_words")))
        .where(F.slice("around", F.lit(window) - F.col("place"), size) == F.col("hashes"))
        .select("_key", "hashes", F.struct(first.alias("first"), (first + size).alias("last")).alias("span"))
    )
    hits = scratch.table(hits)
    spans = hits.groupBy("_key").agg(F.sort_array(F.collect_set("span")).alias("spans"))
    named = hits.select("_key", "hashes").distinct().join(windows.where("item is not null"), "hashes").groupBy("_key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    empty = F.array().cast("array<string>")
    return (
        found.select("_key", "_id", "n_words")
        .join(spans, "_key", "left")
        .join(named, "_key", "left")
        .select(
            "_key",
            "_id",
            "n_words",
            F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"),
            F.coalesce("items", empty).alias("items"),
        )
        .withColumn("n_hit", union_size("spans"))
    )
