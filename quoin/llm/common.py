"""What several operators share: reading, keys, Arrow helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoin.session import durable

#: Text bytes that a numpy kernel handles at a time; bounds its working memory, which may be 50 times as much.
PIECE = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` text bytes at most (one row at least).

    Memory that the last batch leaves unused goes back to the machine, since workers outlive their tasks.
    """
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends, begin = np.cumsum(sizes), 0
        while begin < batch.num_rows:
            base = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(begin, end - begin)
            begin = end
        batch = sizes = ends = None
        give_back()


def give_back() -> None:
    """Return freed memory to the machine: Arrow's and, where the C library can, its own."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row begins (one entry more than rows); null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return bytes_, at - at[0]


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column over flat values."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """The rows as ``_key`` (unique bigint in the order of ``key``), ``_id`` (the key given) and ``_text``.

    Where every id is there and unique, the id itself is the key.  Otherwise (null or repeated ids) rows are
    numbered in the order of id and text, nulls first, and stored once, as the numbers must not change when a
    task runs again.  ``whole`` adds all other columns as ``_rest``.
    """
    rest = [F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text)).alias("_rest")] if whole else []
    rows = docs.select(F.col(key).cast("bigint").alias("_id"), F.col(text).cast("string").alias("_text"), *rest)
    odd = rows.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or _id is null")
    if odd.isEmpty():
        return rows.select(F.col("_id").alias("_key"), "*")
    numbered = rows.sort("_id", "_text").rdd.zipWithIndex().map(lambda x: (x[1], *x[0]))
    return durable(docs.sparkSession.createDataFrame(numbered, T.StructType([T.StructField("_key", T.LongType()), *rows.schema.fields])))


def carried(docs: DataFrame, text: str) -> Column:
    """All columns but the text as one struct ``given``, so that no name clashes (``none`` where there are no others)."""
    return F.struct([F.col(f"`{c}`") for c in docs.columns if c != text] or [F.lit(None).cast("int").alias("none")]).alias("given")


def mapped(df: DataFrame, column: str, kept: Sequence[str], run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], new: Sequence[T.StructField]) -> DataFrame:
    """``kept`` and the ``new`` columns: ``run`` gets ``given`` (a struct of all kept ones) and ``value`` and gives ``given`` and the new ones.

    ``mapInArrow`` itself can't take columns with a dot in their name.
    """
    names = [F.col(f"`{c}`") for c in kept]
    rows = df.select(F.struct(names or [F.lit(None).cast("int").alias("none")]).alias("given"), F.col(f"`{column}`").alias("value"))
    out = rows.mapInArrow(run, T.StructType([rows.schema["given"], *new]))
    return out.select(*(F.col(f"given.`{c}`") for c in kept), *(F.col(f"`{f.name}`") for f in new))


def texts_back(rows: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` from ``_rest`` and ``_text``."""
    return rows.select(*(F.col("_text").alias(text) if c == text else F.col(f"_rest.`{c}`") for c in docs.columns))
