"""Centroid clustering over subvector dictionaries.

Vectors of whole numbers are encoded once: each chunk of them has, for every block of neighbouring components, a
dictionary of the distinct subvectors and a code for each vector.  A round computes the exact distance of every
dictionary entry to every centroid's block once, and a vector's distance is the sum over its codes.  The sums for
new centroids go by codes as well: entries times how often each cluster has them.

A chunk is one row of a stored table, so rounds read small codes instead of vectors, memory is bounded by the
chunk, and a lost executor costs the chunks it was at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoin.session import Scratch, durable

#: Vectors of a chunk, and components of a block.
CHUNK, BLOCK = 8192, 2
#: Largest size of a component; squared distances of 4096 such components stay below 2^63.
LARGEST = 1 << 24

_CHUNKS = T.StructType(
    [
        T.StructField("ids", T.ArrayType(T.LongType())),
        T.StructField("codes", T.ArrayType(T.ShortType(), False)),  # of all vectors of the first block, then the second, ...
        T.StructField("entries", T.ArrayType(T.IntegerType(), False)),  # of all blocks, component by component
        T.StructField("sizes", T.ArrayType(T.IntegerType(), False)),  # entries of each block
    ]
)
_SUMS = T.StructType([T.StructField("cluster", T.IntegerType(), False), T.StructField("n", T.LongType(), False), T.StructField("sums", T.ArrayType(T.LongType(), False), False)])


def whole_numbers(vectors: DataFrame, key: str, vector: str, dimensions: int, scale: int) -> DataFrame:
    """``id`` and ``v``, floor(scale * component), of vectors with ``dimensions`` components, all of them finite."""
    value = F.col(f"`{vector}`")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where((F.size(value) == dimensions) & finite)
    return rows.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.transform(value, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def encoded(ids: pa.Array, v: np.ndarray) -> list[pa.Array]:
    """One row of the chunk table."""
    codes, entries, sizes = [], [], []
    for begin in range(0, v.shape[1], BLOCK):
        distinct, code = np.unique(v[:, begin : begin + BLOCK], axis=0, return_inverse=True)
        codes.append(code.ravel().astype(np.int16))
        entries.append(distinct.ravel().astype(np.int32))
        sizes.append(len(distinct))
    one = lambda values, kind: pa.array([values], pa.list_(kind))
    lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    return [lists, one(np.concatenate(codes), pa.int16()), one(np.concatenate(entries), pa.int32()), one(np.array(sizes, np.int32), pa.int32())]


def chunks(rows: DataFrame, dimensions: int) -> DataFrame:
    """The vectors of ``whole_numbers`` as dictionaries and codes; every task makes chunks of its own rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def row() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            v = whole.column("v").flatten().to_numpy().reshape(-1, dimensions)
            if np.abs(v).max() > LARGEST:
                raise ValueError(f"a component exceeds {LARGEST} once scaled")
            held.clear()
            return pa.RecordBatch.from_arrays(encoded(whole.column("id"), v), names=_CHUNKS.fieldNames())

        for batch in batches:
            begin = 0
            while begin < batch.num_rows:
                part = batch.slice(begin, CHUNK - sum(b.num_rows for b in held))
                held.append(part)
                begin += part.num_rows
                if sum(b.num_rows for b in held) == CHUNK:
                    yield row()
        if held:
            yield row()

    return rows.mapInArrow(run, _CHUNKS)


class Chunk:
    """A row of the chunk table, decoded to its dictionaries."""

    def __init__(self, batch: pa.RecordBatch, row: int, dimensions: int):
        self.ids, codes, entries, sizes = (batch.column(c)[row].values for c in _CHUNKS.fieldNames())
        self.codes = codes.to_numpy().reshape(-1, len(self.ids))
        widths = [min(BLOCK, dimensions - begin) for begin in range(0, dimensions, BLOCK)]
        parts = np.split(entries.to_numpy().astype(np.int64), np.cumsum(sizes.to_numpy() * np.array(widths))[:-1])
        self.blocks = [part.reshape(-1, width) for part, width in zip(parts, widths, strict=True)]

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's centroid (ties: the smaller number) and its squared distance."""
        distance = np.zeros((len(self.ids), len(centroids)), np.int64)
        begin = 0
        for block, code in zip(self.blocks, self.codes, strict=True):
            part = centroids[:, begin : begin + block.shape[1]]
            begin += block.shape[1]
            partial = sum((block[:, k : k + 1] - part[:, k]) ** 2 for k in range(block.shape[1]))
            distance += partial[code]
        cluster = distance.argmin(1)
        return cluster, distance[np.arange(len(cluster)), cluster]

    def sums(self, cluster: np.ndarray, k: int) -> np.ndarray:
        """Sum of each cluster's vectors."""
        out = []
        for block, code in zip(self.blocks, self.codes, strict=True):
            often = np.bincount(cluster * len(block) + code, minlength=k * len(block)).reshape(k, len(block))
            out.append(often @ block)
        return np.concatenate(out, 1)


def _read(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[Chunk]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield Chunk(batch, row, dimensions)


def moved(stored: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of the mean of each centroid's vectors; centroids without any stay."""
    k, dimensions = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64)
        for chunk in _read(batches, dimensions):
            cluster, _ = chunk.nearest(centroids)
            sums += chunk.sums(cluster, k)
            counts += np.bincount(cluster, minlength=k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(counts), pa.array(list(sums), pa.list_(pa.int64()))], names=_SUMS.fieldNames())

    parts = stored.mapInArrow(run, _SUMS).where("n > 0").select("cluster", "n", F.posexplode("sums").alias("place", "x"))
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    out = centroids.copy()
    for r in parts.groupBy("cluster", "place").agg(exact("n").alias("n"), exact("x").alias("x")).collect():  # k x dimensions rows
        out[r["cluster"], r["place"]] = int(r["x"]) // int(r["n"])
    return out


def clusters(
    vectors: DataFrame, k: int = 16, rounds: int = 3, key: str = "vec_id", vector: str = "embedding", dimensions: int = 64, scale: int = 64, seed: int = 1
) -> tuple[DataFrame, DataFrame]:
    """(``id``, ``cluster``, ``distance``) of every kept vector, and (``cluster``, ``n``, ``inertia``, ``centroid``).

    Kept are vectors with ``dimensions`` components, none null, NaN or infinite; their components become
    floor(scale * x).  Centroids start as the kept vectors with the smallest SHA-256 of seed and id, fewer than
    ``k`` where fewer are kept; repeated ids go in the order of their vectors, a null id counts as empty text.
    Ties of distance go to the smaller number.  Repeated rows count each.  Components that exceed ``LARGEST``
    once scaled raise, since distances would leave 64 bits.  Other columns aren't read; an empty table gives two
    empty ones.  To the driver go only centroids and sums, at most k x dimensions numbers.
    """
    spark = vectors.sparkSession
    rows = whole_numbers(vectors, key, vector, dimensions, scale)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    start = [r["v"] for r in rows.orderBy(digest, "v").limit(k).collect()]
    centroids = np.array(start, np.int64).reshape(len(start), dimensions)
    assigned = T.StructType([T.StructField("id", T.LongType()), T.StructField("cluster", T.IntegerType(), False), T.StructField("distance", T.LongType(), False)])
    with Scratch(spark) as scratch:
        stored = scratch.table(chunks(rows, dimensions))
        if len(centroids):
            for _ in range(rounds):
                centroids = moved(stored, centroids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk in _read(batches, dimensions):
                cluster, distance = chunk.nearest(centroids)
                yield pa.RecordBatch.from_arrays([chunk.ids, pa.array(cluster, pa.int32()), pa.array(distance)], names=assigned.fieldNames())

        out = durable(stored.mapInArrow(run, assigned))
    sums = out.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia"))
    ends = spark.createDataFrame([(c, v.tolist()) for c, v in enumerate(centroids)], "cluster int, centroid array<bigint>")
    return out, ends.join(F.broadcast(sums), "cluster", "left").select("cluster", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("inertia").cast("bigint"), F.lit(0)).alias("inertia"), "centroid")
