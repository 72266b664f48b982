"""Near duplicates: signatures of b-bit minima, joined within a Hamming distance, confirmed on full sets.

A signature has ``parts * width`` minima of 16 bits.  Two signatures that differ in at most ``2 * parts - 1``
places have a part with at most one difference (pigeonhole).  So every part is written with each of its places
left out in turn, and all pairs within the distance meet under such a key; how many parts and places it takes is
chosen such that a pair at the wanted similarity exceeds the distance with a probability below one in 100,000.

Documents of equal sets are one class, of which only the first goes on.  Under each key, members are first
compared with the smallest one alone.  Where a key then still has members of several components, those outside
its largest component are compared with all others that are left under such keys, if they can be similar at all:
of two similar sets, the rarest shingles must meet near enough to the front of both.  Pairs inside a component
need no comparison, and copies with many changes of their own have nothing in front that others share, so a large
group costs about a comparison per member, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoin.llm.common import flat, keyed, list_array, slices, texts_back
from quoin.llm.components import components
from quoin.llm.decontaminate import FILTER_BITS, word_filter
from quoin.llm.words import PRINTED, mix, shingle_hashes, words
from quoin.session import Scratch, durable

#: Chance that a pair at the wanted similarity lies beyond the distance.
MISS = 1e-5


def shape(percent: int) -> tuple[int, int]:
    """Parts and places of each, fewest keys first, for a similarity in percent."""
    q = 1 - percent / 100
    fits = []
    for width in range(2, 9):
        for parts in range(1, 60):
            n, most = parts * width, 2 * parts - 1
            if sum(comb(n, k) * q**k * (1 - q) ** (n - k) for k in range(most + 1, n + 1)) <= MISS:
                fits.append((n, parts, width))
                break
    few = [x for x in fits if x[2] >= 4] or fits
    _, parts, width = min(few)
    return parts, width


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each row, and where each row begins (rows + 1)."""
    found = words(data, offsets, PRINTED)
    count = np.diff(found.firsts)
    row = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(row)) - found.firsts[row]
    hashes = np.zeros(len(row), np.uint64)
    for k in range(1, width + 1):  # a row of fewer words is one shingle of all of them
        some = np.flatnonzero((count[row] == k) & (place == 0)) if k < width else np.flatnonzero(place + width <= count[row])
        if len(some):
            hashes[some] = shingle_hashes(found.hashes, k)[some]
    real = place == 0
    real |= place + width <= count[row]
    hashes, row = hashes[real], row[real]
    firsts = np.searchsorted(row, np.arange(len(count) + 1))
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        hashes[a:b].sort()
    new = np.ones(len(row), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[new], np.concatenate([[0], np.cumsum(new)])[firsts]


def _signed(rows: DataFrame, width: int, size: int) -> DataFrame:
    """Per document: size of its set, two checksums of the set, and ``size`` minima of 16 bits (null if empty)."""
    schema = T.StructType(
        [
            *(T.StructField(n, T.LongType()) for n in ("_key", "_id", "n", "sum1", "sum2")),
            T.StructField("signature", T.ArrayType(T.IntegerType(), False)),
        ]
    )
    factors = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            hashes, firsts = shingle_sets(*flat(batch.column("_text")), width)
            n = np.diff(firsts)
            full = np.flatnonzero(n)
            at = firsts[full]
            sums = np.zeros((2, len(n)), np.int64)
            minima = np.zeros((len(full), size), np.int32)
            if len(full):
                for k, seed in enumerate((1, 2)):
                    sums[k, full] = np.add.reduceat(mix(hashes + np.uint64(seed)), at).view(np.int64)
                for k in range(size):
                    least = np.minimum.reduceat(hashes * factors[k], at)
                    minima[:, k] = (mix(least) & np.uint64(0xFFFF)).astype(np.int32)
            offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, size, 0))])
            signature = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(minima.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), batch.column("_id"), *(pa.array(x) for x in (n.astype(np.int64), sums[0], sums[1])), signature], names=schema.fieldNames()
            )

    return rows.select("_key", "_id", "_text").mapInArrow(run, schema)


def _keys(signed: DataFrame, parts: int, width: int) -> DataFrame:
    """(``bucket``, ``_key``): a key for each part and place left out."""
    schema = T.StructType([T.StructField("_key", T.LongType()), T.StructField("buckets", T.ArrayType(T.LongType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("signature").flatten().to_numpy().reshape(-1, parts, width).astype(np.uint64)
            out = np.empty((len(values), parts, width), np.uint64)
            part = np.arange(parts, dtype=np.uint64)
            for skip in range(width):
                code = np.broadcast_to(mix(part * np.uint64(64) + np.uint64(skip + 1)), values.shape[:2]).copy()
                for k in range(width):
                    if k != skip:
                        code = mix(code ^ values[:, :, k]) * np.uint64(0x9FB21C651E98DF25)
                out[:, :, skip] = code
            lists = list_array(out.reshape(-1).view(np.int64), np.arange(len(values) + 1) * parts * width, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("_key"), lists], names=schema.fieldNames())

    return signed.select("_key", "signature").mapInArrow(run, schema).select(F.explode("buckets").alias("bucket"), "_key")


def _sets(rows: DataFrame, wanted: bytes, width: int) -> DataFrame:
    """(``_key``, ``shingles``) of the documents whose key passes the filter."""
    schema = T.StructType([T.StructField("_key", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted, np.uint8)
        for batch in slices(batches, "_text"):
            slot = (batch.column("_slot").to_numpy().view(np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
            some = batch.filter(pa.array((bits[slot >> 3] & (128 >> (slot & 7))) > 0))
            if some.num_rows:
                hashes, firsts = shingle_sets(*flat(some.column("_text")), width)
                yield pa.RecordBatch.from_arrays([some.column("_key"), list_array(hashes.view(np.int64), firsts, pa.int64())], names=schema.fieldNames())

    return rows.select("_key", "_text", F.xxhash64("_key").alias("_slot")).mapInArrow(run, schema)


def _close(most: int, percent: int) -> Column:
    """Whether a pair can still be similar: sizes near enough, signatures within the distance."""
    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    differ = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x != y), lambda x: x))
    return (100 * small >= percent * large) & F.when(100 * small >= percent * large, differ <= most)


def _confirmed(pairs: DataFrame, rows: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (``a``, ``b``) whose full sets are similar enough."""
    ids = pairs.select(F.col("a").alias("k")).union(pairs.select(F.col("b").alias("k"))).select(F.xxhash64("k").alias("token"))
    sets = scratch.table(_sets(rows, word_filter(ids), width))
    first = sets.select(F.col("_key").alias("a"), F.col("shingles").alias("xs"))
    second = sets.select(F.col("_key").alias("b"), F.col("shingles").alias("ys"))
    both = F.size(F.array_intersect("xs", "ys"))
    return pairs.join(second, "b").join(first, "a").where(100 * both >= percent * (F.size("xs") + F.size("ys") - both)).select("a", "b")


def _apart(mixed: DataFrame, rows: DataFrame, firsts: DataFrame, width: int, percent: int, most: int, scratch: Scratch) -> DataFrame:
    """Pairs (``a`` < ``b``) of different components with one ``outside`` that can be similar enough.

    Shingles of each set are ordered by how many of these sets have them.  The first one that two sets share bounds
    their common shingles by what is left behind it in either.
    """
    sets = scratch.table(_sets(rows, word_filter(mixed.select(F.xxhash64("_key").alias("token"))), width))
    each = sets.join(mixed.select("_key"), "_key", "left_semi").select("_key", F.explode("shingles").alias("token"))
    counted = each.join(each.groupBy("token").agg(F.count(F.lit(1)).alias("sets")), "token")
    ordered = counted.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("sets", "token"))).alias("x"))
    front = F.size("x") - F.ceil(F.size("x") * F.lit(percent) / 100).cast("int") + 1
    prefix = ordered.select("_key", F.posexplode(F.slice("x", F.lit(1), front)).alias("at", "x")).select("_key", "at", "x.token")
    prefix = scratch.table(prefix.join(mixed, "_key").join(firsts.select("_key", "n", "signature"), "_key"))
    side = lambda k: prefix.select("token", F.col("_key").alias(k), F.col("root").alias(f"r{k}"), F.col("at").alias(f"p{k}"), F.col("n").alias(f"n{k}"), F.col("signature").alias(f"s{k}"), F.col("outside").alias(f"o{k}"))
    left = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    enough = (100 + percent) * left >= percent * (F.col("na") + F.col("nb"))
    pairs = side("a").where("oa").join(side("b"), "token").where("a <> b and ra <> rb").where(enough).where(_close(most, percent))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, ``n_shingles``, ``component`` (the smallest key reachable) and ``kept``.

    Documents are linked if the Jaccard similarity of their sets of ``width``-word shingles is at least
    ``percent``.  A document of fewer words is one shingle; null texts and texts without words have the empty
    set and no link.  Where ids repeat or are null, rows are told apart and ``kept`` marks one row of each
    component; ties go to the smaller id, then the smaller text.  Other columns don't matter.
    """
    found = _components(keyed(docs, key, text), width, percent)
    return found.select(F.col("_id").alias(key), F.col("n").alias("n_shingles"), "component", "kept")


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, with all their columns, of which ``near_duplicates`` keeps one for each component."""
    rows = keyed(docs, key, text, whole=True)
    gone = _components(rows, width, percent).where("not kept").select("_key")
    return texts_back(rows.join(gone, "_key", "left_anti"), docs, text)


def _components(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """(``_key``, ``_id``, ``n``, ``component``, ``kept``) of every row."""
    with Scratch(rows.sparkSession) as scratch:
        return durable(_found(rows, width, percent, scratch))


def _found(rows: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    parts, places = shape(percent)
    most = 2 * parts - 1
    signed = scratch.table(_signed(rows, width, parts * places))
    same = ["n", "sum1", "sum2"]
    classes = signed.where("n > 0").groupBy(*same).agg(F.min("_key").alias("first"))
    members = scratch.table(signed.where("n > 0").select("_key", *same).join(classes, same).select("_key", "first"))
    firsts = signed.join(members.where("_key = first").select("_key"), "_key").select("_key", "n", "signature")
    keys = _keys(firsts, parts, places)
    shared = keys.groupBy("bucket").agg(F.min("_key").alias("least"), F.count(F.lit(1)).alias("members")).where("members > 1").select("bucket", "least")
    shared = scratch.table(keys.join(shared, "bucket").select("bucket", "least", "_key"))
    side = lambda c, k: firsts.select(F.col("_key").alias(c), F.col("n").alias(f"n{k}"), F.col("signature").alias(f"s{k}"))
    led = shared.where("_key <> least").select(F.col("least").alias("a"), F.col("_key").alias("b")).distinct()
    led = scratch.table(led.join(side("b", "b"), "b").join(side("a", "a"), "a").where(_close(most, percent)).select("a", "b"))
    links = scratch.table(_confirmed(led, rows, width, percent, scratch))
    roots = components(links, scratch)
    # Keys whose members are in several components: what wasn't compared yet is compared now.
    placed = shared.select("bucket", "_key").join(roots, F.col("_key") == F.col("node"), "left").select("bucket", "_key", F.coalesce("root", "_key").alias("root"))
    sizes = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("size"))
    mixed = sizes.groupBy("bucket").agg(F.max(F.struct("size", "root")).alias("most"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    mixed = placed.join(mixed, "bucket").groupBy("_key", "root").agg(F.max(F.col("root") != F.col("most.root")).alias("outside"))
    apart = scratch.table(_apart(scratch.table(mixed), rows, firsts, width, percent, most, scratch).join(led, ["a", "b"], "left_anti"))
    if not apart.isEmpty():
        roots = components(links.union(_confirmed(apart, rows, width, percent, scratch)), scratch)
    found = members.join(roots, F.col("first") == F.col("node"), "left").select("_key", F.coalesce("root", "first").alias("root"))
    named = signed.select(F.col("_key").alias("root"), F.col("_id").alias("component"))
    return (
        signed.select("_key", "_id", "n")
        .join(found, "_key", "left")
        .withColumn("root", F.coalesce("root", "_key"))
        .join(named, "root")
        .select("_key", "_id", "n", "component", (F.col("_key") == F.col("root")).alias("kept"))
    )
