"""Repeated byte strings by a sparse suffix order.

Of every string of ``length`` bytes one position is its anchor: where the hash of the next ``GRAM`` bytes is
smallest.  Equal strings have equal anchors, so only suffixes at anchors need to be compared.  They are ordered
by fingerprints of their leading bytes, then by what surrounds them, document and place: Spark samples the
splitters of the ranges, and each range is sorted on its own.  Neighbours in that order decide:

* whole stretches around anchors that equal an earlier one are repeated,
* stretches alone under their leading bytes hold nothing repeated,
* of the others, the first of each kind goes on with its single strings.  Eight strings at a time share a core;
  those whose core is repeated are ordered in the same way, and all but the first of equals are repeated.

Ranges may cut a group of equals, as document and place belong to the order, so no group has to fit into one
range.  Across a boundary, rows that could belong together go on to the exact comparison of single strings, and
there the last row of a range is compared with the first of the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoin.llm.common import PIECE, flat, keyed, list_array, slices, texts_back
from quoin.llm.words import mix, span_hashes
from quoin.session import Scratch, durable

#: Leading bytes whose hash picks the anchors.
GRAM = 24
#: Strings that share a core.
BLOCK = 8
#: Bytes of text for each range of the order.
RANGE = 1 << 24

_LONG, _INT = T.LongType(), T.IntegerType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Row, place, and first and last string start of each anchor, its leading hash and the two of its stretch.

    Places count from the beginning of the batch.
    """
    n = len(data)
    edge = np.zeros(n + 1, np.int32)  # where no string begins: the last length - 1 bytes of each row
    np.add.at(edge, np.maximum(offsets[:-1], offsets[1:] - length + 1), 1)
    np.add.at(edge, offsets[1:], -1)
    begins = np.cumsum(edge)[:n] == 0
    span = length - GRAM + 1
    out = []
    for a in range(0, n, PIECE):
        piece = data[a : min(n, a + PIECE + length - 1)]
        if len(piece) < length:
            break
        at = np.arange(len(piece) - GRAM + 1)
        value = (span_hashes(piece, at, at + GRAM) >> np.uint64(32) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - at.astype(np.uint64))
        step = 1
        while 2 * step <= span:
            value = np.minimum(value[:-step], value[step:])
            step *= 2
        if step < span:
            value = np.minimum(value[: len(value) - (span - step)], value[span - step :])
        start = np.flatnonzero(begins[a : a + len(value)])
        if not len(start):
            continue
        place = (np.uint64(0xFFFFFFFF) - (value[start] & np.uint64(0xFFFFFFFF))).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)]))
        low, high, place = start[new], start[np.append(new[1:], len(start)) - 1], place[new]
        shape = mix(((place - low) * (length + 1) + high - low).astype(np.uint64))
        both = [span_hashes(piece, low, high + length, k) for k in (0, 1)]
        out.append((place + a, low + a, high + a, span_hashes(piece, place, place + GRAM), both[0] ^ shape, both[1]))
    place, low, high, lead, whole, check = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 3
    return np.searchsorted(offsets, place, "right") - 1, place, low, high, lead, whole, check


def _anchor_rows(rows: DataFrame, length: int) -> DataFrame:
    """``lead``, ``whole`` and ``check``, document, ``low`` (byte where the first string begins), ``shape`` (anchor and last start from there)."""
    schema = _schema(lead=_LONG, whole=_LONG, check=_LONG, _key=_LONG, low=_INT, shape=_INT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            data, offsets = flat(batch.column("_text"))
            row, place, low, high, lead, whole, check = anchors(data, offsets, length)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(lead.view(np.int64)),
                    pa.array(whole.view(np.int64)),
                    pa.array(check.view(np.int64)),
                    batch.column("_key").take(pa.array(row)),
                    pa.array((low - offsets[row]).astype(np.int32)),
                    pa.array(((place - low) << 16 | (high - low)).astype(np.int32)),
                ],
                names=schema.fieldNames(),
            )

    return rows.select("_key", "_text").mapInArrow(run, schema)


def _ordered(rows: DataFrame, ranges: int, *by: str) -> DataFrame:
    return rows.repartitionByRange(ranges, *by).sortWithinPartitions(*by)


def _judged(rows: DataFrame) -> DataFrame:
    """Of ordered anchors, those that are ``repeated`` and those to compare string by string."""
    schema = _schema(_key=_LONG, low=_INT, shape=_INT, repeated=T.BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple[int, int, int] | None = None
        held: pa.RecordBatch | None = None  # the first of a group that has one kind so far
        for batch in batches:
            if not batch.num_rows:
                continue
            lead, whole, check = (batch.column(c).to_numpy() for c in ("lead", "whole", "check"))
            n = len(lead)
            new_lead, new = np.ones(n, bool), np.ones(n, bool)
            new_lead[1:] = lead[1:] != lead[:-1]
            new[1:] = new_lead[1:] | (whole[1:] != whole[:-1]) | (check[1:] != check[:-1])
            first_of_range = before is None
            if before is not None:
                new_lead[0], new[0] = lead[0] != before[0], (lead[0], whole[0], check[0]) != before
            group = np.cumsum(new_lead)  # 0: continues the group held from before
            count = np.bincount(group, new, int(group[-1]) + 1)
            compare = new & ((count[group] > 1) | (group == 0))
            if held is not None and count[0]:
                yield held
                held = None
            if first_of_range:
                compare[0] = True  # may continue the range before
            last = int(group[-1])
            take = np.flatnonzero(~new | compare)
            yield _verdicts(batch, take, ~new[take], schema)
            if last:
                begin = int(np.flatnonzero(group == last)[0])
                held = None if compare[begin] else _verdicts(batch, np.array([begin]), np.array([False]), schema)
            before = (int(lead[-1]), int(whole[-1]), int(check[-1]))
        if held is not None:
            yield held  # its group may go on in the next range

    return rows.mapInArrow(run, schema)


def _verdicts(batch: pa.RecordBatch, take: np.ndarray, repeated: np.ndarray, schema: T.StructType) -> pa.RecordBatch:
    at = pa.array(take)
    return pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("_key", "low", "shape")), pa.array(repeated)], names=schema.fieldNames())


def _contexts(rows: DataFrame, some: DataFrame, length: int) -> DataFrame:
    """The bytes of the stretches of ``some`` anchors."""
    per = some.groupBy("_key").agg(F.collect_list(F.struct("low", "shape")).alias("at"))
    schema = _schema(_key=_LONG, low=_INT, shape=_INT, stretch=T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            data, offsets = flat(batch.column("_text"))
            lists = batch.column("at")
            at = lists.flatten()
            low, shape = (at.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            row = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(lists)))
            size = (shape & 0xFFFF) + length
            for a in range(0, len(row), 1 << 15):
                r, w, s, z = row[a : a + (1 << 15)], low[a : a + (1 << 15)], shape[a : a + (1 << 15)], size[a : a + (1 << 15)]
                ends = np.cumsum(z)
                byte = np.arange(ends[-1]) + np.repeat(offsets[r] + w - (ends - z), z)
                buffers = [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes()), pa.py_buffer(data[byte].tobytes())]
                stretch = pa.Array.from_buffers(pa.binary(), len(r), buffers)
                yield pa.RecordBatch.from_arrays([batch.column("_key").take(pa.array(r)), pa.array(w), pa.array(s), stretch], names=schema.fieldNames())

    return rows.join(per, "_key").select("_key", "_text", "at").mapInArrow(run, schema)


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return flat(column.cast(pa.large_binary()).view(pa.large_string()) if len(column) else pa.array([], pa.large_string()))


def _strings(shape: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every string of every stretch: its stretch, its start there, and the anchor's distance from it."""
    count = (shape & 0xFFFF) + 1
    row = np.repeat(np.arange(len(shape)), count)
    start = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, start, (shape >> 16)[row] - start


def _cores(contexts: DataFrame, length: int) -> DataFrame:
    """``core`` of each block of strings of each stretch."""
    schema = _schema(core=_LONG, _key=_LONG, low=_INT, block=_INT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "stretch"):
            data, offsets = _binary(batch.column("stretch"))
            row, start, distance = _strings(batch.column("shape").to_numpy())
            block = distance // BLOCK
            new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (block[1:] != block[:-1])]))
            row, block = row[new], block[new]
            # Inside all strings of a block: from the latest start to the earliest end.
            begin = offsets[row] + (start + distance)[new] - block * BLOCK
            core = span_hashes(data, begin, begin + length - BLOCK + 1) + mix(block.astype(np.uint64))
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(core.view(np.int64)), batch.column("_key").take(at), batch.column("low").take(at), pa.array(block.astype(np.int32))], names=schema.fieldNames()
            )

    return contexts.select("_key", "low", "shape", "stretch").mapInArrow(run, schema)


def _string_rows(contexts: DataFrame, blocks: DataFrame, length: int) -> DataFrame:
    """The two hashes of each string of the given blocks, and where it begins."""
    per = blocks.groupBy("_key", "low").agg(F.collect_set("block").alias("blocks"))
    schema = _schema(string=_LONG, check=_LONG, _key=_LONG, start=_INT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "stretch", PIECE // 4):
            data, offsets = _binary(batch.column("stretch"))
            row, start, distance = _strings(batch.column("shape").to_numpy())
            lists = batch.column("blocks")
            owner = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(lists)))
            wanted = np.isin(row * 1024 + distance // BLOCK, owner * 1024 + lists.flatten().to_numpy())
            row, start = row[wanted], start[wanted]
            begin = offsets[row] + start
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array(span_hashes(data, begin, begin + length, k).view(np.int64)) for k in (0, 1)),
                    batch.column("_key").take(at),
                    pa.array((batch.column("low").to_numpy()[row] + start).astype(np.int32)),
                ],
                names=schema.fieldNames(),
            )

    return contexts.join(per, ["_key", "low"]).select("_key", "low", "shape", "stretch", "blocks").mapInArrow(run, schema)


def _later(rows: DataFrame) -> DataFrame:
    """Of ordered strings, all but the first of equals; ``edge`` marks first (1) and last (2) rows of a range."""
    schema = _schema(string=_LONG, check=_LONG, _key=_LONG, start=_INT, edge=_INT, range=_INT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, last = TaskContext.get().partitionId(), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            string, check = (batch.column(c).to_numpy() for c in ("string", "check"))
            same = np.zeros(len(string), bool)
            same[1:] = (string[1:] == string[:-1]) & (check[1:] == check[:-1])
            if before is not None:
                same[0] = (string[0], check[0]) == before
            else:
                yield _edge(batch.slice(0, 1), 1, part, schema)
            yield _edge(batch.filter(pa.array(same)), 0, part, schema)
            before, last = (string[-1], check[-1]), batch.slice(batch.num_rows - 1)
        if last is not None:
            yield _edge(last, 2, part, schema)

    return rows.mapInArrow(run, schema)


def _edge(batch: pa.RecordBatch, edge: int, part: int, schema: T.StructType) -> pa.RecordBatch:
    full = [pa.array(np.full(batch.num_rows, x, np.int32)) for x in (edge, part)]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("string", "check", "_key", "start")), *full], names=schema.fieldNames())


def repeated_spans(rows: DataFrame, length: int) -> DataFrame:
    """(``_key``, ``spans``): byte spans of each document that are under a string that also begins earlier."""
    if not GRAM <= length < 1 << 13:
        raise ValueError(f"length must be from {GRAM} to {(1 << 13) - 1}")
    with Scratch(rows.sparkSession) as scratch:
        return durable(_spans(rows, length, scratch))


def _spans(rows: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    ranges = int(size // RANGE) + 1
    judged = scratch.table(_judged(_ordered(_anchor_rows(rows, length), ranges, "lead", "whole", "check", "_key", "low")))
    contexts = scratch.table(_contexts(rows, judged.where("not repeated"), length))
    cores = _cores(contexts, length)
    common = cores.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core")
    strings = scratch.table(_string_rows(contexts, cores.join(common, "core").select("_key", "low", "block"), length))
    later = scratch.table(_later(_ordered(strings, ranges, "string", "check", "_key", "start")))
    lasts = later.where("edge = 2").select(F.col("string").alias("last_string"), F.col("check").alias("last_check"), F.col("range").alias("last_range"))
    equal = (F.col("string") == F.col("last_string")) & (F.col("check") == F.col("last_check"))
    begun = later.where("edge = 1").join(lasts, equal & (F.col("last_range") < F.col("range")), "left_semi")
    single = later.where("edge = 0").unionByName(begun).select("_key", F.col("start").alias("first"), (F.col("start") + length).alias("last"))
    whole = judged.where("repeated").select("_key", F.col("low").alias("first"), (F.col("low") + F.col("shape").bitwiseAND(0xFFFF) + length).alias("last"))
    return single.union(whole).groupBy("_key").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def merged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs under spans."""
    if not len(first):
        return first, last
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(last[order])
    new = np.flatnonzero(np.concatenate([[True], first[1:] > reach[:-1]]))
    return first[new], reach[np.append(new[1:], len(first)) - 1]


def without_repeats(docs: DataFrame, length: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, ``n_bytes``, ``spans`` (maximal removed byte runs) and ``kept`` (the other bytes).

    A byte goes if it is under a string of ``length`` bytes that also begins earlier: in a smaller document or
    before in the same one; all strings are judged on the input.  Null and empty texts have no bytes; texts
    shorter than ``length`` stay whole.  Where ids repeat or are null, the earlier row is the one with the smaller
    id (null first), then the smaller text.  Runs may cut characters, so ``kept`` is binary.  Other columns don't
    matter.
    """
    rows = keyed(docs, key, text)
    return _cut(rows, repeated_spans(rows, length), ["_id"], T.BinaryType()).withColumnRenamed("_id", key)


def deduplicated(docs: DataFrame, length: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with all columns, their texts without repeated strings, and without texts that lose everything.

    As ``without_repeats``, but a character goes as a whole if any of its bytes goes.  Null and empty texts stay.
    """
    rows = keyed(docs, key, text, whole=True)
    cut = _cut(rows, repeated_spans(rows, length), ["_rest"], T.StringType())
    left = cut.where("n_bytes = 0 or kept <> ''").withColumn("_text", F.when(F.col("had_text"), F.col("kept")))
    return texts_back(left, docs, text)


def _cut(rows: DataFrame, spans: DataFrame, carry: list[str], kind: T.DataType) -> DataFrame:
    """``carry``, ``n_bytes``, ``spans``, ``kept`` and ``had_text`` (whether the text isn't null) of every row."""
    pair = T.ArrayType(T.StructType([T.StructField("first", _INT), T.StructField("last", _INT)]))
    fields = {"n_bytes": _LONG, "spans": pair, "kept": kind, "had_text": T.BooleanType()}
    schema = T.StructType([*(rows.schema[c] for c in carry), *(T.StructField(k, v) for k, v in fields.items())])
    as_text = isinstance(kind, T.StringType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            data, offsets = flat(batch.column("_text"))
            lists = batch.column("spans")
            flat_spans = lists.flatten()
            first, last = (flat_spans.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            count = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
            row = np.repeat(np.arange(batch.num_rows), count)
            base = offsets + np.arange(len(offsets))  # a gap between rows keeps their runs apart
            first, last = merged(first + base[row], last + base[row])
            row = np.searchsorted(base, first, "right") - 1
            first, last = first - row, last - row
            gone = np.zeros(len(data) + 1, np.int8)
            gone[first] = 1
            gone[last] -= 1
            stay = np.cumsum(gone)[: len(data)] == 0
            if as_text and len(first):
                character = np.cumsum(data & 0xC0 != 0x80) - 1
                stay = (np.bincount(character, ~stay) == 0)[character]
            left = np.concatenate([[0], np.cumsum(stay)])[offsets]
            buffers = [None, pa.py_buffer(left.astype(np.int32).tobytes()), pa.py_buffer(data[stay].tobytes())]
            kept = pa.Array.from_buffers(pa.string() if as_text else pa.binary(), batch.num_rows, buffers)
            runs = pa.StructArray.from_arrays([pa.array((x - offsets[row]).astype(np.int32)) for x in (first, last)], names=["first", "last"])
            out = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32()), runs)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carry), pa.array(np.diff(offsets)), out, kept, batch.column("_text").is_valid()], names=schema.fieldNames()
            )

    return rows.join(spans, "_key", "left").select(*carry, "_text", "spans").mapInArrow(run, schema)
