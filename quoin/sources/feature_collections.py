"""GeoJSON FeatureCollections of any size, read by many tasks.

A FeatureCollection is one JSON value, often one line, so line readers give it to one task.  Here Spark's text
reader cuts files behind closing braces, which any file system and any split of a file allows.  What a cut means
depends on everything before it: whether it lies in a string, and how deep.  So a first pass works out, for every
block of a file, what it does to the state before it, once for each state it could find.  A handful of numbers per
block are composed on the driver in file order, and the second pass knows its place: an object that opens as an
element at depth three is a feature.  Features that reach beyond a block leave pieces, which are put together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoin.operators.checks import ValidationError

# Bytes of JSON's structure.
_QUOTE, _BACKSLASH, _OPEN, _CLOSE, _COLON = (ord(c) for c in '"\\{}:')
_UP, _DOWN, _SPACE = (np.isin(np.arange(256), [ord(c) for c in chars]) for chars in ("{[", "}]", " \t\r\n"))

_BLOCK = [T.StructField("path", T.StringType()), T.StructField("block", T.LongType())]
_EFFECTS = T.StructType([*_BLOCK, *(T.StructField(f"{name}{s}", T.LongType()) for s in (0, 1) for name in ("end", "delta", "low"))])
_PIECES = T.StructType([*_BLOCK, T.StructField("owner", T.LongType()), T.StructField("text", T.StringType())])


def _in_strings(data: np.ndarray, inside: int) -> np.ndarray:
    """Whether each byte lies in a string (closing quotes don't); ``inside`` says it of the first."""
    quote = data == _QUOTE
    at = np.flatnonzero(quote)
    back = data == _BACKSLASH
    if back.any():  # a quote behind an odd number of backslashes is text
        other = np.maximum.accumulate(np.where(back, -1, np.arange(len(data))))
        before = np.where(at > 0, at - 1 - np.where(at > 0, other[at - 1], -1), 0)
        quote[at[before % 2 == 1]] = False
    return ((np.cumsum(quote) + inside) & 1).astype(bool)


def _depths(data: np.ndarray, inside: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes in strings, and the depth after each byte, relative to the one before the first."""
    strings = _in_strings(data, inside)
    step = np.zeros(len(data), np.int8)
    step[_UP[data]] = 1
    step[_DOWN[data]] = -1
    step[strings] = 0
    return strings, np.cumsum(step, dtype=np.int64)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, np.ndarray]]:
    """(path, block, bytes) of neighbouring rows of one block, with the braces that the reader took away."""
    for batch in batches:
        block, path = batch.column("block").to_numpy(), batch.column("path").dictionary_encode().indices.to_numpy()
        edges = np.flatnonzero((np.diff(block) != 0) | (np.diff(path) != 0)) + 1
        for begin, end in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
            if begin < end:
                texts = batch.column("value").slice(begin, end - begin).to_pylist()
                yield batch.column("path")[begin].as_py(), int(block[begin]), np.frombuffer(("}".join(texts) + "}").encode(), np.uint8)


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block and state before it (outside or in a string): the state after it, the depth gained, the lowest."""
    found: dict[tuple[str, int], list[int]] = {}
    for path, block, data in _runs(batches):
        now = found.setdefault((path, block), [0, 0, 0, 1, 0, 0])
        for s in (0, 1):
            end, delta, low = now[3 * s : 3 * s + 3]
            strings, depth = _depths(data, end)
            now[3 * s : 3 * s + 3] = int(strings[-1]), delta + int(depth[-1]), min(low, delta + int(depth.min()))
    rows = [(*key, *values) for key, values in found.items()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 0 else pa.int64()) for k, c in enumerate(zip(*rows, strict=True))], names=_EFFECTS.fieldNames())


@dataclass
class _Start:
    """What holds before a block: in a string, depth, and the block in which the open element began (-1: none)."""

    inside: int
    depth: int
    owner: int


def _starts(effects: list) -> dict[tuple[str, int], _Start]:
    """The state before every block, in the order of each file; an end in the middle of something raises."""
    out: dict[tuple[str, int], _Start] = {}
    last = None
    for r in sorted(effects, key=lambda r: (r["path"], r["block"])):
        if last is None or last[0] != r["path"]:
            if last is not None:
                _whole(*last)
            now = _Start(0, 0, -1)
        out[r["path"], r["block"]] = now
        s = now.inside
        after = now.depth + r[f"delta{s}"]
        began_here = now.owner < 0 or now.depth + r[f"low{s}"] <= 2
        now = _Start(r[f"end{s}"], after, (r["block"] if began_here else now.owner) if after >= 3 else -1)
        last = (r["path"], now)
    if last is not None:
        _whole(*last)
    return out


def _whole(path: str, end: _Start) -> None:
    if end.inside or end.depth > 0:
        raise ValidationError(f"{path} ends in the middle of a value")


def _features(starts: dict[tuple[str, int], _Start]):
    """(path, block, owner, text) of the elements of each block; ``owner`` is null for whole ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[str, int] | None = None
        held: list[bytes] = []  # of the open element
        inside = depth = owner = 0
        wanted, before = False, 0

        def rest() -> list[tuple]:
            """The piece that reaches beyond the block."""
            return [(*at, owner, b"".join(held).decode())] if at is not None and depth >= 3 and wanted and held else []

        for path, block, data in _runs(batches):
            out: list[tuple] = []
            if (path, block) != at:
                out += rest()
                at, held = (path, block), []
                start = starts[at]
                # Whether the open element is a feature, the block in which it began knows.
                inside, depth, owner, wanted, before = start.inside, start.depth, start.owner, start.depth >= 3, 0
            strings, depths = _depths(data, inside)
            depths += depth
            up, down = _UP[data] & ~strings, _DOWN[data] & ~strings
            opens, closes = np.flatnonzero(up & (depths == 3)), np.flatnonzero(down & (depths == 2))
            solid = np.flatnonzero(~_SPACE[data])
            behind = np.searchsorted(solid, opens) - 1
            previous = np.where(behind >= 0, data[solid[np.maximum(behind, 0)]], before)
            # An object that isn't a member's value is an element.
            element = (data[opens] == _OPEN) & (previous != _COLON)
            begin = 0 if depth >= 3 else -1
            k = 0
            for close in closes.tolist():
                if begin < 0:
                    begin, wanted, owner = int(opens[k]), bool(element[k]), -1
                    k += 1
                if wanted:
                    text = b"".join(held) + data[begin : close + 1].tobytes()
                    out.append((path, block, owner if owner >= 0 else None, text.decode()))
                held, begin, owner = [], -1, -1
            if begin < 0 and k < len(opens):
                begin, wanted, owner = int(opens[k]), bool(element[k]), -1
            if begin >= 0 and wanted:
                held.append(data[begin:].tobytes())
            inside, depth = int(strings[-1]), int(depths[-1])
            if depth >= 3 and owner < 0:
                owner = -2  # began in this block; named when the block ends
            before = int(data[solid[-1]]) if len(solid) else before
            if out:
                yield _batch(out)
        last = rest()
        if last:
            yield _batch(last)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        rows = [(p, b, b if o == -2 else o, t) for p, b, o, t in rows]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=_PIECES.fieldNames())

    return run


def feature_texts(spark: SparkSession, path: str) -> DataFrame:
    """``text``: the JSON of every element of the collections' arrays, features and whatever else stands there.

    Eager: one pass over the files finds where their blocks begin, one row per block reaches the driver.
    """
    lines = spark.read.option("lineSep", "}").text(path)
    blocks = lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    pieces = blocks.mapInArrow(_features(_starts(blocks.mapInArrow(_effects, _EFFECTS).collect())), _PIECES)
    cut = pieces.where("owner is not null").groupBy("path", "owner").agg(F.sort_array(F.collect_list(F.struct("block", "text"))).alias("parts"))
    # Without its beginning a piece belongs to something that is no element.
    cut = cut.where(F.col("parts")[0]["block"] == F.col("owner"))
    joined = cut.select(F.array_join(F.transform("parts", lambda x: x["text"]), "").alias("text"))
    return pieces.where("owner is null").select("text").unionByName(joined)
