"""Fill-in-the-middle form of texts, and back.

Texts are cut into tokens, two cuts give prefix, middle and suffix, and the suffix moves before the middle.  All
texts of a batch are handled at once as one run of bytes: token ends come from one scan; each part of a text has
one displacement to its place in the output, kept as a difference array over the batch's bytes; cumulative sums
make it every byte's displacement, and a scatter writes the output.  Restoring finds the marks in the output and
gathers the bytes back in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoin.llm.common import carried, flat, slices
from quoin.llm.words import PRINTED

# The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
WIDTH = 3
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Bytes displaced at a time; bounds the working memory whatever the length of a text.
BLOCK = 1 << 20


def token_ends(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all tokens, and the first token of each row (rows + 1).

    A token is a run of other bytes with the spaces before it, or the spaces that end a row.
    """
    last = np.zeros(len(data), bool)
    last[at[1:][at[1:] > at[:-1]] - 1] = True
    inside = PRINTED[data]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends = np.flatnonzero(ends | last) + 1
    return ends, np.searchsorted(ends, at, "right")


def characters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Code points of each ``data[start:end]``."""
    inner = np.flatnonzero((data & 0xC0) == 0x80)
    return ends - starts - (np.searchsorted(inner, ends) - np.searchsorted(inner, starts))


def marks(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where marks begin that lie in one row."""
    some = np.flatnonzero(data[:-2] == PREFIX[0]) if len(data) > 2 else np.empty(0, np.int64)
    some = some[(data[some + 2] == PREFIX[2]) & np.isin(data[some + 1], [m[1] for m in (PREFIX, SUFFIX, MIDDLE)])]
    row = np.searchsorted(at, some, "right")
    return some[some + WIDTH <= at[np.minimum(row, len(at) - 1)]]


def displaced(starts: np.ndarray, shifts: np.ndarray, size: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Blocks of ``size`` places and where each place goes; ``shifts[k]`` holds from ``starts[k]`` on.

    ``starts`` ascend; of several parts that start at one place the last counts, the others being empty.
    """
    steps, carry = np.diff(shifts, prepend=0), 0
    for begin in range(0, size, BLOCK):
        end = min(size, begin + BLOCK)
        a, b = np.searchsorted(starts, [begin, end])
        moves = np.zeros(end - begin, np.int64)
        np.add.at(moves, starts[a:b] - begin, steps[a:b])
        moves[0] += carry
        np.cumsum(moves, out=moves)
        carry = moves[-1]
        yield slice(begin, end), moves + np.arange(begin, end)


def rearranged(data: np.ndarray, at: np.ndarray, first: np.ndarray, second: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The output of every row and where each begins (rows + 1); ``first`` and ``second`` are the cuts' places."""
    begin, end = at[:-1], at[1:]
    marked, spm = form != PLAIN, form == SPM
    p, m, s = np.where(marked, first, end) - begin, np.where(marked, second - first, 0), np.where(marked, end - second, 0)
    out_at = np.concatenate([[0], np.cumsum(np.diff(at) + 3 * WIDTH * marked)])
    base = out_at[:-1]
    w = WIDTH * marked
    to_prefix = base + w + np.where(spm, w + s, 0)
    to_suffix = base + w + np.where(spm, 0, w + p)
    to_middle = base + 3 * w + p + s
    starts = np.stack([begin, begin + p, begin + p + m], 1).ravel()
    shifts = np.stack([to_prefix, to_middle, to_suffix], 1).ravel() - starts
    out = np.empty(out_at[-1], np.uint8)
    for where, place in displaced(starts, shifts, len(data)):
        out[place] = data[where]
    for mark, to in ((PREFIX, to_prefix), (SUFFIX, to_suffix), (MIDDLE, to_middle)):
        for k in range(WIDTH):
            out[to[marked] - WIDTH + k] = mark[k]
    return out, out_at


def put_back(data: np.ndarray, at: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that ``rearranged`` got, and where each begins (rows + 1)."""
    begin, end = at[:-1], at[1:]
    marked, spm = form != PLAIN, form == SPM
    found = marks(data, at)
    found = found[marked[np.searchsorted(at, found, "right") - 1]]
    if not np.array_equal(np.bincount(np.searchsorted(at, found, "right") - 1, minlength=len(form)), 3 * marked):
        raise ValueError("an output that isn't plain has each mark once")
    one, two, three = (np.where(marked, 0, end) for _ in range(3))
    if len(found):
        one[marked], two[marked], three[marked] = found.reshape(-1, 3).T
    w = WIDTH * marked
    left, right = np.where(marked, one + w, begin), two + w  # the parts behind the first and the second mark
    prefix, suffix, middle = np.where(spm, right, left), np.where(spm, left, right), three + w
    p = np.where(marked, np.where(spm, three - right, two - left), end - begin)
    m = np.where(marked, end - middle, 0)
    out_at = np.concatenate([[0], np.cumsum(np.diff(at) - 3 * w)])
    base = out_at[:-1]
    starts = np.stack([base, base + p, base + p + m], 1).ravel()
    shifts = np.stack([prefix, middle, suffix], 1).ravel() - starts
    out = np.empty(out_at[-1], np.uint8)
    for where, place in displaced(starts, shifts, len(out)):
        out[where] = data[place]
    return out, out_at


def _strings(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 from the SHA-256 of the seed and the key's decimal text (nothing for null)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


_FIM = T.StructType(
    [
        T.StructField("n", T.LongType(), False),
        T.StructField("form", T.StringType(), False),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("output", T.StringType(), False),
    ]
)


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """``given`` (all columns but the text), ``n`` tokens, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    Cuts and form come from the key and the seed alone, so repeated keys are cut at the same shares and a rerun
    gives the same rows.  ``rate`` percent of the texts are rearranged, ``spm`` percent of those with the suffix
    first.  Null and empty texts, and texts that contain a mark, stay plain; a null key draws like an empty one.
    Rows are independent: repeated rows and an empty table do no harm, and columns of any name travel in ``given``.
    """
    rows = docs.select(carried(docs, text), F.array(*draws(F.col(f"`{key}`"), seed)).alias("h"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([rows.schema["given"], *_FIM.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, at = flat(batch.column("text"))
            h = batch.column("h").flatten().to_numpy().reshape(-1, 4)
            ends, tokens = token_ends(data, at)
            n = np.diff(tokens)
            cuts = np.sort(h[:, :2] % (n + 1)[:, None], 1)
            places = np.concatenate([ends, [0]])  # never without an entry
            first, second = (np.where(c == 0, at[:-1], places[tokens[:-1] + c - 1]) for c in cuts.T)
            plain = (np.diff(at) == 0) | (h[:, 2] % 100 >= rate)
            plain[np.searchsorted(at, marks(data, at), "right") - 1] = True
            form = np.where(plain, PLAIN, np.where(h[:, 3] % 100 < spm, SPM, PSM))
            out = rearranged(data, at, first, second, form)
            sizes = [pa.array(characters(data, a, b), pa.int64(), mask=plain) for a, b in ((at[:-1], first), (first, second))]
            yield pa.RecordBatch.from_arrays([batch.column("given"), pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), *sizes, _strings(*out)], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def restore(rows: DataFrame, output: str = "output", form: str = "form", into: str = "restored") -> DataFrame:
    """``given`` (all columns but the output) and the text that each output was made of, from output and form alone.

    Null outputs give empty texts; an output that is neither plain nor holds each mark once raises.
    """
    some = rows.select(carried(rows, output), F.coalesce(F.col(f"`{form}`"), F.lit(PLAIN)).alias("form"), F.col(f"`{output}`").cast("string").alias("output"))
    schema = T.StructType([some.schema["given"], T.StructField(into, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "output"):
            data, at = flat(batch.column("output"))
            form = np.array(batch.column("form").to_pylist(), object)
            yield pa.RecordBatch.from_arrays([batch.column("given"), _strings(*put_back(data, at, form))], names=schema.fieldNames())

    return some.mapInArrow(run, schema)
