"""Subword encoding that keeps offsets, and decoding.

Text is normalised through the compiled character map, longest prefix first, recording for each normalised
character the source byte it comes from.  Pieces are merged on the normalised text and projected back to byte
spans of the source.  Merges never cross the start of a run of marks, so each stretch up to the next run is
encoded once and remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quoin.llm.common import list_array, mapped, slices
from quoin.llm.pieces import MARK, Model, model, model_bytes

#: Stretches that a worker remembers before it begins anew; bounds its memory.
MEMORY = 250_000
#: Texts of a slice in bytes, and new stretches merged at a time; bound the working memory.
SLICE, ROUND = 1 << 20, 8192
_STRETCH = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

_ENCODED = T.StructType([T.StructField(name, T.ArrayType(T.IntegerType(), False), False) for name in ("ids", "starts", "ends")])


class Encoder:
    """Encodes texts with one model, remembering stretches."""

    def __init__(self, compiled: Model):
        self.model = compiled
        self._forget()

    def _forget(self) -> None:
        self.seen: dict[str, int] = {}
        # Tokens of all stretches: id, first and last character (exclusive); and each stretch's first token and number.
        self.ids, self.starts, self.ends, self.firsts, self.counts = (np.empty(0, np.int32) for _ in range(5))

    def _slowly(self, text: str) -> tuple[list[int], list[int], list[int]]:
        m, ids, starts, ends, at = self.model, [], [], [], 0
        for token in m.tokens(text):
            end = at + len(token)
            known = m.ids.get(token)
            if known is not None:
                ids.append(known)
                starts.append(at)
                ends.append(end)
            elif m.byte_fallback:
                raw = token.encode()
                ids += [m.byte_ids[b] for b in raw]
                starts += [at] * len(raw)
                ends += [at] * (len(raw) - 1) + [end]  # the last byte carries the character
            elif ids and ids[-1] == m.unk:
                ends[-1] = end
            else:
                ids.append(m.unk)
                starts.append(at)
                ends.append(end)
            at = end
        return ids, starts, ends

    def _learn(self, stretches: list[str]) -> None:
        """Append the tokens of new stretches, in their order."""
        new, base = [], len(self.ids)
        first, count = np.zeros(len(stretches), np.int64), np.full(len(stretches), -1, np.int64)
        size = np.fromiter(map(len, stretches), np.int64, len(stretches))
        for low, high in ((0, 6), (6, 9), (9, 13), (13, 32)):
            group = np.flatnonzero((size > low) & (size <= high))
            for some in np.split(group, range(ROUND, len(group), ROUND)) if len(group) else ():
                ids, ends, firsts = self.model.cut([stretches[k] for k in some])
                starts = np.concatenate([[0], ends[:-1]])
                starts[firsts[:-1]] = 0
                first[some] = base + firsts[:-1]
                count[some] = np.where(np.logical_or.reduceat(ids < 0, firsts[:-1]), -1, np.diff(firsts))
                new.append(tuple(x.astype(np.int32) for x in (ids, starts, ends)))
                base += len(ids)
        for k in np.flatnonzero(count < 0):
            part = self._slowly(stretches[k])
            first[k], count[k] = base, len(part[0])
            new.append(part)
            base += len(part[0])
        for name, column in zip(("ids", "starts", "ends"), zip(*new, strict=True), strict=True):
            setattr(self, name, np.concatenate([getattr(self, name), *(np.asarray(x, np.int32) for x in column)]))
        self.firsts, self.counts = np.concatenate([self.firsts, first]), np.concatenate([self.counts, count])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, the first and last source byte (exclusive) of each, and each text's number of ids."""
        if len(self.seen) > MEMORY:
            self._forget()
        whole = not (self.model.splits and self.model.byte_fallback)
        seen, fresh, which, sizes, widths, origins, bases, base = self.seen, [], [], [], [], [], [], 0
        for text in texts:
            normal, origin = self.model.normalise(text)
            stretches = ([normal] if normal else []) if whole else _STRETCH.findall(normal)
            for s in stretches:
                k = seen.get(s)
                if k is None:
                    k = seen[s] = len(seen)
                    fresh.append(s)
                which.append(k)
            sizes.append(len(stretches))
            widths += map(len, stretches)
            origins.append(origin)
            bases.append(base)
            base += len(origin)
        if fresh:
            self._learn(fresh)
        index, wide = np.array(which, np.int64), np.array(widths, np.int64)
        text_of = np.repeat(np.arange(len(texts)), sizes)
        first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        before = np.concatenate([[0], np.cumsum(wide)])
        at = before[:-1] - before[first][text_of] + np.array(bases, np.int64)[text_of]  # of each stretch, among all origins
        counts = self.counts[index]
        ends = np.cumsum(counts)
        token = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.firsts[index] - (ends - counts), counts)
        shift, origin = np.repeat(at, counts), np.concatenate(origins) if origins else np.empty(0, np.int64)
        totals = np.bincount(text_of, counts, len(texts)).astype(np.int64)
        return self.ids[token], origin[shift + self.starts[token]], origin[shift + self.ends[token]], totals


class Decoder:
    """Text of id lists."""

    def __init__(self, compiled: Model):
        self.model, self.control = compiled, {k for k, kind in enumerate(compiled.types) if kind == 3}

    def text_of(self, row: Sequence[int]) -> str:
        m = self.model
        whole = b"".join([m.raw[k] for k in row])
        if m.dummy and whole[:1] == b" ":
            first = next((k for k in row if k not in self.control), None)
            if first is not None and m.names[first].startswith(MARK):
                whole = whole[1:]
        return _decoded(whole)


def encode(df: DataFrame, model_path: str, text: str = "text", keep: Sequence[str] | None = None, end: bool = False, decoded: str | None = None) -> DataFrame:
    """``df`` with ``ids``, and ``starts`` and ``ends``: the span of source bytes of each id.

    ``decoded`` names a column for the text that the ids decode to, worked out in the same trip.

    ``keep`` names the columns to carry (all by default); a carried column named like a new one is replaced.
    Null and empty texts have no ids (only the end id where ``end`` asks for it, with an empty span behind the
    text).  Rows are independent, so repeated rows and ids do no harm; an empty table stays empty.
    """
    data = model_bytes(model_path)
    fields = [*_ENCODED.fields, *([T.StructField(decoded, T.StringType(), False)] if decoded else [])]
    new = [f.name for f in fields]
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(model(data)), Decoder(model(data))
        for batch in slices(batches, "value", SLICE):
            texts = [value or "" for value in batch.column("value").to_pylist()]
            *columns, sizes = encoder.encode(texts)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            if end:
                size = [len(value.encode()) for value in texts]
                columns = [np.insert(c, offsets[1:], x) for c, x in zip(columns, (encoder.model.end_id, size, size), strict=True)]
                offsets = offsets + np.arange(len(offsets))
            lists = [list_array(c.astype(np.int32), offsets, pa.int32()) for c in columns]
            if decoded:
                ids = columns[0].tolist()
                lists.append(pa.array([decoder.text_of(ids[a:b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)], pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("given"), *lists], names=["given", *new])

    return mapped(df, text, kept, run, fields)


def decode(df: DataFrame, model_path: str, ids: str = "ids", into: str = "decoded", keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` with the text of each id list in ``into``; control ids yield nothing, null lists the empty text.

    Bytes that form no character become U+FFFD.  ``keep`` as in :func:`encode`.
    """
    data = model_bytes(model_path)
    kept = [c for c in (df.columns if keep is None else keep) if c != into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model(data))
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                texts = [decoder.text_of(row) if row else "" for row in part.column("value").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("given"), pa.array(texts, pa.string())], names=["given", into])

    return mapped(df, ids, kept, run, [T.StructField(into, T.StringType(), False)])


def _decoded(data: bytes) -> str:
    """UTF-8 text; each byte that is part of no character becomes one U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out = []
        while data:
            try:
                out.append(data.decode())
                break
            except UnicodeDecodeError as e:
                out.append(data[: e.start].decode() + "�")
                data = data[e.start + 1 :]
        return "".join(out)
