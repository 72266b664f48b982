"""Token counts by a finite-state transducer.

The transducer reads normalised characters.  A state is the text read whose cut into tokens is still open; a
transition carries the number of tokens that it settles.  It follows from two facts about merges: the tokens
before a token boundary are those of the text up to there, and whatever follows, the token that reaches beyond
the last character begins where the rest of the text is the beginning of some token.  So what all those
beginnings have in common is settled.  States and transitions are made when first met and remembered.

A chunk of a text acts on the states before it.  Up to the first gap before a run of marks this action depends
on the state; from there on it does not, as nothing is open at such a gap.  Its map is therefore written as
(head, count, state): read ``head`` from the state before, settle, add ``count``, continue in ``state``.  Maps
compose associatively, so those of a long text are combined in a tree, many texts and chunks at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoin.llm.common import carried, slices
from quoin.llm.pieces import MARK, Model, model, model_bytes

#: Characters of a chunk.
CHUNK = 1 << 15
#: Maps that one group of a level composes.
FAN = 64
#: States that a worker remembers before it begins anew; bounds its memory.
MEMORY = 150_000

_GAP = re.compile(f"(?<=[^{MARK}]){MARK}")
_STRETCH = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class State(dict):
    """Transitions of a state: character to (next state, tokens settled)."""

    __slots__ = ("lasts", "machine", "open", "rest", "starts")

    def __init__(self, machine: Machine, text: str, lasts: list[int], starts: list[int]):
        #: Length of the last token of each beginning of the open text, and where a longer token may begin.
        self.machine, self.open, self.lasts, self.starts = machine, text, lasts, starts
        self.rest = machine.depth(lasts, len(text))

    def __missing__(self, c: str) -> tuple[State, int]:
        step = self[c] = self.machine.step(self, c)
        return step


class Between(dict):
    """Maps of stretches from one gap to the next: nothing is open at either end, so a map is a number."""

    __slots__ = ("machine",)

    def __init__(self, machine: Machine):
        self.machine = machine

    def __missing__(self, stretch: str) -> int:
        state, total = self.machine.read(self.machine.state(""), stretch)
        total += state.rest
        if len(stretch) <= 64:
            self[stretch] = total
        return total


class Machine:
    """The transducer of one model, built as far as texts need it."""

    def __init__(self, compiled: Model):
        if not compiled.byte_fallback:
            raise ValueError("only models that fall back to bytes are covered")
        self.model = compiled
        self.alive = {name[:k] for name in compiled.ids for k in range(1, len(name))}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.states: dict[str, State] = {}
        self.between = Between(self)

    @staticmethod
    def depth(lasts: list[int], at: int) -> int:
        """Number of tokens up to ``at``."""
        n = 0
        while at:
            at -= lasts[at - 1]
            n += 1
        return n

    def fits(self, a: str, b: str) -> bool:
        """Whether two tokens can stand side by side, that is, merges of their text leave them apart."""
        found = self.pairs.get((a, b))
        if found is None:
            found = self.pairs[a, b] = self.model.tokens(a + b) == ([a, b] if a else [b])
        return found

    def grow(self, text: str, lasts: list[int], starts: list[int]) -> tuple[list[int], list[int]]:
        """``lasts`` and ``starts`` of ``text``, given those of the text without its last character."""
        n, ids, last = len(text), self.model.ids, 1
        for k in starts:
            token = text[k:]
            if token in ids and (self.fits(text[k - lasts[k - 1] : k], token) if k else self.fits("", token)):
                last = n - k
                break
        return [*lasts, last], [k for k in (*starts, n - 1) if text[k:] in self.alive]

    def state(self, text: str) -> State:
        found = self.states.get(text)
        if found is None:
            lasts: list[int] = []
            starts: list[int] = []
            for k in range(1, len(text) + 1):
                lasts, starts = self.grow(text[:k], lasts, starts)
            found = self.states[text] = State(self, text, lasts, starts)
        return found

    def forget(self) -> None:
        """Drop all states if they are many."""
        if len(self.states) > MEMORY:
            for s in self.states.values():
                s.clear()
            self.states.clear()
            self.pairs.clear()
        if len(self.between) > 2 * MEMORY:
            self.between.clear()

    def step(self, state: State, c: str) -> tuple[State, int]:
        if c not in self.model.ids:  # its bytes; what was open is settled
            return self.state(""), state.rest + len(c.encode())
        text = state.open + c
        lasts, starts = self.grow(text, state.lasts, state.starts)
        open_ = {*starts, len(text)}
        while len(open_) > 1:  # up to the boundary that all have in common
            at = max(open_)
            open_.remove(at)
            open_.add(at - lasts[at - 1])
        at = open_.pop()
        rest = text[at:]
        after = self.states.get(rest)
        if after is None:
            after = self.states[rest] = State(self, rest, lasts[at:], [k - at for k in starts])
        return after, self.depth(lasts, at)

    def read(self, state: State, text: str) -> tuple[State, int]:
        total = 0
        for c in text:
            state, n = state[c]
            total += n
        return state, total

    def count(self, text: str) -> int:
        """Tokens of a whole normalised text."""
        if self.model.splits:
            return sum(map(self.between.__getitem__, _STRETCH.findall(text)))
        return self.between[text]

    def chunk_map(self, chunk: str) -> tuple[str, int, str | None]:
        """(head, count, state); a chunk without a gap is all head and has no state."""
        gap = _GAP.search(chunk) if self.model.splits else None
        if gap is None:
            return chunk, 0, None
        *inner, last = _STRETCH.findall(chunk, gap.start())
        state, total = self.read(self.state(""), last)
        return chunk[: gap.start()], total + sum(map(self.between.__getitem__, inner)), state.open

    def compose(self, a: tuple[str, int, str | None], b: tuple[str, int, str | None]) -> tuple[str, int, str | None]:
        """First ``a``, then ``b``."""
        if a[2] is None:
            return a[0] + b[0], b[1], b[2]
        state, total = self.read(self.state(a[2]), b[0])
        if b[2] is None:
            return a[0], a[1] + total, state.open
        return a[0], a[1] + total + state.rest + b[1], b[2]

    def closed(self, a: tuple[str, int, str | None]) -> int:
        """Tokens of a text with this map."""
        return self.count(a[0]) + a[1] + (self.state(a[2]).rest if a[2] is not None else 0)


@lru_cache(maxsize=2)
def machine(data: bytes) -> Machine:
    return Machine(model(data))


_MAP = [T.StructField("_head", T.StringType()), T.StructField("_count", T.LongType()), T.StructField("_state", T.StringType())]
_CHUNKS = T.StructType([T.StructField("_row", T.LongType()), T.StructField("_chunk", T.LongType()), *_MAP])


def chunk_maps(rows: DataFrame, data: bytes) -> DataFrame:
    """One row per chunk of ``_text``, beside the other columns of ``rows``, which only the first chunk carries."""
    others = [f for f in rows.schema.fields if f.name not in ("_row", "_text")]
    schema = T.StructType([*_CHUNKS.fields, *(T.StructField(f.name, f.dataType) for f in others)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(data)
        for batch in slices(batches, "_text"):
            out: list[tuple] = []
            owner: list[int | None] = []
            for k, (row, text) in enumerate(zip(batch.column("_row").to_pylist(), batch.column("_text").to_pylist(), strict=True)):
                normal = m.model.normalise(text or "")[0]
                if len(normal) <= CHUNK:
                    out.append((row, 0, "", m.count(normal), ""))
                    owner.append(k)
                    continue
                for n, begin in enumerate(range(0, len(normal), CHUNK)):
                    out.append((row, n, *m.chunk_map(normal[begin : begin + CHUNK])))
                    owner.append(None if n else k)
            m.forget()
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)]
            at = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, *(batch.column(f.name).take(at) for f in others)], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def token_counts(df: DataFrame, model_path: str, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """``df`` without ``text`` and with the number of tokens of each whole text in ``into``.

    Null and empty texts have none.  Rows are told apart by their place, not by an id, so repeated rows stay;
    a column named ``into`` is replaced, and columns of any other name are carried in one struct.
    """
    data = model_bytes(model_path)
    kept = ["given"]
    rows = df.select(F.monotonically_increasing_id().alias("_row"), F.col(f"`{text}`").cast("string").alias("_text"), carried(df, text))
    maps = chunk_maps(rows, data)
    step = ["_chunk", "_head", "_count", "_state"]
    longest = df.agg(F.max(F.char_length(f"`{text}`"))).first()[0] or 0
    parts = longest // CHUNK + 2
    while True:
        grouped = maps.groupBy("_row", F.floor(F.col("_chunk") / FAN).alias("_chunk")).agg(
            F.sort_array(F.collect_list(F.struct(*step))).alias("_maps"), *(F.first(c, ignorenulls=True).alias(c) for c in kept)
        )
        maps = _composed(grouped, data, kept, parts <= FAN, into)
        if parts <= FAN:
            return maps.select(*(F.col(f"given.`{c}`") for c in df.columns if c not in (text, into)), into)
        parts = -(-parts // FAN)


def _composed(grouped: DataFrame, data: bytes, kept: list[str], last: bool, into: str) -> DataFrame:
    """Maps of a group in one; the number of tokens where ``last``."""
    others = [grouped.schema[c] for c in kept]
    new = [T.StructField(into, T.LongType(), False)] if last else _CHUNKS.fields
    schema = T.StructType([*others, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(data)
        for batch in batches:
            out = []
            for maps in batch.column("_maps").to_pylist():
                whole = ("", 0, None)
                for x in maps:
                    whole = m.compose(whole, (x["_head"], x["_count"], x["_state"]))
                out.append(whole)
            m.forget()
            if last:
                columns = [pa.array([m.closed(x) for x in out], pa.int64())]
            else:
                columns = [batch.column("_row"), batch.column("_chunk"), *(pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], names=schema.fieldNames())

    return grouped.mapInArrow(run, schema)
