"""A compiled subword model: its vocabulary, character map and merge order, read from the model file's bytes.

Covers merge (BPE) models of normal, control, unknown and byte pieces.  The file reaches executors as bytes
inside the task, so its path only has to exist on the driver.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from functools import cached_property, lru_cache
from pathlib import Path

import numpy as np

MARK = "▁"
# Piece types of the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, number()
            continue
        size = number() if wire == 2 else {1: 8, 5: 4}[wire]
        yield tag >> 3, data[at : at + size]
        at += size


class CharacterMap:
    """Longest-prefix replacement by a compiled double-array trie over UTF-8 bytes."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0]
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and number of bytes replaced for the longest entry that begins at ``at``."""
        units, found = self.units, None
        node = self._next(units[0], 0)
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[k]:
                break
            node = self._next(unit, node)
            if unit >> 8 & 1:
                found = units[node] & 0x7FFFFFFF, k + 1 - at
        if found is None:
            return None
        return self.texts[found[0] : self.texts.index(b"\0", found[0])], found[1]

    @staticmethod
    def _next(unit: int, node: int) -> int:
        return node ^ ((unit >> 10) << ((unit & 0x200) >> 6))


class Model:
    """Vocabulary, normalisation and merges of one model file."""

    def __init__(self, data: bytes):
        self.names: list[str] = []
        self.types: list[int] = []
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids = [-1] * 256
        self.unk = 0
        self.end_id: int | None = None
        names = {45: "<unk>", 47: "</s>"}
        flags = {3: 1, 4: 1, 5: 1}
        blob, trainer = b"", {}
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                self._add(piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                for key, item in _fields(value):
                    if key == 2:
                        blob = item
                    elif key in flags:
                        flags[key] = item
        if trainer.get(3, 1) != 2 or {USER, UNUSED} & set(self.types):
            raise ValueError("only merge models without user-defined or unused pieces are covered")
        if trainer.get(24, 0):
            raise ValueError("white space as a suffix is not covered")
        self.byte_fallback = bool(trainer.get(35, 0))
        end = trainer.get(47, names[47].encode()).decode()
        self.end_id = self.names.index(end) if end in self.names else None
        self.dummy, self.squeeze, self.escape = (bool(flags[k]) for k in (3, 4, 5))
        self.map = CharacterMap(blob) if blob else None
        # No piece continues over the start of a run of marks: what lies before it is encoded on its own.
        self.splits = not any(MARK in name.lstrip(MARK) for name in self.ids)
        self.raw = [self._bytes_of(k) for k in range(len(self.names))]

    def _add(self, name: str, score: float, kind: int) -> None:
        k = len(self.names)
        self.names.append(name)
        self.types.append(kind)
        if kind == NORMAL:
            self.ids[name], self.scores[name] = k, score
        elif kind == BYTE:
            self.byte_ids[int(name[3:5], 16)] = k
        elif kind == UNKNOWN:
            self.unk = k

    def _bytes_of(self, k: int) -> bytes:
        """What decoding yields for a piece."""
        kind = self.types[k]
        if kind == BYTE:
            return bytes([int(self.names[k][3:5], 16)])
        return b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else self.names[k].replace(MARK, " ").encode()

    # --- normalisation

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised characters, and for each (and the end) the byte of the source where it comes from."""
        if self.map is None and not self.squeeze and self.escape:
            if not text:
                return "", np.zeros(1, np.int64)
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            sizes = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
            at = np.concatenate([np.zeros(1 + self.dummy, np.int64), np.cumsum(sizes)])
            return MARK * self.dummy + text.replace(" ", MARK), at
        return self._normalise_slowly(text)

    def _normalise_slowly(self, text: str) -> tuple[str, np.ndarray]:
        data = text.encode()
        out: list[str] = []
        origin: list[int] = []
        at, space = 0, self.squeeze
        chunks = []
        while at < len(data):
            hit = self.map.longest(data, at) if self.map else None
            if hit is None:
                size = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                hit = data[at : at + size], size
            chunks.append((hit[0].decode(errors="replace"), at))
            at += hit[1]
        mark = MARK if self.escape else " "
        if self.squeeze:  # leading spaces go
            while chunks and chunks[0][0] == " ":
                chunks.pop(0)
        if not chunks:
            return "", np.zeros(1, np.int64)
        if self.dummy:
            out.append(mark)
            origin.append(chunks[0][1])
        space = self.squeeze
        for piece, source in chunks:
            if space:
                piece = piece.lstrip(" ")
            for c in piece:
                out.append(mark if c == " " else c)
                origin.append(source)
            if piece:
                space = self.squeeze and piece[-1] == " "
        end = len(data)
        if self.squeeze:
            while len(out) > self.dummy and out[-1] == mark:
                out.pop()
                end = origin.pop()
        if len(out) == self.dummy and self.squeeze:
            return "", np.zeros(1, np.int64)
        return "".join(out), np.array([*origin, end], np.int64)

    # --- merges

    def tokens(self, text: str) -> list[str]:
        """Normalised text cut into merged pieces: the pair of best score first, the leftmost of equals."""
        n = len(text)
        if n == 0:
            return []
        scores = self.scores
        if n <= 64:  # a few list scans in C beat a heap
            parts, never = list(text), float("inf")
            ranks = [-scores.get(a + b, -never) for a, b in zip(parts, parts[1:], strict=False)]
            while ranks and (best := min(ranks)) != never:
                k = ranks.index(best)
                parts[k] += parts.pop(k + 1)
                ranks.pop(k)
                if k:
                    ranks[k - 1] = -scores.get(parts[k - 1] + parts[k], -never)
                if k < len(ranks):
                    ranks[k] = -scores.get(parts[k] + parts[k + 1], -never)
            return parts
        parts: list[str | None] = list(text)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, str]] = []

        def offer(k: int) -> None:
            if k >= 0 and right[k] < n:
                pair = parts[k] + parts[right[k]]
                if pair in scores:
                    heapq.heappush(heap, (-scores[pair], k, pair))

        for k in range(n - 1):
            offer(k)
        while heap:
            _, k, pair = heapq.heappop(heap)
            other = right[k] if parts[k] is not None else n
            if other >= n or parts[k] + parts[other] != pair:
                continue
            parts[k], parts[other] = pair, None
            right[k] = right[other]
            if right[other] < n:
                left[right[other]] = k
            offer(left[k])
            offer(k)
        return [p for p in parts if p is not None]

    def cut(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Many short normalised texts at once: ids and character ends of all tokens, and each text's first token.

        ASCII characters outside the vocabulary take their byte's id, other such characters -1.  One merge for each text and round: the
        matrices hold, for each text, its tokens and the rank of each with the next one.
        """
        sizes = np.array([len(w) for w in words], np.int64)
        width = int(sizes.max())
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        columns = np.arange(width)
        inside = columns < sizes[:, None]
        left = np.full((len(words), width), -1, np.int64)
        left[inside] = self.pairs.characters[points]
        ends = np.cumsum(inside, 1, dtype=np.int16)
        pair = np.full((len(words), width), -1, np.int64)
        pair[:, :-1] = self.pairs.find(left[:, :-1], left[:, 1:])
        rank, never = np.where(pair >= 0, self.pairs.ranks[pair], self.pairs.never), self.pairs.never
        live = np.arange(len(words))
        done = np.full((len(words), width), -2, np.int64), np.zeros((len(words), width), np.int16), sizes.copy()
        tokens = sizes.copy()
        while len(live):
            at = rank.argmin(1)
            rows = np.arange(len(live))
            going = rank[rows, at] < never
            if not going.all():
                stop = live[~going]
                done[0][stop], done[1][stop], done[2][stop] = left[~going], ends[~going], tokens[~going]
                live, left, ends, pair, rank, tokens, at = (x[going] for x in (live, left, ends, pair, rank, tokens, at))
                rows = np.arange(len(live))
                if not len(live):
                    break
            left[rows, at] = self.pairs.merged[pair[rows, at]]
            for x, fill in ((left, -1), (pair, -1), (rank, never)):
                x[:, :-1] = np.where(columns[:-1] > at[:, None], x[:, 1:], x[:, :-1])
                x[:, -1] = fill
            ends[:, :-1] = np.where(columns[:-1] >= at[:, None], ends[:, 1:], ends[:, :-1])
            tokens -= 1
            for k, ok in ((at - 1, at > 0), (at, at < tokens - 1)):
                r, c = rows[ok], k[ok]
                pair[r, c] = found = self.pairs.find(left[r, c], left[r, c + 1])
                rank[r, c] = np.where(found >= 0, self.pairs.ranks[found], never)
            last = rows[at >= tokens - 1]
            pair[last, at[last]], rank[last, at[last]] = -1, never
        keep = columns < done[2][:, None]
        return done[0][keep], done[1][keep].astype(np.int64), np.concatenate([[0], np.cumsum(done[2])])

    @cached_property
    def pairs(self) -> Pairs:
        return Pairs(self)

    def cost(self, token: str) -> int:
        """Ids that a token yields: one, or its bytes where it isn't in the vocabulary."""
        return 1 if token in self.ids or not self.byte_fallback else len(token.encode())


class Pairs:
    """All pairs of pieces that merge, in a table open to numpy look-ups."""

    def __init__(self, m: Model):
        order = {score: k for k, score in enumerate(sorted(set(m.scores.values()), reverse=True))}
        self.never = len(order)
        self.characters = np.full(0x110000, -1, np.int64)
        self.characters[:128] = m.byte_ids[:128]
        keys, ranks, merged = [], [], []
        for name, k in m.ids.items():
            if len(name) == 1:
                self.characters[ord(name)] = k
            for at in range(1, len(name)):
                a, b = m.ids.get(name[:at]), m.ids.get(name[at:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    ranks.append(order[m.scores[name]])
                    merged.append(k)
        self.ranks, self.merged = np.array([*ranks, self.never], np.int32), np.array([*merged, -1], np.int64)
        self.bits = (4 * len(keys)).bit_length()
        self.slots = np.full(1 << self.bits, -1, np.int64)  # index of a pair
        self.keys = np.array([*keys, -1], np.int64)
        open_, slot = np.arange(len(keys)), self._slot(self.keys[:-1])
        while len(open_):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = open_[free]
            lost = self.slots[slot] != open_
            open_, slot = open_[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index of each pair, -1 where it doesn't merge."""
        keys = np.where((a < 0) | (b < 0), -2, a << 32 | b).ravel()
        out = np.full(len(keys), -1, np.int64)
        open_ = np.flatnonzero(keys >= 0)
        slot = self._slot(keys[open_])
        while len(open_):
            got = self.slots[slot]
            hit = self.keys[got] == keys[open_]  # a free slot is -1, whose key is none
            out[open_[hit]] = got[hit]
            more = ~hit & (got >= 0)
            open_, slot = open_[more], (slot[more] + 1) & ((1 << self.bits) - 1)
        return out.reshape(a.shape)


@lru_cache(maxsize=2)
def model(data: bytes) -> Model:
    """One compiled model per worker."""
    return Model(data)


def model_bytes(path: str) -> bytes:
    return Path(path).read_bytes()
