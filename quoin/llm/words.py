"""Words and their 64-bit hashes over the bytes of whole batches.

Word classes are byte classes in which every byte from 0x80 is a word byte, so that bytes of UTF-8 text can be
handled without decoding.  Only A-Z is lower-cased.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from quoin.llm.common import PIECE

_BYTE = np.arange(256)
LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
#: ``[^\x20\x09-\x0D]``
PRINTED = ~((_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13)))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` once A-Z is lower-cased
LETTERS = ((_BYTE >= 48) & (_BYTE <= 57)) | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)

# Any odd multipliers; fixed, so that hashes agree between tasks.  The second ones are for a second, independent hash.
_BASES, _SEEDS = (0x9E3779B97F4A7C55, 0xC2B2AE3D27D4EB4F), (0xD1342543DE82EF95, 0xA0761D6478BD642F)


@lru_cache(maxsize=2)
def _codes(which: int = 0) -> np.ndarray:
    """A random 64-bit code for each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_SEEDS[which]))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(n: int, inverse: bool, which: int = 0) -> np.ndarray:
    base = pow(_BASES[which], -1, 1 << 64) if inverse else _BASES[which]
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _room(n: int) -> int:
    return 1 << max(16, int(n).bit_length())


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit polynomial hash of each ``data[start:end]``; equal bytes give equal values anywhere.

    ``which`` is 0 or 1: two hashes of different bases, for 128 bits together.
    """
    size = _room(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_codes(which)[data] * _powers(size, False, which)[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers(size, True, which)[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """Words of all rows of a batch, in order: byte spans, hashes, and the first word of each row (rows + 1)."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    firsts: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, hashed: bool = True) -> Words:
    """The words of each row; works through the bytes in pieces that end between words."""
    lower, starts, ends, hashes, begin = LOWER[data], [], [], [], 0
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    while begin < len(data):
        end = min(len(data), begin + PIECE)
        if end < len(data):  # back to a byte between words; a word longer than a piece is taken whole
            gaps = np.flatnonzero(~kind[lower[begin:end]])
            if len(gaps):
                end = begin + int(gaps[-1]) + 1
            else:
                rest = np.flatnonzero(~kind[lower[end:]])
                end = end + int(rest[0]) if len(rest) else len(data)
        piece = lower[begin:end]
        inside = kind[piece]
        cut = edges[np.searchsorted(edges, begin, "right") : np.searchsorted(edges, end)] - begin
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        before[cut] = False
        after = np.empty_like(inside)
        after[-1], after[:-1] = False, inside[1:]
        after[cut - 1] = False
        s, e = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        if hashed:
            hashes.append(span_hashes(piece, s, e))
        starts.append(s + begin)
        ends.append(e + begin)
        begin = end
    join = lambda parts, t: np.concatenate(parts) if parts else np.empty(0, t)
    s = join(starts, np.int64)
    return Words(s, join(ends, np.int64), join(hashes, np.uint64), np.searchsorted(s, offsets))


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Order-dependent hash of every ``width`` consecutive words (``len - width + 1`` of them)."""
    n = max(0, len(hashes) - width + 1)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + hashes[k : k + n])
    return out
