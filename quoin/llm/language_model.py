"""A bigram language model by deleted interpolation.

The probability of a word after another mixes three maximum-likelihood estimates: of the pair, of the word, and
the same for all words.  The weights depend on how frequent the first word is (buckets of powers of two).  They
are learned by expectation-maximisation on held-out counts: every training token is taken out of the counts in
turn, and the weights are those under which the counts of all others give the tokens taken out the largest
probability.

Neither texts nor tables of counts travel whole.  Documents are taken in blocks; a block asks for the counts of
its distinct words, then of its distinct pairs, in packed sorted lists, one for each range of hashes, and gets the
counts back in the same order.  So what moves grows with the distinct pairs of the blocks, no range sees more
than one entry per block for even the most frequent pair, and only sums of fixed size reach the driver.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import RDD, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoin.llm.common import flat, slices
from quoin.llm.words import PRINTED, mix, words

#: Tokens of a block; bounds what a task holds.
BLOCK = 700_000
#: Text bytes for each range of hashes.
RANGE = 1 << 24
#: Context-frequency buckets; bins of a probability ratio per octave; rounds of the weights' learning.
BUCKETS, BINS, ROUNDS = 40, 4, 60
_END = np.uint64(0x6A09E667F3BCC908)  # hash of the end token
_ZERO = -1  # bin of the ratio 0


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays with their bytes in planes, compressed; sorted ones are best given as differences."""
    planes = [(a.dtype.str, len(a), a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()) for a in map(np.ascontiguousarray, arrays)]
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(planes, 5))


def _unpack(data: bytes) -> list[np.ndarray]:
    planes = pickle.loads(zstandard.ZstdDecompressor().decompress(data))
    return [np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(-1, n).T).view(kind).ravel() if n else np.empty(0, kind) for kind, n, raw in planes]


def _steps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


def _split(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range begins among sorted hashes (ranges + 1)."""
    edges = np.array([(k << 64) // ranges for k in range(ranges)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def _requests(kind: str, block: int, keys: np.ndarray, counts: np.ndarray, ranges: int) -> Iterator[tuple]:
    at = _split(keys, ranges)
    for r in range(ranges):
        if at[r + 1] > at[r]:
            part = slice(at[r], at[r + 1])
            yield r, (kind, block, r, _pack(_steps(keys[part]), counts[part].astype(np.uint32)))


def _counted(rows: Iterable[tuple], kind: str) -> Iterator[tuple[list, np.ndarray, list[np.ndarray]]]:
    """The requests of each range, the range's total counts, and each request's."""
    ranges = defaultdict(list)
    for _, row in rows:
        if row[0] == kind:
            ranges[row[2]].append(row)
    for some in ranges.values():
        lists = [_unpack(row[3]) for row in some]
        keys = np.concatenate([np.cumsum(steps, dtype=np.uint64) for steps, _ in lists])
        _, which = np.unique(keys, return_inverse=True)
        totals = np.bincount(which, np.concatenate([n for _, n in lists])).astype(np.int64)
        ends = np.cumsum([len(n) for _, n in lists])[:-1]
        yield some, totals, np.split(totals[which], ends)


def _answers(rows: Iterable[tuple], kind: str, ranges: int) -> Iterator[tuple]:
    for some, _, own in _counted(rows, kind):
        for row, totals in zip(some, own, strict=True):
            yield row[1] % ranges, (f"{kind} counts", row[1], row[2], _pack(totals.astype(np.uint32 if totals.max(initial=0) < 1 << 32 else np.uint64)))


def _sizes(rows: Iterable[tuple]) -> Iterator[tuple[int, int]]:
    for _, totals, _ in _counted(rows, "word"):
        yield int(totals.sum()), int((totals > 0).sum())


def _blocks(ranges: int, kept: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (``target``, ``kind``, ``block``, ``range``, ``payload``): each block's tokens and its requests for words."""
    part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

    def finished() -> Iterator[pa.RecordBatch]:
        block = part * 100_003 + number
        hashes, first = np.concatenate([h for h, _, _ in held]), np.concatenate([n for _, n, _ in held])
        rows = pa.Table.from_batches([r for _, _, r in held])
        train = ~np.asarray(rows.column("_held_out").combine_chunks().to_numpy(zero_copy_only=False), bool)
        keys, which = np.unique(hashes, return_inverse=True)
        counts = np.bincount(which, np.repeat(train, first), len(keys))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_table(rows)
        tokens = pickle.dumps((_pack(which.astype(np.uint32), first, train), zstandard.compress(sink.getvalue().to_pybytes()), _pack(_steps(keys))), 5)
        found = [(block % ranges, ("tokens", block, 0, tokens)), *_requests("word", block, keys, counts, ranges)]
        columns = [[t for t, _ in found], *([row[k] for _, row in found] for k in range(4))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=_PACKED.fieldNames())

    for batch in slices(batches, "_text"):
        found = words(*flat(batch.column("_text")), PRINTED)
        n = np.diff(found.firsts)
        hashes = np.insert(found.hashes, found.firsts[1:], _END)
        held.append((hashes, n + 1, batch.select([*kept, "_held_out"])))
        size += len(hashes)
        if size >= BLOCK:
            yield from finished()
            number, held, size = number + 1, [], 0
    if held:
        yield from finished()


_PACKED = T.StructType(
    [T.StructField("target", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("block", T.LongType()), T.StructField("range", T.LongType()), T.StructField("payload", T.BinaryType())]
)


@dataclass
class _Block:
    """A block's documents and its tokens' distinct words, with what has come back for it."""

    rows: pa.Table
    which: np.ndarray
    first: np.ndarray
    train: np.ndarray
    keys: np.ndarray
    word: np.ndarray | None = None
    pair: np.ndarray | None = None

    def __post_init__(self) -> None:
        ends = np.cumsum(self.first)
        begins = np.zeros(len(self.which), bool)
        begins[ends - self.first] = True
        end = np.searchsorted(self.keys, _END)
        self.before = np.where(begins, np.int32(end), np.roll(self.which, 1))  # the word before; the end token before the first

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes of the distinct pairs, and each token's."""
        hashes = self.keys[self.before] * np.uint64(0x9FB21C651E98DF25)
        hashes += mix(self.keys)[self.which]
        keys, which = np.unique(mix(hashes), return_inverse=True)
        return keys, which.astype(np.int32)


def _opened(rows: Iterable[tuple]) -> Iterator[tuple[int, _Block]]:
    """Blocks of a partition with the counts that have come back."""
    parts: dict[int, dict[str, list]] = defaultdict(lambda: defaultdict(list))
    for _, (kind, block, r, payload) in rows:
        if kind in ("tokens", "word counts", "pair counts"):
            parts[block][kind].append((r, payload))
    for block in sorted(parts):
        own = parts.pop(block)
        tokens, rows_, keys = pickle.loads(own["tokens"][0][1])
        (which, first, train), (steps,) = _unpack(tokens), _unpack(keys)
        with pa.ipc.open_stream(zstandard.decompress(rows_)) as stream:
            table = stream.read_all()
        counts = {k: np.concatenate([_unpack(p)[0].astype(np.int64) for _, p in sorted(own[k])]) for k in ("word counts", "pair counts") if own[k]}
        yield block, _Block(table, which.astype(np.int32), first, train.astype(bool), np.cumsum(steps, dtype=np.uint64), counts.get("word counts"), counts.get("pair counts"))


def _pair_requests(ranges: int, rows: Iterable[tuple]) -> Iterator[tuple]:
    for block, b in _opened(rows):
        keys, which = b.pairs()
        yield from _requests("pair", block, keys, np.bincount(which, np.repeat(b.train, b.first), len(keys)), ranges)


def _estimates(b: _Block, n: int, v: int, less: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, and the estimates of pair and word over the uniform one, for each token with ``less`` taken from all counts."""
    context, word, pair = b.word[b.before] - less, b.word[b.which] - less, b.pair[b.pairs()[1]] - less
    bucket = np.where(context > 0, np.frexp(np.maximum(context, 1).astype(float))[1], 0)
    ratio2 = np.where(context > 0, pair / np.maximum(context, 1), 0.0) * (v + 1)
    return np.minimum(bucket, BUCKETS - 1), ratio2, word / max(1, n - less) * (v + 1)


def _histogram(n: int, v: int, rows: Iterable[tuple]) -> Iterator[dict[int, int]]:
    """Number of training tokens for each bucket and pair of binned ratios, counted without the token itself."""
    total: dict[int, int] = {}
    for _, b in _opened(rows):
        train = np.repeat(b.train, b.first)
        bucket, ratio2, ratio1 = (x[train] for x in _estimates(b, n, v, 1))
        code = bucket.astype(np.int64)
        for ratio in (ratio2, ratio1):
            code = code * 1024 + np.where(ratio > 0, np.round(np.log2(np.maximum(ratio, 1e-30)) * BINS) + 512, _ZERO + 1).astype(np.int64)
        for c, k in zip(*(x.tolist() for x in np.unique(code, return_counts=True)), strict=True):
            total[c] = total.get(c, 0) + k
    yield total


def _added(a: dict[int, int], b: dict[int, int]) -> dict[int, int]:
    for k, n in b.items():
        a[k] = a.get(k, 0) + n
    return a


def mixture(cells: dict[int, int]) -> np.ndarray:
    """Weights (uniform, word, pair) of each bucket by expectation-maximisation over the binned held-out counts."""
    if not cells:  # nothing was learned
        return np.tile([1.0, 0.0, 0.0], (BUCKETS, 1))
    code, n = np.array(list(cells), np.int64), np.array(list(cells.values()), float)
    ratio = lambda x: np.where(x == _ZERO + 1, 0.0, 2.0 ** ((x - 512) / BINS))
    bucket, like = code >> 20, np.stack([np.ones(len(code)), ratio(code & 1023), ratio(code >> 10 & 1023)], 1)
    out = np.full((BUCKETS, 3), 1 / 3)
    out[0] = 0.5, 0.5, 0
    for _ in range(ROUNDS):
        share = out[bucket] * like
        share *= (n / share.sum(1))[:, None]
        new = np.stack([np.bincount(bucket, share[:, k], BUCKETS) for k in range(3)], 1)
        seen = new.sum(1) > 0
        out[seen] = new[seen] / new[seen].sum(1, keepdims=True)
    for k in range(1, BUCKETS):  # a bucket without tokens takes the weights of the one below
        if not (bucket == k).any() and k > 1:
            out[k] = out[k - 1]
    out = np.maximum(out, [1e-9, 1e-9, 0])
    out[0, 2] = 0
    return out / out.sum(1, keepdims=True)


def _scores(n: int, v: int, weights: np.ndarray, kept: list[str], rows: Iterable[tuple]) -> Iterator[tuple]:
    for _, b in _opened(rows):
        bucket, ratio2, ratio1 = _estimates(b, n, v, 0)
        w = weights[bucket]
        model = np.log10((w[:, 0] + w[:, 1] * ratio1 + w[:, 2] * ratio2) / (v + 1))
        word = b.word[b.which]
        base = np.log10((word + 1) / (n + 1 * (v + 1)))
        at = np.cumsum(b.first) - b.first
        sums = [np.add.reduceat(x, at).tolist() for x in (word > 0, base, model)]
        values = [b.rows.column(c).to_pylist() for c in kept]
        yield from zip(*values, (~b.train).tolist(), b.first.tolist(), map(int, sums[0]), [n] * len(at), sums[1], sums[2], strict=True)


def scored(docs: DataFrame, held_out: Column, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` with ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` for every document.

    The model learns from documents where ``held_out`` isn't true.  Tokens are the words and one end; scores are
    log10 probabilities of whole texts, ``base_score`` that of words alone with one added to every count.  Null
    and empty texts are an end alone.  Rows aren't told apart by id, so repeated rows and ids count and come out
    as often as they are there.  With no training document, both scores are uniform.  An empty table gives none.
    """
    kept = list(keep)
    spark = docs.sparkSession
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.coalesce(held_out, F.lit(False)).alias("_held_out"), F.col(f"`{text}`").cast("string").alias("_text"))
    new = [T.StructField("held_out", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")), *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score"))]
    schema = T.StructType([*(rows.schema[c] for c in kept), *new])
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    ranges = max(int(size // RANGE) + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    packed = rows.mapInArrow(partial(_blocks, ranges, kept), _PACKED).rdd
    place = int  # a target is its partition

    def dealt(rdd: RDD) -> RDD:
        return rdd.partitionBy(ranges, place)

    first = dealt(packed.map(lambda r: (r["target"], (r["kind"], r["block"], r["range"], bytes(r["payload"])))))
    n, v = first.mapPartitions(_sizes).fold((0, 0), lambda a, b: (a[0] + b[0], a[1] + b[1]))
    words_back = dealt(first.mapPartitions(partial(_answers, kind="word", ranges=ranges)))
    known = first.union(words_back)
    asked = dealt(known.mapPartitions(partial(_pair_requests, ranges)))
    pairs_back = dealt(asked.mapPartitions(partial(_answers, kind="pair", ranges=ranges)))
    whole = known.union(pairs_back)
    weights = mixture(whole.mapPartitions(partial(_histogram, n, v)).treeReduce(_added) if n else {})
    return spark.createDataFrame(whole.mapPartitions(partial(_scores, n, v, weights, kept)), schema)
