"""Quality of texts by compression.

One zstandard dictionary is made of good texts and one of bad texts.  A text is compressed with each; the
difference of the two sizes, divided by the text's size, says which kind it is more like.  A logistic curve,
fitted on labelled texts that were not in the dictionaries, makes it a probability.

Texts are compressed in short pieces, so that a long text can't become its own dictionary and its difference
doesn't shrink with its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoin.llm.common import carried, slices

#: Labelled rows of each class to learn from (those with the smallest hash of their id), and bytes of the longest.
SAMPLE, LONGEST = 1024, 1 << 14
#: Bytes of a dictionary, compression level, and bytes of a text that are compressed together.
DICTIONARY, LEVEL, PIECE = 1 << 19, 9, 2048
#: Bytes of an average text that every text is thought to have besides its own; steadies short texts.
PRIOR = 64


@dataclass
class Judge:
    """Dictionaries of good and bad texts, mean difference per byte, and the logistic curve (slope, offset)."""

    good: bytes
    bad: bytes
    mean: float
    slope: float
    offset: float

    def score(self, difference: np.ndarray, size: np.ndarray) -> np.ndarray:
        return _logistic(self.slope * steadied(difference, size, self.mean) + self.offset)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def steadied(difference: np.ndarray, size: np.ndarray, mean: float) -> np.ndarray:
    """Difference per byte, drawn to the mean of all texts where a text is short."""
    return (difference + PRIOR * mean) / (size + PRIOR)


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    kind = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(dictionary) >= 8 else None  # the format's least
    if kind is not None:
        kind.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=kind, write_content_size=False, write_checksum=False, write_dict_id=False)


def difference(good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor, text: bytes) -> int:
    """Bytes by which the bad dictionary makes the text longer than the good one does."""
    out = 0
    for begin in range(0, len(text), PIECE):
        piece = text[begin : begin + PIECE]
        out += len(bad.compress(piece)) - len(good.compress(piece))
    return out


def dictionary(texts: list[bytes]) -> bytes:
    """As many whole texts as fit, in their order; the first stand last, where the compressor reaches them best."""
    out, room = [], DICTIONARY
    for text in texts:
        if len(text) <= room:
            out.append(text)
            room -= len(text)
    return b"".join(reversed(out))


def curve(x: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the weighted logistic regression, by Newton steps.

    Goals are drawn in from 0 and 1 by one imagined text of each class, which keeps the slope finite where the
    classes don't overlap.
    """
    ups, downs = weight[good].sum(), weight[~good].sum()
    goal = np.where(good, (ups + 1) / (ups + 2), 1 / (downs + 2))
    scale = max(float(np.abs(x).max()), 1e-9)
    rows = np.stack([x / scale, np.ones(len(x))], 1)
    w = np.array([0.0, np.log((ups + 1) / (downs + 1))])
    loss = lambda w: float((weight * (np.logaddexp(0, rows @ w) - goal * (rows @ w))).sum())
    for _ in range(100):
        p = _logistic(rows @ w)
        slope = rows.T @ (weight * (p - goal))
        bend = (rows * (weight * p * (1 - p))[:, None]).T @ rows + 1e-9 * np.eye(2)
        step, rate = np.linalg.solve(bend, slope), 1.0
        while rate > 1e-6 and loss(w - rate * step) > loss(w):
            rate /= 2
        w = w - rate * step
        if np.abs(rate * step).max() < 1e-10:
            break
    return float(w[0] / scale), float(w[1])


def fitted(texts: list[bytes], good: list[bool], totals: tuple[int, int]) -> Judge:
    """A judge from sampled texts; ``totals``: labelled bad and good rows of the whole corpus, for the calibration.

    Each half of the texts is measured with dictionaries of the other half; the judge has dictionaries of all.
    Where a class has no text, all texts get the same score, the share of good rows (one of each class added).
    """
    marks = np.array(good, bool)
    if not len(texts) or marks.all() or not marks.any():
        bad, ups = totals
        return Judge(b"", b"", 0.0, 0.0, float(np.log((ups + 1) / (bad + 1))))
    half = np.zeros(len(texts), int)
    for kind in (False, True):
        half[marks == kind] = np.arange((marks == kind).sum()) % 2
    of = lambda some: dictionary([texts[k] for k in np.flatnonzero(some)])
    measured = np.zeros(len(texts))
    for k in (0, 1):
        pair = [compressor(of((half == k) & (marks == kind))) for kind in (True, False)]
        for row in np.flatnonzero(half != k):
            measured[row] = difference(*pair, texts[row])
    size = np.array([len(t) for t in texts], float)
    weight = np.where(marks, totals[1] / marks.sum(), totals[0] / (~marks).sum())
    mean = float((weight * measured).sum() / max(1.0, (weight * size).sum()))
    return Judge(of(marks), of(~marks), mean, *curve(steadied(measured, size, mean), marks, weight))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Judge:
    """Learn from texts with label 1 (good) and 0 (bad); other labels and null keys teach nothing.

    The sample has at most ``SAMPLE`` labelled ids a class, of whose texts those up to ``LONGEST`` bytes are taken
    whole (of texts with one id the first in order), so at most 32 MB reach the driver.  Class totals, which set the scores' base rate, count all labels.
    """
    kind = F.col(f"`{label}`")
    rows = labels.where(kind.isin(0, 1) & F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("id"), (kind == 1).alias("good"))
    totals = {r["good"]: r["n"] for r in rows.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
    rank = F.xxhash64("id")
    some = [rows.where(F.col("good") == flag).distinct().orderBy(rank, "id").limit(SAMPLE) for flag in (False, True)]
    whole = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).where(F.octet_length("text") <= LONGEST)
    joined = whole.join(F.broadcast(some[0].unionByName(some[1])), "id").groupBy("id", "good").agg(F.min("text").alias("text"))  # 2 * SAMPLE ids
    found = sorted(joined.withColumn("rank", rank).collect(), key=lambda r: (r["rank"], r["id"], r["good"]))
    return fitted([r["text"].encode() for r in found], [r["good"] for r in found], (totals.get(False, 0), totals.get(True, 0)))


def judged(docs: DataFrame, judge: Judge, text: str = "text") -> DataFrame:
    """``given`` (all columns but the text) and ``score``, the probability that the text is good.

    Null and empty texts get the score of an average text.  Only the text decides; equal texts have equal scores.
    Rows are independent, and columns of any name travel in ``given``.
    """
    rows = docs.select(carried(docs, text), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([rows.schema["given"], T.StructField("score", T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = [compressor(judge.good), compressor(judge.bad)]
        for batch in slices(batches, "text"):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            measured = np.array([difference(*pair, t) for t in texts], float)
            score = judge.score(measured, np.array([len(t) for t in texts], float))
            yield pa.RecordBatch.from_arrays([batch.column("given"), pa.array(score, pa.float64())], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)
