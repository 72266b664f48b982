"""Language identification by hyperdimensional profiles.

Every letter has a random vector of signs.  The vector of an n-gram binds (multiplies) the vectors of its
letters, each permuted (rotated) by its place; a text's vector bundles (adds) those of its n-grams, and so does
a language's prototype.  A text gets the language of the prototype with the largest cosine.

Binding spreads over sums, so a vector is the n-gram counts times the matrix of n-gram vectors.  Learning
therefore counts n-grams per language in one pass and bundles the sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoin.llm.common import slices
from quoin.llm.words import mix

#: Dimensions of the vectors, and letters of an n-gram.
DIMENSIONS, GRAM = 1024, 3
#: N-gram vectors that a worker keeps before it begins anew; bounds its memory.
MEMORY = 30_000
#: N-grams bundled at a time; bounds the working memory.
STEP = 1024
UNDETERMINED = "und"
#: Standard errors by which a text gets the benefit of the doubt.
ERRORS = 2
_BITS = 21  # of a code point


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case code point of every letter, 0 for all other characters."""
    out = np.zeros(0x110000, np.uint32)
    for k in range(0x110000):
        c = chr(k)
        if c.isalpha():
            low = c.lower()
            out[k] = ord(low) if len(low) == 1 else k
    return out


class Grams:
    """N-grams of texts and their vectors."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.letters = _letters()
        self.at: dict[int, int] = {}
        self.vectors = np.empty((MEMORY, dimensions), np.int8)  # filled as n-grams come

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams of letters and gaps that hold a letter, and how often each occurs."""
        points = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
        padded = np.zeros(len(points) + 2, np.uint64)
        padded[1:-1] = self.letters[points]
        if not padded.any():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        stay = np.ones(len(padded), bool)  # a run of other characters is one gap
        stay[1:] = (padded[1:] > 0) | (padded[:-1] > 0)
        padded = padded[stay]
        code = np.zeros(max(0, len(padded) - GRAM + 1), np.uint64)
        for k in range(GRAM):
            code = code << np.uint64(_BITS) | padded[k : k + len(code)]
        grams, n = np.unique(code.view(np.int64), return_counts=True)
        return grams, n

    def of(self, grams: np.ndarray) -> np.ndarray:
        """One row of signs for each of at most ``MEMORY`` n-grams."""
        at = self.at
        rows = [at.get(g, -1) for g in grams.tolist()]
        if -1 in rows:
            new = [g for g, r in zip(grams.tolist(), rows, strict=True) if r < 0]
            if len(at) + len(new) > MEMORY:
                at.clear()
                new = grams.tolist()
            self.vectors[len(at) : len(at) + len(new)] = self._bound(np.array(new, np.int64))
            at.update(zip(new, range(len(at), len(at) + len(new)), strict=True))
            rows = [at[g] for g in grams.tolist()]
        return self.vectors[rows]

    def _bound(self, grams: np.ndarray) -> np.ndarray:
        out = np.ones((len(grams), self.dimensions), np.int8)
        places = np.arange(self.dimensions, dtype=np.uint64)
        for k in range(GRAM):
            letter = (grams >> (_BITS * (GRAM - 1 - k))) & ((1 << _BITS) - 1)
            distinct, which = np.unique(letter, return_inverse=True)
            signs = mix(mix(distinct.astype(np.uint64) + np.uint64(1))[:, None] + places) >> np.uint64(63)
            out *= np.roll(signs.astype(np.int8) * np.int8(2) - np.int8(1), GRAM - 1 - k, 1)[which]
        return out

    def vector(self, text: str | None) -> np.ndarray | None:
        return self.bundled(*self.counts(text))

    def bundled(self, grams: np.ndarray, n: np.ndarray) -> np.ndarray | None:
        if not len(grams):
            return None
        return sum((n[a : a + STEP].astype(np.float32) @ self.of(grams[a : a + STEP]).astype(np.float32) for a in range(0, len(grams), STEP)), np.float32(0))


def profiles(labelled: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(``lang``, ``profile``, ``mean``, ``spread``): the unit prototype of every language with at least one letter.

    ``mean`` and ``spread`` are the mean and standard deviation, over the n-grams of the language's own texts, of
    what one n-gram adds to the product of a text's counts with the exact prototype.
    """
    counted = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(1)
        sums: dict[str, dict[int, int]] = {}
        size = 0
        for batch in slices(batches, "text"):
            parts: dict[str, list] = {}
            for name, value in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                parts.setdefault(name, []).append(grams.counts(value))
            for name, some in parts.items():
                gram, which = np.unique(np.concatenate([g for g, _ in some]), return_inverse=True)
                n = np.bincount(which, np.concatenate([c for _, c in some]), len(gram)).astype(np.int64)
                own = sums.setdefault(name, {})
                before = len(own)
                for g, c in zip(gram.tolist(), n.tolist(), strict=True):
                    own[g] = own.get(g, 0) + c
                size += len(own) - before
            if size > 1_000_000:
                yield from _rows(sums)
                sums, size = {}, 0
        yield from _rows(sums)

    def _rows(sums: dict[str, dict[int, int]]) -> Iterator[pa.RecordBatch]:
        for name, own in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(own), pa.string()), pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())], names=counted.fieldNames()
            )

    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    sums = rows.mapInArrow(count, counted).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    bundled = T.StructType([T.StructField("lang", T.StringType()), T.StructField("vector", T.ArrayType(T.DoubleType(), False))])

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, totals = Grams(), {}
        for batch in batches:
            name, gram, n = (batch.column(c) for c in counted.fieldNames())
            names = np.array(name.to_pylist(), object)
            for one in set(names.tolist()):
                here = np.flatnonzero(names == one)
                for a in range(0, len(here), 4096):
                    some = here[a : a + 4096]
                    m = n.to_numpy()[some].astype(np.float64)
                    totals[one] = totals.get(one, 0) + np.concatenate([m @ grams.of(gram.to_numpy()[some]), [m.sum(), (m**2).sum(), (m**3).sum()]])
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array([v.tolist() for v in totals.values()], pa.list_(pa.float64()))], names=bundled.fieldNames())

    parts = sums.mapInArrow(bundle, bundled)
    added = parts.select("lang", F.posexplode("vector").alias("place", "x")).groupBy("lang", "place").agg(F.sum("x").alias("x"))
    whole = added.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias("vector"))
    n, squares, cubes = (F.element_at("vector", DIMENSIONS + k) for k in (1, 2, 3))  # sums of the counts' powers follow the vector
    mean = F.sqrt(squares) / n
    spread = F.sqrt(F.greatest(F.lit(0.0), cubes / (n * squares) - mean * mean))
    own = F.slice("vector", 1, DIMENSIONS)
    norm = F.sqrt(F.aggregate(own, F.lit(0.0), lambda a, x: a + x * x))
    whole = whole.withColumn("norm", norm).where("norm > 0")
    return whole.select("lang", F.transform(own, lambda x: x / F.col("norm")).alias("profile"), mean.alias("mean"), spread.alias("spread"))


def identify(df: DataFrame, learned: DataFrame, text: str = "text", likeness: str | None = None, keep_text: bool = False) -> DataFrame:
    """``df`` without ``text`` (unless ``keep_text``), with ``lang_pred`` and ``score``, the cosine cut to 0..1.

    Only the text decides.  Null texts and texts without letters are ``und`` with score 0, as are all texts where
    nothing was learned; ties go to the first language in alphabetical order.  Columns named like the new ones
    are replaced.  One prototype per language reaches the tasks, so their size is bounded by the labels.

    ``likeness`` names a column for the most that the text can be like its language: what its mean n-gram adds to
    the product with the prototype, plus ``ERRORS`` standard errors, as a share of the mean of the language's own
    texts.  Short texts have large errors, so only enough n-grams make it small.  It is null where nothing was
    learned and 0 for texts without letters.
    """
    rows = sorted(learned.collect(), key=lambda r: r["lang"])
    names = [r["lang"] for r in rows]
    matrix = np.array([r["profile"] for r in rows], np.float32)
    own = np.array([(r["mean"], r["spread"]) for r in rows]) if likeness else None

    def one(grams: Grams, value: str | None) -> tuple[str, float, float | None]:
        found, counts = grams.counts(value) if names else (np.empty(0, np.int64),) * 2
        vector = grams.bundled(found, counts)
        norm = 0.0 if vector is None else float(np.linalg.norm(vector))
        if norm == 0:
            return UNDETERMINED, 0.0, 0.0 if names else None
        cosine = matrix @ vector / norm
        best = int(cosine.argmax())
        score = float(min(1.0, max(0.0, cosine[best])))
        if own is None:
            return names[best], score, None
        mean, spread = own[best]
        n = counts.sum()
        # Repeated n-grams are no new evidence: what a text repeats beyond its language counts once.
        share = max(1 / n, float((counts.astype(np.float64) ** 2).sum()) / n**2 - mean**2)
        # The vectors' noise: their products of different n-grams are 0 on average only.
        error = np.sqrt(spread**2 * share + (norm / n) ** 2 / grams.dimensions**2)
        return names[best], score, float((cosine[best] * norm / np.sqrt(grams.dimensions) / n + ERRORS * error) / mean)

    kinds = {"lang": pa.string(), "score": pa.float64(), "like": pa.float64()}

    @F.arrow_udf("struct<lang:string,score:double,like:double>")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        grams = Grams()
        for texts in batches:
            found = []
            for part in slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), "text"):
                found += [one(grams, value) for value in part.column("text").to_pylist()]
            columns = zip(*found, strict=True) if found else ((),) * 3
            yield pa.StructArray.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds.values(), strict=True)], list(kinds))

    # Only the texts travel to Python; not to be worked out again where a filter asks for it.
    found = judge.asNondeterministic()(F.col(f"`{text}`").cast("string"))
    new = {"lang_pred": "lang", "score": "score"} | ({likeness: "like"} if likeness else {})
    kept = [F.col(f"`{c}`") for c in df.columns if c not in new and (c != text or keep_text)]
    both = df.select(F.struct(*kept, *([] if kept else [F.lit(None).alias("none")])).alias("kept"), found.alias("found"))
    return both.select(*(F.col(f"kept.`{c}`") for c in df.columns if c not in new and (c != text or keep_text)), *(F.col(f"found.{field}").alias(name) for name, field in new.items()))


def fold(key: Column, folds: int) -> Column:
    """Fold of an id: the remainder of the CRC-32 of its decimal text."""
    return F.crc32(key.cast("string").cast("binary")) % folds
