"""Language identification and the language model on held-out rows and against plain counting."""

import math
import zlib
from collections import Counter

import numpy as np

from quoin.llm import language_model as lm
from quoin.llm.languages import Grams, identify, profiles
from quoin.llm.model_queries import op5_language_id, op6_language_model
from tests.llm.cases import odd_documents, printed

FOLDER = "/root/testdata/sf0.001"


def fold(k, n):
    return zlib.crc32(str(k).encode()) % n


def test_languages_of_held_out_documents(spark):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    out = op5_language_id(spark, FOLDER).collect()
    assert {r["doc_id"] for r in out} == set(langs)
    held = [r for r in out if r["held_out"]]
    assert {r["doc_id"] for r in held} == {k for k in langs if fold(k, 4) == 2}
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out)


def test_vectors_bind_and_bundle():
    """The matrix form equals rotating, multiplying and adding letter vectors one by one."""
    grams = Grams(64)
    letter = {c: grams._bound(np.array([ord(c)], np.int64) << 0)[0] for c in "abc"}
    # With one letter in the last place and gaps before, its own vector is bound to two rotated gap vectors.
    gap = grams._bound(np.array([0], np.int64))[0]
    alone = {c: letter[c] * gap * grams._bound(np.array([0], np.int64))[0] for c in letter}
    g = lambda a, b, c: np.array([ord(a) << 42 | ord(b) << 21 | ord(c)], np.int64)
    abc, ab0 = grams._bound(g("a", "b", "c"))[0], grams._bound(g("a", "b", "\0"))[0]
    assert np.array_equal(abc * ab0, alone["c"] * gap)  # only the last letter differs
    want = sum(grams._bound(np.array([x], np.int64))[0] * n for x, n in zip(*grams.counts("abc abc"), strict=True))
    assert np.array_equal(grams.vector("ABC, 12 abc!"), want)


def test_languages_on_awkward_rows(spark, docs_of):
    documents = [*odd_documents(), (None, "12 34 !!"), (3, "Word")]
    docs = docs_of(documents, lang={7: "xx", 5: "aa", 0: "null", 1: "empty"})
    out = identify(docs, profiles(docs)).collect()
    assert len(out) == len(documents)
    by = {r["doc_id"]: r for r in out}
    assert all((by[k]["lang_pred"], by[k]["score"]) == ("und", 0.0) for k in (0, 1, 2, None))
    assert by[5]["lang_pred"] == "aa" and by[7]["lang_pred"] == "xx"
    nothing = identify(docs, profiles(docs.where("lang = 'none'"))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
    assert identify(docs.limit(0), profiles(docs)).count() == 0


def counted(documents, held_out):
    tokens = [[*printed(t), None] for _, t in documents]
    words, pairs = Counter(), Counter()
    for (k, _), w in zip(documents, tokens, strict=True):
        if not held_out(k):
            words.update(w)
            pairs.update(zip([None, *w[:-1]], w, strict=True))
    return tokens, words, pairs


def test_model_of_given_documents(spark):
    documents = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    tokens, words, _ = counted(documents, lambda k: fold(k, 7) == 2)
    n, v = sum(words.values()), len(words)
    rows = {r["doc_id"]: r for r in op6_language_model(spark, FOLDER).collect()}
    for (k, _), w in zip(documents, tokens, strict=True):
        r = rows[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold(k, 7) == 2, len(w), sum(x in words for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((words[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
    held = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_model_is_a_mixture_that_sums_to_one(spark, docs_of, monkeypatch):
    """Blocks of a few tokens, weights from the binned counts: scores equal the mixture written out."""
    monkeypatch.setattr(lm, "BLOCK", 50)
    documents = odd_documents()
    tokens, words, pairs = counted(documents, lambda k: k % 4 == 1)
    n, v = sum(words.values()), len(words)
    caught = {}
    real = lm.mixture
    monkeypatch.setattr(lm, "mixture", lambda cells: caught.setdefault("weights", real(cells)))
    from pyspark.sql import functions as F

    rows = {r["doc_id"]: r for r in lm.scored(docs_of(documents).repartition(3), F.col("doc_id") % 4 == 1).collect()}
    weights = caught["weights"]
    assert np.allclose(weights.sum(1), 1)

    def probability(a, w):
        bucket = min(lm.BUCKETS - 1, math.frexp(words[a])[1]) if words[a] else 0
        x = weights[bucket]
        return x[0] / (v + 1) + x[1] * words[w] / n + (x[2] * pairs[a, w] / words[a] if words[a] else 0)

    for (k, _), w in zip(documents, tokens, strict=True):
        want = sum(math.log10(probability(a, b)) for a, b in zip([None, *w[:-1]], w, strict=True))
        assert math.isclose(rows[k]["score"], want, rel_tol=1e-9)
    for a in (None, "the", "be", "never-seen"):  # over all words and one unknown
        assert math.isclose(sum(probability(a, w) for w in words) + probability(a, "never-seen"), 1, rel_tol=1e-9)


def test_weights_maximise_the_held_out_likelihood():
    ratio = lambda x: int(round(math.log2(x) * lm.BINS)) + 512
    cells = {(5 << 20) | (ratio(64) << 10) | ratio(2): 30, (5 << 20) | (0 << 10) | ratio(2): 50, (5 << 20): 20}
    best = lm.mixture(cells)[5]
    like = lambda w: 30 * math.log(w[0] + 2 * w[1] + 64 * w[2]) + 50 * math.log(w[0] + 2 * w[1]) + 20 * math.log(w[0])
    for a in range(1, 20):
        for b in range(1, 20 - a):
            assert like(best) >= like((a / 20, b / 20, (20 - a - b) / 20)) - 1e-6


def test_model_on_awkward_tables(spark, docs_of):
    from pyspark.sql import functions as F

    rows = lm.scored(docs_of([(1, None), (1, None), (None, "a b"), (2, "")]), F.lit(None).cast("boolean")).collect()
    assert len(rows) == 4 and {r["n_tokens"] for r in rows} == {1, 3}
    unlearned = lm.scored(docs_of([(1, "a b")]), F.lit(True)).collect()[0]
    assert (unlearned["n_known"], unlearned["train_tokens"], unlearned["score"]) == (0, 0, 0.0)
    assert lm.scored(docs_of([]), F.lit(True)).count() == 0
