"""Language identification against vectors bound and bundled letter by letter, in plain code."""

import math
from collections import Counter

import numpy as np

from quoin.llm import languages as la
from quoin.llm.model_queries import op5_language_id
from quoin.llm.words import mix
from tests.llm.cases import odd_documents
from tests.llm.test_models import FOLDER, fold


def letter_vector(code, dimensions):
    places = np.arange(dimensions, dtype=np.uint64)
    return ((mix(mix(np.array([code + 1], np.uint64)) + places) >> np.uint64(63)).astype(np.int64)) * 2 - 1


class Plain:
    """Rotate by place, multiply, add; one n-gram at a time."""

    def __init__(self):
        self.letters, self.grams = {}, {}

    def letter(self, code):
        if code not in self.letters:
            self.letters[code] = letter_vector(code, la.DIMENSIONS)
        return self.letters[code]

    def counts(self, text):
        runs, out = [0], Counter()
        for c in text or "":
            code = 0 if not c.isalpha() else ord(c.lower()) if len(c.lower()) == 1 else ord(c)
            if code or runs[-1]:
                runs.append(code)
        if len(runs) == 1:
            return out
        if runs[-1]:
            runs.append(0)
        for k in range(len(runs) - 2):
            out[tuple(runs[k : k + 3])] += 1
        return out

    def vector(self, counts):
        total = np.zeros(la.DIMENSIONS, np.int64)
        for gram, n in counts.items():
            if gram not in self.grams:
                bound = np.ones(la.DIMENSIONS, np.int64)
                for k, code in enumerate(gram):
                    bound = bound * np.roll(self.letter(code), 2 - k)
                self.grams[gram] = bound
            total += n * self.grams[gram]
        return total


def agrees(found, texts, langs, learned_from):
    plain, sums = Plain(), {}
    counts = {k: plain.counts(t) for k, t in texts.items()}
    for k in learned_from:
        if langs.get(k) is not None:
            sums.setdefault(langs[k], Counter()).update(counts[k])
    prototypes = {name: plain.vector(c).astype(float) for name, c in sums.items() if c}
    close = 0
    for k, (lang, score) in found.items():
        v = plain.vector(counts[k]).astype(float)
        norm = np.linalg.norm(v)
        if norm == 0:
            assert (lang, score) == ("und", 0.0)
            continue
        cosines = {name: float(p @ v / norm / np.linalg.norm(p)) for name, p in prototypes.items()}
        best = max(cosines.values())
        assert math.isclose(score, min(1.0, max(0.0, best)), abs_tol=1e-5)
        assert cosines[lang] >= best - 1e-5
        close += 1
    return close


def test_query_equals_plain_vectors(spark):
    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in op5_language_id(spark, FOLDER).collect()}
    texts, langs = {k: r["text"] for k, r in rows.items()}, {k: r["lang"] for k, r in rows.items()}
    assert agrees(found, texts, langs, [k for k in rows if fold(k, 4) != 2]) > 150


def test_a_small_buffer_changes_nothing(monkeypatch):
    monkeypatch.setattr(la, "MEMORY", 64)
    monkeypatch.setattr(la, "STEP", 16)
    grams, plain = la.Grams(), Plain()
    for _, text in odd_documents(5, 25):
        want, got = plain.vector(plain.counts(text)), grams.vector(text)
        assert np.array_equal(got, want) if got is not None else not want.any()


def test_equal_languages_and_awkward_rows(spark, docs_of):
    """Of languages with equal texts the first in alphabetical order counts."""
    documents = odd_documents(5, 25)
    langs = {k: "ba"[k % 2] for k, _ in documents}
    docs = docs_of(documents, lang=langs)
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in la.identify(docs, la.profiles(docs)).collect()}
    assert agrees(found, dict(documents), langs, [k for k, _ in documents]) > 15
    same = docs_of([(1, "river stone"), (2, "river stone"), (3, "river")], lang={1: "zz", 2: "aa"})
    assert {r["lang_pred"] for r in la.identify(same, la.profiles(same)).collect()} == {"aa"}
