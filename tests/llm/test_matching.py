"""Near duplicates, repeated strings, contamination and fingerprints against brute force."""

import hashlib
import random

import pytest

from quoin.llm import suffixes
from quoin.llm.components import components
from quoin.llm.decontaminate import contamination, without_contaminated
from quoin.llm.match_queries import op2_minhash, op7_simhash, op8_suffix_array, op9_decontamination
from quoin.llm.minhash import near_duplicates, shape, without_near_duplicates
from quoin.llm.simhash import compared, fingerprints, within
from quoin.session import Scratch
from tests.llm.cases import letters, odd_documents, printed, prose

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def given(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]


# --- near duplicates


def linked(documents, width, percent):
    """{id: (set size, smallest id reachable)} by comparing every pair."""
    sets, root = {}, {}
    for k, text in documents:
        w = printed(text)
        sets[k] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
        root[k] = k

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


def test_near_duplicates_of_given_documents(spark, given):
    want = linked(given, 3, 85)
    for r in op2_minhash(spark, FOLDER).collect():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (*want[r["doc_id"]], want[r["doc_id"]][1] == r["doc_id"])


def test_a_large_group_around_a_hub(spark, docs_of):
    """Copies that are similar to the original but not to each other, and some that are similar to nothing."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    documents = [(500, " ".join(base))]
    for k in range(120):
        words = list(base)
        for at in rng.sample(range(5, 115), 2 if k % 3 else 9):
            words[at] = f"x{k}_{at}"
        documents.append((k, " ".join(words)))
    want = linked(documents, 3, 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component"]) for r in near_duplicates(docs_of(documents), 3, 85).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) > 10


def test_near_duplicates_on_awkward_rows(spark, docs_of):
    documents = odd_documents()
    docs = docs_of(documents)
    want = linked(documents, 5, 80)
    got = {r["doc_id"]: (r["n_shingles"], r["component"]) for r in near_duplicates(docs).collect()}
    assert got == want
    kept = without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == {k: t for k, t in documents if want[k][1] == k}
    assert near_duplicates(docs.limit(0)).count() == 0


def test_repeated_and_null_ids_stay_apart(spark, docs_of):
    documents = [(1, "one two three four five six"), (1, "one two three four five six"), (None, "one two three four five six"), (None, None), (2, "other words")]
    out = near_duplicates(docs_of(documents)).collect()
    assert len(out) == 5 and sum(r["kept"] for r in out) == 3
    assert without_near_duplicates(docs_of(documents)).count() == 3


def test_shape_keeps_misses_rare():
    from math import comb

    for percent in (50, 80, 85, 95):
        parts, places = shape(percent)
        q, n = 1 - percent / 100, parts * places
        assert sum(comb(n, k) * q**k * (1 - q) ** (n - k) for k in range(2 * parts, n + 1)) <= 1e-5


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(40)]
    star = [(100, k) for k in range(101, 160)]
    ring = [(k, 200 + (k + 1 - 200) % 9) for k in range(200, 209)]
    with Scratch(spark) as scratch:
        links = spark.createDataFrame(chain + star + ring + [(7, 7), (300, 301), (301, 300)], "a long, b long")
        got = {r["node"]: r["root"] for r in components(links, scratch).collect()}
    want = {k: 0 for k in range(1, 41)} | {k: 100 for k in range(101, 160)} | {k: 200 for k in range(201, 209)} | {301: 300}
    assert got == want


# --- repeated strings


def removed(documents, length):
    """{id: (runs, bytes left)} by remembering every string."""
    seen, out = set(), {}
    for k, text in sorted(documents, key=lambda x: x[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            if data[s : s + length] in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(data[s : s + length])
        runs = [i for i in range(len(data)) if gone[i] and (i == 0 or not gone[i - 1])]
        out[k] = (len(runs), bytes(b for b, g in zip(data, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize(("length", "size"), [(100, 1 << 24), (24, 1 << 11), (40, 1 << 12)])
def test_repeats_on_awkward_rows(spark, docs_of, monkeypatch, length, size):
    """Small ranges: groups of equals are cut by range boundaries."""
    monkeypatch.setattr(suffixes, "RANGE", size)
    monkeypatch.setattr(suffixes, "PIECE", 1 << 12)
    documents = odd_documents()
    want = removed(documents, length)
    for r in suffixes.without_repeats(docs_of(documents), length).collect():
        assert (len(r["spans"]), bytes(r["kept"])) == want[r["doc_id"]], r["doc_id"]
        assert r["n_bytes"] - sum(s["last"] - s["first"] for s in r["spans"]) == len(r["kept"])


def test_many_copies_over_many_ranges(spark, docs_of, monkeypatch):
    monkeypatch.setattr(suffixes, "RANGE", 1 << 10)
    rng = random.Random(5)
    line = prose(rng, 40)
    documents = [(k, prose(rng, 12) + line + prose(rng, 9)) for k in range(60)] + [(100 + k, line * 2) for k in range(20)]
    want = removed(documents, 100)
    for r in suffixes.without_repeats(docs_of(documents), 100).collect():
        assert (len(r["spans"]), bytes(r["kept"])) == want[r["doc_id"]]


def test_whole_documents_without_repeats(spark, docs_of):
    text = "é" * 30 + prose(random.Random(1), 60)
    docs = docs_of([(1, text), (2, text), (3, "new " + text[:80] + " end"), (4, None), (5, "")])
    out = suffixes.deduplicated(docs, 100)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[1] == text and 2 not in got and got[4] is None and got[5] == "" and got[3].startswith("new ")
    assert suffixes.without_repeats(docs.limit(0)).count() == 0
    assert suffixes.without_repeats(docs_of([(None, text), (1, text), (1, text)])).where("n_bytes = octet_length(kept)").count() == 1


def test_repeats_of_given_documents(spark, given):
    want = removed(given, 100)
    for r in op8_suffix_array(spark, FOLDER).collect():
        runs, left = want[r["doc_id"]]
        assert (r["n_spans"], r["n_bytes"] - r["n_removed"], r["kept_sha256"]) == (runs, len(left), hashlib.sha256(left).hexdigest())


# --- contamination


def contaminated(documents, items, window):
    windows = {}
    for name, text in items:
        w = letters(text)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + window]), set()).add(None if name is None else str(name))
    out = {}
    for k, text in documents:
        w, hit, names = letters(text), set(), set()
        for size in {len(x) for x in windows}:
            for s in range(len(w) - size + 1):
                found = windows.get(tuple(w[s : s + size]))
                if found:
                    hit.update(range(s, s + size))
                    names |= found - {None}
        out[k] = (len(w), len(hit), sorted(names))
    return out


def test_contamination_of_given_documents(spark, given):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    want = contaminated(given, items, 10)
    assert any(n for _, n, _ in want.values())
    for r in op9_decontamination(spark, FOLDER).collect():
        words, hit, names = want[r["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (words, hit, len(names), hit > 0)
        assert r["items_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()


def test_contamination_on_awkward_rows(spark, docs_of):
    documents = odd_documents()
    items = [(1, documents[10][1]), (2, "be be be"), (3, None), (4, " !? "), (None, documents[12][1]), (5, documents[10][1]), (5, documents[10][1]), (6, "日本語のテキスト")]
    table = spark.createDataFrame([(a, b, 3) for a, b in items], "item_id int, text string, doc_id int")
    want = contaminated(documents, items, 10)
    docs = docs_of(documents)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in contamination(docs, table).collect()}
    assert got == want
    clean = without_contaminated(docs, table)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {k for k, (_, n, _) in want.items() if not n}
    assert contamination(docs, table.limit(0)).where("n_hit > 0").count() == 0
    assert contamination(docs.limit(0), table).count() == 0
    assert contamination(docs_of([(1, "be be be"), (1, "be be be"), (None, None)]), table).where("n_hit = 3").count() == 2


# --- fingerprints


def test_edited_texts_and_likeness(spark, given):
    rows = {r["doc_id"]: r for r in op7_simhash(spark, FOLDER).collect()}
    ordered = sorted(given)
    bits = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    for (k, text), (after, next_text) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        text, half = text or "", len(text or "") // 2
        edited = text[: len(text) - half] + (next_text or "")[:half]
        r = rows[k]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == 1 - bits(r["fingerprint"], r["edited_fingerprint"]) / 64
        assert r["near_next"] == 1 - bits(r["fingerprint"], rows[after]["fingerprint"]) / 64
        near = sum(bits(r["fingerprint"], x["fingerprint"]) <= 3 for x in rows.values())
        assert r["n_near"] == (near if k % 20 == 0 else None)
    assert sum(r["near_edited"] for r in rows.values()) / len(rows) > 0.6


def test_fingerprints_on_awkward_rows(spark, docs_of, monkeypatch):
    from quoin.llm import simhash

    monkeypatch.setattr(simhash, "STRETCH", 1 << 10)  # many stretches
    documents = [*odd_documents(), (3, "Word"), (None, "no id"), (None, None)]
    out = compared(docs_of(documents)).collect()
    ordered = sorted(documents, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    assert len(out) == len(documents)
    want = []
    for (k, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        text, half = text or "", len(text or "") // 2
        want.append((k is not None, k or 0, len(text), hashlib.sha256((text[: len(text) - half] + (after or "")[:half]).encode()).hexdigest()))
    assert sorted(want) == sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_chars"], r["edited_sha256"]) for r in out)
    assert compared(docs_of(documents).limit(0)).count() == 0
    one = compared(docs_of([(5, "a single text")])).collect()
    assert one[0]["fp"] == one[0]["next_fp"]


def test_fingerprints_are_weighted_votes(spark):
    from pyspark.sql import functions as F

    text = "one two two three elephantine one two"
    words = text.split()
    pairs = [*zip(words, words[1:], strict=False), (words[-1], None)]
    hashes = spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()
    votes = [0] * 64
    for r in hashes:
        weight = min(12, len(r["a"])) + min(12, len(r["b"] or ""))
        for k in range(64):
            votes[k] += weight if r["h"] >> k & 1 else -weight
    want = sum(1 << k for k in range(64) if votes[k] > 0)
    got = fingerprints(spark.createDataFrame([(1, text)], "k int, text string"), ["k"]).collect()[0]["fp"]
    assert got % (1 << 64) == want


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4])
def test_search_finds_all_within_the_radius(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(12)]
    values = base + [b ^ sum(1 << k for k in rng.sample(range(64), n)) for b in base for n in (1, 2, 3, 4, 5)]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    table = spark.createDataFrame([(v,) for v in signed + [None, signed[0]]], "fp long")
    got = {(r["fp"], r["other"], r["distance"]) for r in within(table.limit(12), table, radius).collect()}
    want = {(a, b, bin((a ^ b) % (1 << 64)).count("1")) for a in signed[:12] for b in signed if bin((a ^ b) % (1 << 64)).count("1") <= radius}
    assert got == want
