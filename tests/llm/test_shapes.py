"""Infilling and centroids against plain code, quality on held-out rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from catalog.compare import oracle_connection
from quoin.llm import centroids as ce
from quoin.llm import infill as fim
from quoin.llm import quality as qu
from quoin.llm.model_queries import op11_quality
from quoin.llm.registry import ORACLES
from quoin.llm.shape_queries import op12_fill_in_middle, op13_centroids
from tests.llm.cases import odd_documents

FOLDER = "/root/testdata/sf0.001"
TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def plain_form(key, text, seed=42):
    text = text or ""
    units = TOKEN.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    if h4 % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def agrees(spark, rows, name, folder=FOLDER):
    con = oracle_connection(folder)
    got = con.execute(ORACLES[name])
    columns = [c[0] for c in got.description]
    want = sorted(got.fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in rows) == want and want


awkward = st.text(alphabet=st.sampled_from(list(" \n\t<PSM>aé日🎉\x85")), max_size=40)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(-5, 10**12), awkward), min_size=1, max_size=30))
def test_rearranged_equals_the_plain_form(pairs):
    data = np.frombuffer("".join(t for _, t in pairs).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t.encode()) for _, t in pairs])])
    ends, tokens = fim.token_ends(data, at)
    assert np.diff(tokens).tolist() == [len(TOKEN.findall(t)) for _, t in pairs]
    want = [plain_form(k, t) for k, t in pairs]
    form = np.array([w[1] for w in want], object)
    size = [(len(t[: w[2] or 0].encode()), len(t[: (w[2] or 0) + (w[3] or 0)].encode())) for (_, t), w in zip(pairs, want, strict=True)]
    first, second = at[:-1] + np.array([a for a, _ in size]), at[:-1] + np.array([b for _, b in size])
    block, fim.BLOCK = fim.BLOCK, 7
    try:
        out, out_at = fim.rearranged(data, at, first, second, form)
        back, back_at = fim.put_back(out, out_at, form)
    finally:
        fim.BLOCK = block
    assert [bytes(out[a:b]).decode() for a, b in zip(out_at, out_at[1:], strict=False)] == [w[4] for w in want]
    assert np.array_equal(back, data) and np.array_equal(back_at, at)


def test_infilling_on_awkward_rows(spark, docs_of):
    documents = [*odd_documents(), (None, "no key here at all"), (3, "Word"), (90, "has <M> inside " * 20), (91, " <P"), (92, "x" * 300_000 + " y" * 300_000), (93, "<S> <")]
    docs = docs_of(documents).withColumn("form", F.lit(7)).withColumn("a.b", F.lit(1)).repartition(3)
    made = fim.fill_in_middle(docs)
    got = sorted((r["given"]["doc_id"] is None, r["given"]["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in made.collect())
    assert got == sorted((k is None, k, *plain_form(k, t)) for k, t in documents)
    back = fim.restore(made)
    assert sorted((r["given"]["given"]["doc_id"] is None, r["given"]["given"]["doc_id"], r["restored"]) for r in back.collect()) == sorted((k is None, k, t or "") for k, t in documents)
    assert back.select("given.given.`a.b`", "given.given.form", "given.given.n_words").distinct().count() == 1
    assert fim.restore(fim.fill_in_middle(docs.limit(0))).count() == 0
    everything = fim.fill_in_middle(docs.select("doc_id", "text"), rate=100, spm=0).where("form != 'plain'")
    assert {r["form"] for r in everything.select("form").distinct().collect()} == {"psm"}


def test_outputs_that_were_not_made_raise(spark):
    rows = spark.createDataFrame([(1, "psm", "<P>a<S>b")], "k int, form string, output string")
    with pytest.raises(Exception, match="each mark once"):
        fim.restore(rows).collect()
    none = fim.restore(spark.createDataFrame([(1, None, None)], "k int, form string, output string")).collect()
    assert none[0]["restored"] == ""


def test_infilling_query(spark):
    agrees(spark, op12_fill_in_middle(spark, FOLDER).collect(), "op12_fill_in_middle")


def plain_clusters(pairs, k, rounds, dimensions, scale=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in pairs if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(centroids)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], centroids


def vectors_of(spark, pairs, parts=3):
    return spark.createDataFrame([(i, v, "x") for i, v in pairs], "vec_id bigint, embedding array<double>, cluster string").repartition(parts)


@pytest.mark.parametrize("dimensions", [1, 4, 5])
def test_clusters_equal_plain_ones(spark, monkeypatch, dimensions):
    monkeypatch.setattr(ce, "CHUNK", 16)
    rng = random.Random(dimensions)
    pairs = [(i, [rng.gauss(i % 3, 0.3) for _ in range(dimensions)]) for i in range(120)]
    pairs += [(200 + i, pairs[5][1]) for i in range(60)]  # one vector many times
    pairs += [(5, pairs[5][1]), (5, pairs[6][1]), (None, pairs[7][1]), (300, None), (301, []), (302, [None] * dimensions), (303, [math.nan] * dimensions), (304, [math.inf] * dimensions), (305, [-2.0] * dimensions)]
    rows, centroids = ce.clusters(vectors_of(spark, pairs), k=7, rounds=3, dimensions=dimensions)
    want, ends = plain_clusters(pairs, 7, 3, dimensions)
    order = lambda r: (r[0] is None, *r)
    assert sorted((tuple(r) for r in rows.collect()), key=order) == sorted(want, key=order)
    got = {r["cluster"]: r for r in centroids.collect()}
    assert [got[c]["centroid"] for c in range(len(ends))] == ends
    for c in range(len(ends)):
        assert (got[c]["n"], got[c]["inertia"]) == (sum(w[1] == c for w in want), sum(w[2] for w in want if w[1] == c))


def test_few_vectors_ties_and_none(spark):
    rows, centroids = ce.clusters(vectors_of(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [0.5, 0.5])]), dimensions=2)
    assert {r["cluster"] for r in rows.collect()} == {0} and sorted(r["n"] for r in centroids.collect()) == [0, 0, 3]
    rows, centroids = ce.clusters(vectors_of(spark, [(1, [1.0])]), dimensions=2)
    assert rows.count() == 0 and centroids.count() == 0
    with pytest.raises(Exception, match="exceeds"):
        ce.clusters(vectors_of(spark, [(1, [1e30, 0.0])]), dimensions=2)


def test_centroids_query(spark):
    agrees(spark, op13_centroids(spark, FOLDER).collect(), "op13_centroids")


def test_quality_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in op11_quality(spark, folder).collect()}
    assert set(rows) == {r["doc_id"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for k, r in rows.items())
    labels = [(r["quality"], rows[r["doc_id"]]) for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r["doc_id"] in rows and r["quality"] is not None]
    held = [(q, r) for q, r in labels if r["held_out"]]
    good, bad = [r for q, r in held if q == 1], [r for q, r in held if q == 0]
    assert sum(r["predicted"] for r in good) >= 0.97 * len(good)
    assert sum(1 - r["predicted"] for r in bad) >= 0.9 * len(bad)
    order = sorted(held, key=lambda x: x[1]["score"])
    ranks = sum(k for k, (q, _) in enumerate(order) if q == 1)
    assert (ranks - len(good) * (len(good) - 1) / 2) / (len(good) * len(bad)) > 0.98
    for low, high in ((0.0, 0.3), (0.3, 0.9), (0.9, 1.01)):  # calibrated: as many good ones as the scores say
        some = [(q, r["score"]) for q, r in held if low <= r["score"] < high]
        if len(some) > 30:
            assert abs(sum(q for q, _ in some) - sum(s for _, s in some)) <= 0.15 * len(some)


def test_scores_follow_sizes_written_out(spark, docs_of):
    good, bad = ["the river runs by the old stone house " * 5, "a quiet house of stone by the river " * 4], ["BUY!! NOW!! CHEAP!! " * 9, "CHEAP!! PILLS!! NOW!! " * 8]
    documents = [(k, t) for k, t in enumerate(good + bad)] + [(9, None), (None, ""), (10, "the old stone house"), (10, "PILLS!! NOW!! BUY!!"), (11, "the river " * 9000)]
    docs = docs_of(documents).withColumn("score", F.lit("given")).withColumn("a.b", F.lit(1))
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 0), (3, 0), (3, 0), (None, 1), (9, None), (77, 1)], "doc_id bigint, quality int")
    judge = qu.learn(docs, labels)
    texts = lambda all_, k: b"".join(t.encode() for t in sorted(all_, key=lambda t: judge_order.index(t), reverse=True))
    order = spark.createDataFrame([(k,) for k in range(4)], "id bigint").orderBy(F.xxhash64("id"), "id").collect()
    judge_order = [(good + bad)[r["id"]] for r in order]
    assert judge.good == texts(good, 1) and judge.bad == texts(bad, 0)
    import zstandard

    def size(dictionary, text):
        kind = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        one = zstandard.ZstdCompressor(level=9, dict_data=kind, write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(one.compress(text[a : a + 2048])) for a in range(0, len(text), 2048))

    out = qu.judged(docs, judge)
    assert out.select("given.score", "given.`a.b`").distinct().count() == 1
    scores = {}
    for r in out.join(docs.select(F.col("doc_id").alias("k"), "text"), F.col("given.doc_id").eqNullSafe(F.col("k"))).collect():
        scores.setdefault(r["k"], set()).add(r["score"])
    for k, text in documents:
        data = (text or "").encode()
        rate = (size(judge.bad, data) - size(judge.good, data) + 64 * judge.mean) / (len(data) + 64)
        want = 1 / (1 + math.exp(-(judge.slope * rate + judge.offset)))
        assert any(math.isclose(s, want, rel_tol=1e-9) for s in scores[k])
    assert min(scores[0]) > max(scores[2]) and len(scores[10]) == 2 and scores[9] == scores[None]


def test_curve_is_the_best_one():
    rng = np.random.default_rng(1)
    x = rng.normal(size=400)
    good = rng.random(400) < 1 / (1 + np.exp(-(2 * x + 1)))
    weight = np.where(good, 3.0, 1.0)
    best = qu.curve(x, good, weight)
    ups, downs = weight[good].sum(), weight[~good].sum()
    goal = np.where(good, (ups + 1) / (ups + 2), 1 / (downs + 2))
    loss = lambda a, b: (weight * (np.logaddexp(0, a * x + b) - goal * (a * x + b))).sum()
    for da in (-0.01, 0, 0.01):
        for db in (-0.01, 0, 0.01):
            assert loss(*best) <= loss(best[0] + da, best[1] + db) + 1e-9


def test_nothing_or_one_class_learned(spark, docs_of):
    docs = docs_of([(1, "a"), (2, None)])
    none = qu.learn(docs, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert {r["score"] for r in qu.judged(docs, none).collect()} == {0.5}
    one = qu.learn(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id bigint, quality int"))
    assert {round(r["score"], 9) for r in qu.judged(docs, one).collect()} == {0.75}
    assert qu.judged(docs.limit(0), none).count() == 0
    empty = qu.learn(docs.limit(0), spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int"))
    assert empty.good == b"" and empty.offset == 0
    assert qu.judged(docs.select("text"), none).columns == ["given", "score"] and qu.judged(docs.select("text"), none).count() == 2
