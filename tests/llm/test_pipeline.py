"""The corpus pipeline, each stage against a plain version on its own input."""

import sentencepiece

import corpus_pipeline
from tests.llm.cases import letters
from tests.llm.test_matching import linked, removed

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    items = [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + 10]) for w in map(letters, items) for k in range(max(1, len(w) - 9))}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        docs = stage(spark, docs, FOLDER).cache()
        rows = {r["doc_id"]: r for r in docs.collect()}
        if name != "sentence_pieces":
            assert docs.columns == columns
        if name == "language_id":
            assert len(rows) >= 0.98 * len(before)
        elif name == "minhash":
            assert set(rows) == {k for k, (_, c) in linked(before, 5, 80).items() if c == k}
        elif name == "suffix_array":
            want = {k: left.decode(errors="ignore") for k, (_, left) in removed(before, 100).items()}
            assert {k: r["text"] for k, r in rows.items() if r["text"] == want[k]}.keys() | {k for k in rows if len(want[k]) - len(rows[k]["text"]) <= 4} == rows.keys()
            assert {k for k, left in want.items() if left} - rows.keys() == set()
            assert all(r["n_chars"] == len(r["text"]) for r in rows.values())
        elif name == "decontamination":
            dirty = set()
            for k, text in before:
                w = letters(text)
                if any(tuple(w[s : s + n]) in windows for n in {len(x) for x in windows} for s in range(len(w) - n + 1)):
                    dirty.add(k)
            assert set(rows) == {k for k, _ in before} - dirty and dirty
        else:
            library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.public_tokenizers.path("piece_bpe_32k.model"))
            for k, text in before:
                assert rows[k]["ids"] == library.encode(text or "", add_eos=True) and rows[k]["round_trip"]
            assert len(rows) == len(before)


def test_run_is_all_stages(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.count() > 100 and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minhash", "suffix_array", "decontamination", "sentence_pieces"]


def test_awkward_tables(spark, tmp_path):
    """Null and repeated ids, null and empty texts, no documents, no benchmark: every stage of a whole run."""
    prose = [" ".join(f"word{(k * 7 + j * j) % 300} the house of stone" for j in range(40)) for k in range(6)]
    rows = [(1, prose[0]), (1, prose[1]), (None, prose[2]), (None, None), (2, ""), (3, prose[0]), (4, "12 34"), (5, prose[3] + " " + prose[4]), (5, prose[4])]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], schema)
    bench = spark.createDataFrame([("b", prose[3])], "item_id string, text string")
    for name, some, items in (("all", docs, bench), ("nothing to compare with", docs, bench.limit(0)), ("no documents", docs.limit(0), bench)):
        folder = str(tmp_path / name.replace(" ", "_"))
        some.write.parquet(f"{folder}/documents.parquet")
        items.write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, folder).collect()
        assert all(r["round_trip"] for r in out)
        kept = sorted((r["doc_id"] is None, r["doc_id"]) for r in out)
        if name == "all":  # texts without a letter go, one of two copies, what an earlier text holds, and the benchmark's passage
            assert kept == [(False, 1), (False, 1), (True, None)]
        elif name == "no documents":
            assert kept == []
        else:
            assert kept == [(False, 1), (False, 1), (False, 5), (True, None)]
