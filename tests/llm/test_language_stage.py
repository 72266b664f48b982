"""The language stage of the pipeline on short, clean and foreign documents."""

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"
ITALIAN = """Il gatto dorme sulla poltrona mentre la pioggia cade piano sui tetti della città e nessuno esce di casa fino al mattino.
Quando finalmente smette, i bambini corrono giù per le scale, aprono il portone e giocano con gli aquiloni vicino alla vecchia chiesa.
Mio zio diceva spesso che bisogna svegliarsi presto, bere qualcosa di caldo, scegliere scarpe robuste e camminare lungo il fiume."""
JAPANESE = "日本語の文章を読むことができる人はこの町には一人もいないと言われている。昨日は雨が降ったので、私たちは家の中で静かに本を読んで過ごしました。"


def test_short_clean_documents_stay_and_foreign_ones_go(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = ["Avec.", "A.", "A.\nAll rights reserved.", "Edrere.", "To To To To To To"]
    gone = [None, "", " 12 + 34 ", JAPANESE, ITALIAN]
    new = [(1_000_000 + k, t, None, "src", 0) for k, t in enumerate([*kept, *gone])]
    more = docs.union(spark.createDataFrame(new, docs.schema))
    left = {r["doc_id"] for r in corpus_pipeline.language_id(spark, more, FOLDER).select("doc_id").collect()}
    assert {k - 1_000_000 for k in left if k >= 1_000_000} == set(range(len(kept)))
    assert {k for k in left if k < 1_000_000} == {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}


def test_all_documents_stay_where_nothing_was_learned(spark, docs_of):
    docs = docs_of([(1, "some words"), (2, None), (3, "42"), (4, "A.")])
    assert {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, FOLDER).collect()} == {1, 2, 3, 4}


def test_given_columns_come_back_as_they_were(spark):
    rows = [(1, "the house and the tree", "en", "mine", -5, "copy", "like"), (2, "a river and a stone", "en", None, 7, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, lang_pred string, score int, _copy string, _likeness string")
    out = corpus_pipeline.language_id(spark, docs, FOLDER)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == rows
