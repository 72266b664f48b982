"""Given columns of any name: dots, names that the operators use, and none besides the text."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quoin.llm.languages import identify, profiles
from quoin.llm.license_forms import forms
from quoin.llm.licenses import inherited, scan
from quoin.llm.sentence_pieces import decode, encode
from quoin.llm.token_counts import token_counts
from quoin.llm.url_queries import TEMPLATES

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a.b", "_text", "_whole", "_dir", "_file", "_parts", "_near", "_row", "given", "license.x", "none"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "src/LICENSE", "Released under the MIT License."), (2, "src/x.txt", "nothing here"), (3, None, None), (3, "src/x.txt", "nothing here")]
    df = spark.createDataFrame(rows, "doc_id bigint, path string, text string")
    return df.withColumns({name: F.concat(F.lit(f"{name} "), F.col("doc_id").cast("string")) for name in ODD})


OPERATORS = {
    "scan": lambda d: scan(d, forms(TEMPLATES)),
    "inherited": lambda d: inherited(scan(d, forms(TEMPLATES))),
    "identify": lambda d: identify(d, profiles(d.withColumn("lang", F.lit("en")))),
    "encode": lambda d: encode(d, PATH),
    "decode": lambda d: decode(encode(d, PATH), PATH),
    "token_counts": lambda d: token_counts(d, PATH),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_columns_come_back_as_given(docs, name):
    out = OPERATORS[name](docs)
    want = sorted((r["doc_id"], *(r[c] for c in ODD)) for r in docs.collect())
    assert sorted((r["doc_id"], *(r[c] for c in ODD)) for r in out.select("doc_id", *(F.col(f"`{c}`") for c in ODD)).collect()) == want
    assert OPERATORS[name](docs.limit(0)).count() == 0


def test_licences_with_odd_columns(docs):
    got = {(r["doc_id"], r["license"], r["origin"]) for r in inherited(scan(docs, forms(TEMPLATES))).collect()}
    assert got == {(1, "MIT", "src/LICENSE"), (2, "MIT", "src/LICENSE"), (3, "MIT", "src/LICENSE"), (3, None, None)}
