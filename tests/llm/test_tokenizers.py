"""Exact agreement with the tokenizer library, spans, round trips, the transducer's chunks and maps."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quoin.llm import token_counts as tc
from quoin.llm.pieces import CharacterMap, Model, model_bytes
from quoin.llm.sentence_pieces import Encoder, decode, encode
from quoin.llm.token_queries import op1_sentence_pieces, op10_token_counts
from tests.llm.cases import odd_documents

PATH = public_tokenizers.path("piece_bpe_32k.model")
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def compiled():
    return Model(model_bytes(PATH))


texts = st.text(alphabet=st.sampled_from(list(" ▁\n\tabehtiñß日🎉.<s>0\x00é́")), max_size=80)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_encoder_and_transducer_agree_with_the_library(library, compiled, text):
    want = library.encode(text)
    ids, starts, ends, sizes = Encoder(compiled).encode(["x", text, ""])
    assert ids[sizes[0] : sizes[0] + sizes[1]].tolist() == want
    machine = tc.Machine(compiled)
    normal = compiled.normalise(text)[0]
    assert machine.count(normal) == len(want)
    for cut in (1, 3, 7):  # maps of chunks compose to the same, in any grouping
        maps = [machine.chunk_map(normal[k : k + cut]) for k in range(0, len(normal), cut)]
        left = ("", 0, None)
        for m in maps:
            left = machine.compose(left, m)
        right = ("", 0, None)
        for m in reversed(maps):
            right = machine.compose(m, right)
        assert machine.closed(left) == machine.closed(right) == len(want)


@settings(max_examples=100, deadline=None)
@given(texts)
def test_spans_tile_the_source(compiled, text):
    ids, starts, ends, _ = Encoder(compiled).encode([text])
    data = text.encode()
    assert (starts[1:] >= 0).all() and (ends[:-1] == starts[1:]).all() or len(ids) < 2
    if text:
        assert ends[-1] == len(data)
    for k, a, b in zip(ids.tolist(), starts.tolist(), ends.tolist(), strict=True):
        if compiled.types[k] == 1:
            assert data[a:b].decode().replace(" ", "▁") in (compiled.names[k], compiled.names[k][1:])


def test_long_words_and_long_texts(library, compiled):
    for text in ("a" * 5000, "ab" * 3000, " " * 400 + "x", "é" * 900, "word " * 30_000):
        assert Encoder(compiled).encode([text])[0].tolist() == library.encode(text)
        assert tc.Machine(compiled).count(compiled.normalise(text)[0]) == len(library.encode(text))


def test_character_map_takes_the_longest_entry():
    # A hand-made trie with the entries "a" -> "x" and "ab" -> "yz".
    units = [0] * 1024
    link = lambda offset, label, leaf=0: offset << 10 | leaf << 8 | label
    units[0] = link(256, 0)
    at_a = 256 ^ ord("a")
    units[at_a] = link(at_a ^ 512, ord("a"), 1)
    units[512] = 0 | 1 << 31
    at_b = 512 ^ ord("b")
    units[at_b] = link(at_b ^ 768, ord("b"), 1)
    units[768] = 2 | 1 << 31
    blob = np.array([len(units) * 4, *units], "<u4").tobytes() + b"x\0yz\0"
    table = CharacterMap(blob)
    assert table.longest(b"abc", 0) == (b"yz", 2)
    assert table.longest(b"ac", 0) == (b"x", 1)
    assert table.longest(b"c", 0) is None


def test_operators_on_awkward_rows(spark, docs_of, library):
    pairs = [*odd_documents(), (3, "Word"), (None, "twice"), (None, None)]
    docs = docs_of(pairs)
    out = decode(encode(docs, PATH, end=True), PATH).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in out) == sorted((k is None, k or 0, t or "") for k, t in pairs)
    for r in out:
        assert r["ids"] == library.encode(r["text"] or "", add_eos=True)
        assert r["decoded"] == library.decode(r["ids"]) and r["line"] == 1
        assert r["ends"][-1] == len((r["text"] or "").encode())
    assert encode(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("chunk", [5, 1 << 15])
def test_token_counts_on_awkward_rows(spark, docs_of, library, monkeypatch, chunk):
    monkeypatch.setattr(tc, "CHUNK", chunk)
    monkeypatch.setattr(tc, "FAN", 4)
    pairs = [*odd_documents(), (3, "Word"), (None, "twice"), (None, None)]
    out = tc.token_counts(docs_of([(k, t if t is None else t[:600]) for k, t in pairs]), PATH).collect()
    key = lambda k: (k is None, k or 0)
    assert sorted((*key(r["doc_id"]), r["n_tokens"]) for r in out) == sorted((*key(k), len(library.encode((t or "")[:600]))) for k, t in pairs)
    assert tc.token_counts(docs_of(pairs).limit(0), PATH).count() == 0


def test_queries_on_the_whole_table(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    one = {r["doc_id"]: r for r in op1_sentence_pieces(spark, FOLDER).collect()}
    ten = {r["doc_id"]: r for r in op10_token_counts(spark, FOLDER).collect()}
    assert one.keys() == ten.keys() == texts.keys()
    for k, text in texts.items():
        ids = library.encode(text, add_eos=True)
        assert one[k]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert one[k]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert one[k]["n_tokens"] == len(ids) == ten[k]["n_tokens"] + 1
        assert ten[k]["n_bytes"] == len(text.encode()) and ten[k]["over_limit"] == (len(ids) > 4097)


def test_decoding_in_the_same_trip(spark, docs_of):
    docs = docs_of(odd_documents())
    both = {r["doc_id"]: (r["ids"], r["again"]) for r in encode(docs, PATH, end=True, decoded="again").collect()}
    apart = {r["doc_id"]: (r["ids"], r["decoded"]) for r in decode(encode(docs, PATH, end=True), PATH).collect()}
    assert both == apart
