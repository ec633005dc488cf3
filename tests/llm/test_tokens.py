"""Encoding and counting against the library on whole texts, and exact round trips."""

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe, token_count

TEXT = st.text(st.sampled_from(list("abcé ß日本 \n\t'.,1234\U0001f600́ABC")), max_size=60)
ROWS = [(1, None), (2, ""), (3, "Hello world, hello!"), (3, "Hello world, hello!"), (None, "né日本 \U0001f600"), (4, "some words of it " * 20_000), (5, "x" * 50_000)]


@settings(max_examples=100, deadline=None)
@given(TEXT, st.integers(1, 12))
def test_cuts_change_nothing(text, size):
    assert "".join(bpe.pieces(text, size)) == text
    assert bpe.encode_text(text, piece_chars=size) == bpe.encoding(bpe.RANKS).encode_ordinary(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=12), max_size=8))
def test_merging_same_as_library(sequences):
    enc = bpe.encoding(bpe.RANKS)
    assert token_count._merger(bpe.RANKS).counts(sequences).tolist() == [len(enc._core_bpe.encode_single_piece(s)) if s else 0 for s in sequences]


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    enc = bpe.encoding(bpe.RANKS)
    want = {r.doc_id: enc.encode_ordinary(r.text) for r in docs.collect()}
    got = bpe.round_trip(docs).collect()
    assert {r.doc_id: r.token_ids for r in got} == want and all(r.exact for r in got)
    assert {r.doc_id: r.n_tokens for r in token_count.count_tokens(docs).collect()} == {d: len(x) for d, x in want.items()}


def test_edge_rows(spark):
    docs = spark.createDataFrame([(d, t, "own") for d, t in ROWS], "doc_id long, text string, token_ids string")
    enc = bpe.encoding(bpe.RANKS)
    want = [None if t is None else enc.encode_ordinary(t) for _, t in ROWS]
    got = bpe.encode(docs)
    assert got.columns == ["doc_id", "text", "token_ids", "n_tokens"]
    assert [r.token_ids for r in got.collect()] == want
    assert [r.text for r in bpe.decode(got.drop("text")).collect()] == [t for _, t in ROWS]
    counts = [None if x is None else len(x) for x in want]
    assert [r.n_tokens for r in token_count.count_tokens(docs).collect()] == counts
    assert [(r.n_tokens, r.exact) for r in bpe.round_trip(docs).collect()] == [(n, None if n is None else True) for n in counts]
    assert bpe.encode(docs.limit(0)).count() == token_count.count_tokens(docs.limit(0)).count() == bpe.round_trip(docs.limit(0)).count() == 0


def test_ids_that_are_no_utf8_alone():
    ids = bpe.encode_text("\U0001f9ff")
    assert b"".join(bpe.decode_bytes([i]) for i in ids) == "\U0001f9ff".encode()
