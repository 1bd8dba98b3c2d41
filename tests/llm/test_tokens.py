"""Forced-boundary splitting against the tokenizer itself."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm import tokens

PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def encoder():
    return tokens.encoder(PATH)


PIECES = ["a", "b", "The", " ", "  ", "\n", "\t", "'", "s", "'s", "re", "1", "23", ".", ",", "!", "é", "ß", "中", "文", "　", " ", " ", "\u0085", "\r", "<|endoftext|>", "_", "-", "(", "😀", "́", "x" * 50, "ll", "\x00", "\x7f"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25))
def test_pieces_equal_the_whole(pieces):
    text, e = "".join(pieces), tokens.encoder(PATH)
    assert e.encode(text.encode()) == e.plain.encode_ordinary(text)


@settings(max_examples=500, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    e = tokens.encoder(PATH)
    assert e.encode(text.encode()) == e.plain.encode_ordinary(text)


def test_round_trip_and_long_texts(encoder):
    for text in ("word " * 20_000, "ab" * 20_000, "\n" * 5_000, "日本語" * 5_000):
        ids = encoder.encode(text.encode())
        assert encoder.plain.decode(ids) == text and ids == encoder.plain.encode_ordinary(text)


def test_no_token_crosses_a_certain_cut(encoder):
    for token in tokens.read_ranks(PATH):
        assert not any(encoder.cut[a * 256 + b] for a, b in zip(token, token[1:]))


def test_column(spark, encoder):
    rows = [(1, "Hello world's end", "x"), (2, "", None), (3, None, "y"), (3, "<|endoftext|>", "y"), (None, "a", "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    got = [(r["doc_id"], r["ids"]) for r in tokens.encode_documents(df, "doc_id", "text").collect()]
    assert got == [(i, encoder.plain.encode_ordinary(t or "")) for i, t, _ in rows]
    counts = tokens.count_tokens(df.drop("n_tokens").withColumn("source", df["text"]), "doc_id", "text", ["source"])
    assert [(r["source"], r["n_tokens"]) for r in counts.collect()] == [(t, len(encoder.plain.encode_ordinary(t or ""))) for _, t, _ in rows]
    assert tokens.encode_documents(df.limit(0), "doc_id", "text").collect() == []
    assert dict(tokens.encode_documents(df, "doc_id", "text").dtypes) == {"doc_id": "bigint", "ids": "array<int>"}
