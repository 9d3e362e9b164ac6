"""Token ids against the public library's own encoder."""

import os

import pytest

from strataform.llm.bpe import PATTERN, TOKENIZERS, Encoder, encode_texts, merge_piece, read_ranks

PATH = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")
TEXTS = ["", " ", "  \n\n ", "Hello world's  end", "naïve – ümlaut 漢字 🫁", "<|endoftext|> is text", "a" * 5000, "ab" * 3000, "́é", "1234567 x_y\t\r\n", "x" + " " * 300 + "y", "\x00\x7f﻿"]


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def test_texts(reference):
    encoder = Encoder(PATH)
    for t in TEXTS:
        assert encoder(t) == reference.encode_ordinary(t)
    assert encoder(None) == []


def test_random_pieces(reference):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    encoder = Encoder(PATH)

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=80))
    def check(t):
        assert encoder(t) == reference.encode_ordinary(t)

    check()


def test_ties_go_to_the_left():
    ranks = {b"a": 0, b"b": 1, b"aa": 2, b"ab": 3}
    assert merge_piece(b"aaa", ranks) == [2, 0] and merge_piece(b"aaab", ranks) == [2, 3]


def test_frame(spark, reference):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate([*TEXTS, None, TEXTS[3]])], "doc_id bigint, text string, k string, ids string")
    got = {r.doc_id: r.ids for r in encode_texts(df, "doc_id", "text").collect()}
    assert got == {i: reference.encode_ordinary(t or "") for i, t in enumerate([*TEXTS, None, TEXTS[3]])}
    assert encode_texts(df.filter("false"), "doc_id", "text").count() == 0
