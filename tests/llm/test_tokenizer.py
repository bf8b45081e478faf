import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import tokenizer

P = pytest.importorskip("public_tokenizers")
DATA = open(tokenizer.vocabulary_path(), "rb").read()


@pytest.fixture(scope="module")
def own():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, DATA.splitlines())}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equal_to_public_library(own):
    texts = ["Hello world", "", None, "  two  spaces\n\n\tx", "<|endoftext|> is text", "aaaaaaaaaaaa" * 50, "naïve 東京 😀‍🔥 café", "x" * 50_000]
    assert tokenizer.encode_texts(texts, DATA, P.PATTERN) == [own.encode_ordinary(t) if t else [] for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=6))
def test_any_text(own, texts):
    assert tokenizer.encode_texts(texts, DATA, P.PATTERN) == [own.encode_ordinary(t) for t in texts]


def test_rows(spark, own):
    df = spark.createDataFrame([(1, "some text", "a"), (2, None, "b"), (3, "", "c"), (1, "some text", "a"), (None, "some", "d")], "k long, t string, ids string")
    got = tokenizer.encode_corpus(df, "k", "t").collect()
    assert sorted(((r.k or 0), tuple(r.ids)) for r in got) == sorted(
        [(1, tuple(own.encode_ordinary("some text")))] * 2 + [(2, ()), (3, ()), (0, tuple(own.encode_ordinary("some")))]
    )
    assert tokenizer.encode_corpus(df.limit(0), "k", "t").count() == 0
