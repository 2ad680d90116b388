import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import tokens

tk = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def public():
    t = tk.Tokenizer.from_file(tokens.DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_odd_texts(public):
    rng = random.Random(1)
    long_word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4_000))
    texts = ["", " ", "\n\n  x", "it's we'll", "<|endoftext|> plain", "日本語のテキスト", "naïve é", "a" * 3_001, "x" * 40_000, "baaaaaab" * 9, "é" * 2_001, " " * 500, long_word, "é" * 700, "äb" * 3_000, long_word * 20, "-" * 300 + "=" * 300, "👩‍👩‍👧 ok", "\x00\x01", "مرحبا 123 №"]
    assert list(tokens.tokenizer().encode(texts)) == [public(t) for t in texts]
    assert list(tokens.tokenizer().encode([None, ""])) == [[], []]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_any_text(public, text):
    ids = next(tokens.tokenizer().encode([text]))
    assert ids == public(text)
    assert tokens.tokenizer().decode(ids).decode() == text


def test_memory_is_bounded(public, monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY_WORDS", 5)
    own = tokens.Tokenizer(tokens.DEFAULT_VOCABULARY)
    for text in ("one two three four", "five six seven eight", "one nine"):
        assert next(own.encode([text])) == public(text)
        assert len(own.memory) <= 5


def test_frame(spark, public):
    df = spark.createDataFrame([(1, "hello world", "x"), (1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (None, "a", "x")], "doc_id long, text string, ids string")
    rows = sorted(tokens.encode_texts(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.ids))
    assert [tuple(r) for r in rows] == [(1, public("hello world"))] * 2 + [(2, []), (3, []), (None, public("a"))]
    assert tokens.encode_texts(df.limit(0)).count() == 0
    counted = tokens.with_token_counts(df.withColumnRenamed("ids", "n_tokens"))
    assert sorted(r.n_tokens for r in counted.collect()) == [0, 0, 1, 2, 2]
