import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lexmill.llm.lookalike import Automaton, MappingConflict, Transducer, build_mapping, look_alike_rows, standard_mapping, transducer, with_canonical


@pytest.mark.parametrize(
    ("written", "seen"),
    [
        ("ｓｅｔ", "set"),
        ("ѕеt", "set"),
        ("s​et", "set"),
        ("a b", "a b"),
        ("é", "é"),
        ("е́", "é"),
        ("e​́x", "éx"),
        ("𝚜𝚎𝚝", "set"),
        ("ﬄ", "ffl"),
        ("Ｉ­ⅰ", "Ii"),
        ("statlet‑tolity", "statlet-tolity"),
        ("ΝΗ", "NH"),
        ("ν", "v"),
        ("set", "set"),
        ("", ""),
        ("\u1100\u1161", "\uac00"),
        ("\u0600\u0661", "\u0600\u0661"),
        ("👩\u200d👩\u200d👧", "👩\u200d👩\u200d👧"),
        ("❤\ufe0f", "❤\ufe0f"),
        ("می\u200cخواهم", "می\u200cخواهم"),
        ("o\u0338re", "øre"),
        ("i\u0307\u0301", "í"),
        ("\u0451", "ë"),
        ("\u0435\u0308", "ë"),
        ("ᎪᏴ ꓐꓑ Ⲏⲟ", "AB BP Ho"),
        ("a\u00a0\u2003b  c", "a  b  c"),
        ("書", "書"),
        ("№", "№"),
        ("ærlig", "ærlig"),
        ("x" * 100_000 + "​", "x" * 100_000),
    ],
)
def test_forms(written, seen):
    assert transducer()(written) == seen


@given(st.text())
def test_twice_is_once(text):
    once = transducer()(text)
    assert transducer()(once) == once


def test_every_code_point():
    apply = transducer()
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x20000), *range(0xE0000, 0xE0200)]):
        for text in (c, f"a{c}b", f"a{c}\u0301"):
            once = apply(text)
            assert apply(once) == once
        assert apply(unicodedata.normalize("NFD", c + "\u0301")) == apply(unicodedata.normalize("NFC", c + "\u0301"))


def test_longest_source_wins():
    automaton = Automaton({"a": "1", "ab": "2", "abcd": "3"})
    assert [automaton(x) for x in ("a", "ab", "abc", "abcd", "xabca")] == ["1", "2", "2c", "3", "x2c1"]


@given(st.text(st.characters(max_codepoint=0x24F)))
def test_plain_latin_is_only_composed(text):
    mapping = standard_mapping()
    if not any(source in unicodedata.normalize("NFD", text) for source in mapping):
        assert transducer()(text) == unicodedata.normalize("NFC", text)


def test_conflicts_are_found():
    with pytest.raises(MappingConflict):
        build_mapping([("х", "x"), ("х", "y")])
    with pytest.raises(MappingConflict):
        build_mapping([("а", "б"), ("б", "в"), ("в", "г")])
    assert build_mapping([("a1", "b"), ("a1", "b")]) == {"a1": "b"}
    assert Transducer({"а": "a", "​": ""})("а​b") == "ab"


def test_rows(spark):
    words = spark.createDataFrame([("m", 1, "ѕet"), ("m", 2, "SET  "), ("m", 3, "set"), ("n", 4, "s⁠et"), ("m", 5, None), ("m", 6, ""), ("m", 7, "fill"), ("m", 8, "fîll"), ("m", 1, "ѕet"), ("n", 9, " set"), ("n", 10, "two words")], "origin string, row_key long, text string")
    vocabulary = spark.createDataFrame([(1, "set"), (2, "fîll"), (3, "two words"), (4, None)], "word_id long, word string")
    assert sorted(tuple(r) for r in look_alike_rows(words, vocabulary).collect()) == [("m", 1, 1), ("m", 1, 1), ("m", 8, 2), ("n", 4, 1), ("n", 9, 1), ("n", 10, 3)]
    assert look_alike_rows(words.limit(0), vocabulary).count() == 0
    assert look_alike_rows(words, vocabulary.limit(0)).count() == 0


def test_clashing_column_is_replaced(spark):
    df = spark.createDataFrame([(1, "ａ", "old"), (2, None, "old")], "id int, t string, canonical string")
    assert [tuple(r) for r in with_canonical(df, "t").orderBy("id").collect()] == [(1, "ａ", "a"), (2, None, None)]
    assert df.columns == ["id", "t", "canonical"]
