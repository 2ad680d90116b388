"""The written index: what a pattern reads of it, pronunciations from it, and what is missing or let go."""

import pytest

from lexmill.functions.models import IndexResolver
from lexmill.operators.merge import row_lists
from lexmill.plans.search import Lexicon
from lexmill.session import release, shared_path, written_once
from lexmill.sources.readers import must_exist, read_frequency
from lexmill.sources.sinks import read_index, write_index

SHAPE = "row_id long, headword string, headword_lc string, pos string, definition string, examples array<string>, source string, sentiwordnet struct<pos:double,neg:double,obj:double>, emolex array<string>, synonyms array<string>, tags array<string>, phonetics struct<syllable_count:int,primary_vowel:string,rhyme_key:string,meter:string,phonemes:array<string>>, zipf double, first boolean, embedding array<float>, norm double"


def sound(*phonemes):
    return (1, phonemes[-2].rstrip("012"), " ".join(p.rstrip("012") for p in phonemes[1:]), "/", list(phonemes))


@pytest.fixture(scope="module")
def index(spark):
    words = [("cat", sound("K", "AE1", "T"), 5.0), ("bat", sound("B", "AE1", "T"), 4.0), ("Bath", sound("B", "AE1", "TH"), 3.0), ("dog", sound("D", "AO1", "G"), 6.0), ("ba", None, None)]
    rows = [(n, w, w.lower(), "noun", f"a {w}", None, "wordnet", None, None, None, None, p, z, True, None, None) for n, (w, p, z) in enumerate(words)]
    path = shared_path(spark, "index")
    senses = spark.createDataFrame(rows, SHAPE)
    write_index(senses, senses.select("headword_lc", "zipf").toDF("word", "zipf"), path)
    return path


def test_a_prefix_reaches_the_scan_and_nothing_is_shuffled_before_the_limit(spark, index):
    plan = Lexicon(read_index(spark, index)).search("ba*", top_n=3).candidates._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(headword_lc,ba)" in plan
    below = plan[plan.index("TakeOrderedAndProject") :]
    assert "Exchange" not in below
    assert "EqualTo(first,true)" in plan


def test_pronunciations_come_from_the_index(spark, index):
    lexicon = Lexicon(read_index(spark, index))
    assert [r.headword for r in lexicon.search("?at", rhymes_with="cat").rows().orderBy("position").collect()] == ["cat", "bat"]
    assert {r.headword for r in lexicon.search("*a*", sounds_like="Bat").rows().collect()} == {"cat", "bat", "Bath"}
    for word in ("ba", "unknown", "two words", "in-between"):
        assert IndexResolver(lexicon.senses).resolve(word, "noun") is None
        with pytest.raises(ValueError, match="no pronunciation"):
            lexicon.search("?at", rhymes_with=word)


def test_missing_inputs(spark, tmp_path):
    assert read_frequency(spark, None).count() == 0
    assert read_frequency(spark, f"file://{tmp_path}/absent").count() == 0
    spark.createDataFrame([("a", 1.0)], "word string, zipf double").write.parquet(f"file://{tmp_path}/there")
    assert read_frequency(spark, f"file://{tmp_path}/there").count() == 1
    assert must_exist("hdfs:/somewhere") == "hdfs:/somewhere"
    with pytest.raises(FileNotFoundError):
        must_exist(str(tmp_path / "absent"))


def test_lists_of_rows_are_bounded(spark):
    rows = spark.createDataFrame([(n, "a" if n % 3 else "b") for n in range(25)], "row_id long, w string")
    found = {(r.w, r.block): r.ids for r in row_lists(rows, rows.w, "w", span=10).collect()}
    assert found["a", 1] == [10, 11, 13, 14, 16, 17, 19]
    assert sorted(i for ids in found.values() for i in ids) == list(range(25))


def test_written_once_until_released(spark):
    calls = []

    def write(path):
        calls.append(path)
        spark.range(3).write.parquet(path)

    assert written_once(spark, "d", "three", write) == written_once(spark, "d", "three", write)
    assert len(calls) == 1
    release(spark)
    assert spark.read.parquet(written_once(spark, "d", "three", write)).count() == 3
    assert len(calls) == 2
