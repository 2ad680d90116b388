import gzip
import json

import pytest
from pyspark.sql import functions as F

from lexmill.functions.models import HashedEmbedder, TableResolver, embed_definitions
from lexmill.operators.merge import merge_records
from lexmill.plans.build import build_lexicon, estimate_seconds, measure_embedder, number_rows
from lexmill.sources import readers
from lexmill.sources.sinks import read_index


def test_wordnet(spark):
    synsets = spark.createDataFrame([("car.n.01", "n", "a vehicle", ["my car"], ["car", "auto_mobile", "car"]), ("x.z.01", "z", "odd", None, ["x"])], readers.schema.WORDNET)
    scores = spark.createDataFrame([("car.n.01", 0.1, 0.2, 0.7)], readers.schema.SENTIMENT_ROWS)
    rows = readers.wordnet_senses(synsets, scores).orderBy("synset", "lemma_no").collect()
    assert [(r.headword, r.pos, r.synonyms) for r in rows] == [("car", "noun", ["auto mobile"]), ("auto mobile", "noun", ["car", "car"]), ("car", "noun", ["auto mobile"]), ("x", "z", [])]
    assert rows[0].sentiwordnet.neg == 0.2
    assert rows[3].sentiwordnet is None


LINES = [
    {"word": "dictionary", "pos": "noun", "lang_code": "en", "senses": [{"glosses": ["A reference work."], "examples": [{"text": "a law dictionary"}, {"text": ""}, {"ref": "x"}]}]},
    {"word": "green with envy", "pos": "adj", "lang_code": "en", "senses": [{"glosses": ["Envious."], "tags": ["idiomatic"]}]},
    {"word": "dictionaries", "pos": "noun", "lang_code": "en", "senses": [{"glosses": ["plural"], "tags": ["form-of"], "form_of": [{"word": "dictionary"}]}]},
    {"word": "bigge", "pos": "adj", "lang_code": "en", "senses": [{"glosses": ["big"], "tags": ["alt-of"]}]},
    {"word": "diccionario", "pos": "noun", "lang_code": "es", "senses": [{"glosses": ["x"]}]},
    {"word": "free", "pos": "adj", "lang_code": "en", "senses": [{"glosses": ["Unconstrained...", "Not imprisoned or enslaved."]}, {"glosses": []}, {}]},
    {"word": "", "pos": "noun", "lang_code": "en", "senses": [{"glosses": ["x"]}]},
]


@pytest.mark.parametrize("packed", [False, True])
def test_wiktionary(spark, tmp_path, packed):
    path = tmp_path / ("d.jsonl.gz" if packed else "d.jsonl")
    text = "\n\n".join(map(json.dumps, LINES)) + "\n"
    path.write_bytes(gzip.compress(text.encode()) if packed else text.encode())
    got = {r.headword: r for r in readers.read_wiktionary(spark, str(path)).collect()}
    assert set(got) == {"dictionary", "green with envy", "free"}
    assert got["dictionary"].examples == ["a law dictionary"]
    assert (got["green with envy"].pos, got["green with envy"].tags) == ("adjective", ["idiomatic"])
    assert got["free"].definition == "Unconstrained; Not imprisoned or enslaved."


def test_missing_files_are_named(spark):
    with pytest.raises(FileNotFoundError):
        readers.read_wiktionary(spark, "/nowhere/d.jsonl")
    assert readers.read_frequency(spark, "/nowhere/f").count() == 0


def test_ngrams(spark, tmp_path):
    (tmp_path / "n.tsv").write_text("run_NOUN\t2010,100,5\t2020,9,9\nrun_VERB\t2015,300,1\nRUN\t2019,50,3\nold\t1999,5,5\nno tab\nother\t2012,7,1\n")
    (tmp_path / "t.txt").write_text("\t2009,1,1,1\t2010,200,1,1\t2019,300,1,1\t2020,1,1,1")
    ngrams = readers.read_ngrams(spark, str(tmp_path / "n.tsv"))
    counts = {r.word: r.n for r in readers.word_counts(ngrams).collect()}
    assert counts == {"run": 450, "other": 7}
    only = readers.word_counts(ngrams, spark.createDataFrame([("Run",)], "word string"))
    assert [tuple(r) for r in only.collect()] == [("run", 450)]
    assert readers.corpus_total(spark, str(tmp_path / "t.txt")) == 500
    zipf = readers.zipf_scale(only, 10**9).first().zipf
    assert zipf == pytest.approx(2.6532, abs=1e-4)


def test_recent_count_of_odd_fields(spark):
    years = ["2010,1,1", None, "", "2011,x,1", "2012,5", "2013,2,1,9", "2014,4,0", " 2015,1,1", "99999999999999999999,1,1"]
    df = spark.createDataFrame([(years,), (None,), ([],)], "y array<string>")
    assert [r[0] for r in df.select(readers.recent_count(F.col("y"))).collect()] == [5, 0, 0]


def test_emotions_and_cases(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"abandon": ["fear", "sadness"], "calm": []}))
    assert {r.word: r.labels for r in readers.read_emotions(spark, str(tmp_path / "e.json")).collect()} == {"abandon": ["fear", "sadness"], "calm": []}
    (tmp_path / "c.json").write_text(json.dumps({"source": "s", "cases": {"happy": "feeling joy"}}))
    assert [tuple(r) for r in readers.read_cases(spark, str(tmp_path / "c.json")).collect()] == [("s", "happy", "feeling joy")]


def test_merge(spark):
    schema = "headword string, definition string, ordinal long"
    first = spark.createDataFrame([("happy", "feeling joy", 0), ("happy", "feeling joy", 1)], schema)
    second = spark.createDataFrame([("Happy ", " Feeling\tJOY", 0), ("happy", "lucky", 1), ("HAPPY", "Lucky", 2), (None, "x", 3), (None, "x", 4)], schema)
    rows = number_rows(merge_records(first, second)).orderBy("row_id").collect()
    assert [(r.row_id, r.headword, r.definition) for r in rows] == [(0, "happy", "feeling joy"), (1, "happy", "feeling joy"), (2, "happy", "lucky"), (3, None, "x")]


def test_embed_and_estimate(spark):
    df = spark.createDataFrame([("a small dog",), ("dog small a",), ("",), (None,)], "definition string")
    vectors = [r.embedding for r in embed_definitions(df, HashedEmbedder(8)).collect()]
    assert vectors[0] == vectors[1] != vectors[2] == vectors[3] == [0.0] * 8
    assert estimate_seconds(2.0, 10, 100) == 20.0
    assert estimate_seconds(2.0, 0, 100) == 0.0
    assert measure_embedder(df.withColumn("row_id", F.lit(1)), HashedEmbedder(8)) >= 0


def test_build_and_read_back(spark, tmp_path):
    shape = "ordinal long, headword string, pos string, definition string, examples array<string>, source string, sentiwordnet struct<pos: double, neg: double, obj: double>, synonyms array<string>, tags array<string>"
    first = spark.createDataFrame([(0, "Cat", "noun", "a small animal", ["my cat"], "wordnet", (0.0, 0.0, 1.0), ["kitty"], None)], shape)
    second = spark.createDataFrame([(0, "cat", "noun", "A small  animal", [], "wiktionary", None, None, ["informal"]), (1, "cat", "verb", "to raise an anchor", [], "wiktionary", None, None, ["nautical"])], shape)
    frequency = spark.createDataFrame([("cat", 4.5)], readers.schema.FREQUENCY)
    emotions = spark.createDataFrame([("cat", ["joy"])], readers.schema.EMOTIONS)
    entry = {"syllable_count": 1, "primary_vowel": "AE", "rhyme_key": "AE T", "meter": "/", "phonemes": ["K", "AE1", "T"]}
    build_lexicon(first, second, frequency, emotions, str(tmp_path), HashedEmbedder(8), TableResolver({"cat": entry}))
    rows = read_index(spark, str(tmp_path)).orderBy("row_id").collect()
    assert [(r.row_id, r.headword, r.first, r.zipf, r.emolex, r.tags) for r in rows] == [(0, "Cat", True, 4.5, ["joy"], []), (1, "cat", False, 4.5, ["joy"], ["nautical"])]
    assert rows[1].phonetics.rhyme_key == "AE T"
    assert rows[0].norm == pytest.approx(1.0)
