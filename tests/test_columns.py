import pytest
from pyspark.sql import functions as F

from lexmill.functions import emotion, phonetics, score
from lexmill.functions.text import normalise_space_case, strip_pos_suffix
from lexmill.operators.filters import category_predicate, phonetic_predicate
from lexmill.operators.order import ranked
from lexmill.schema import PHONETICS
from lexmill.sources.sinks import short_gloss


def one(spark, column, schema="x string", row=("",)):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first().v


def test_text(spark):
    df = spark.createDataFrame([("run_NOUN",), ("some_thing",), ("a_VERB ",), ("_X",), (None,)], "x string")
    assert [r[0] for r in df.select(strip_pos_suffix(F.col("x"))).collect()] == ["run", "some_thing", "a", "", None]
    assert one(spark, normalise_space_case(F.col("x")), row=(" A \tB\n",)) == "a b"


def test_short_gloss(spark):
    assert one(spark, short_gloss(F.col("x")), row=("g" * 70,)) == "g" * 70
    assert one(spark, short_gloss(F.col("x")), row=("g" * 71,)) == "g" * 67 + "..."


def test_relevance(spark):
    rel = lambda xs: [r.v for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", score.relative_relevance(F.col("x")).alias("v")).orderBy("x").collect()]
    assert rel([0.2, 0.6, 1.0]) == [0, 50, 100]
    assert rel([0.5, 0.5]) == [50, 50]
    assert rel([]) == []
    assert [one(spark, score.absolute_relevance(F.lit(x))) for x in (0.0, -1000.0, 1000.0)] == [50, 0, 100]


def test_cosine(spark):
    assert one(spark, score.cosine(F.col("x"), [1.0, 0.0]), "x array<float>", ([3.0, 4.0],)) == pytest.approx(0.6)
    assert one(spark, score.combined_score(F.lit(5.0), F.col("x")), "x double", (None,)) == 5.0


@pytest.mark.parametrize(
    ("phonemes", "vowel", "rhyme"),
    [(["K", "AE1", "T"], "AE", "AE T"), (["EH1", "L", "AH0", "F", "AH0", "N", "T"], "EH", "EH L AH F AH N T"), (["DH", "AH0"], "AH", "AH"), (["B", "AH0", "N", "AE1", "N", "AH0"], "AE", "AE N AH")],
)
def test_phonetics(spark, phonemes, vowel, rhyme):
    got = one(spark, phonetics.derive(F.col("p"), F.lit(2), F.lit(0), F.col("s")), "p array<string>, s array<int>", (phonemes, None))
    assert (got.primary_vowel, got.rhyme_key, got.meter) == (vowel, rhyme, "/x")
    assert one(spark, phonetics.derive(F.col("p"), F.lit(2), F.lit(0), F.col("s")), "p array<string>, s array<int>", ([], None)) is None


def test_distance_and_runs(spark):
    d = lambda p, t: one(spark, phonetics.phoneme_distance(F.col("p"), t), "p array<string>", (p,))
    assert d(["K", "AE1", "T"], ["K", "AE0", "T"]) == 0
    assert d(["B", "AE1", "T"], ["K", "AE1", "T"]) == pytest.approx(1 / 3)
    assert d(["EH1", "L", "AH0", "F", "AH0", "N", "T"], ["K", "AE1", "T"]) > 0.7
    assert d(None, ["K"]) is None
    run = lambda p: one(spark, phonetics.mean_consonant_run(F.col("p")), "p array<string>", (p,))
    assert run(["S", "T", "R", "EH1", "NG", "K", "TH", "S"]) == 3.5
    assert run(["M", "UW1", "N"]) == 1.0
    assert run(["AY1"]) == 0.0
    assert run(None) is None


def test_phonetic_filter(spark):
    df = spark.createDataFrame([(1, (1, "AE", "AE T", "/", ["K", "AE1", "T"])), (2, None)], f"id int, phonetics {PHONETICS}")
    keep = lambda **o: [r.id for r in df.filter(phonetic_predicate(F.col("phonetics"), **o)).collect()]
    assert keep() == [1, 2]
    assert keep(primary_vowel="", rhyme_key=None, phonemes=[], meter="") == [1, 2]
    assert keep(syllables=0) == []
    assert keep(syllables=1, primary_vowel="ae", rhyme_key="AE T", meter="/", phonemes=["B", "AE1", "T"]) == [1]


def test_category(spark):
    df = spark.createDataFrame([(1, "noun", ["archaic"]), (2, "phrase", None), (3, None, ["slang"]), (4, "verb", ["informal"])], "id int, pos string, tags array<string>")
    keep = lambda c: [r.id for r in df.filter(category_predicate(c, F.col("pos"), F.col("tags"))).collect()]
    assert keep(None) == keep("all") == [1, 2, 3, 4]
    assert keep("noun") == [1]
    assert keep("idiom_slang") == [2, 3]
    assert keep("old") == [1]
    with pytest.raises(ValueError):
        keep("nonsense")


@pytest.mark.parametrize(
    ("source", "scores", "labels", "guess", "expected"),
    [
        ("wordnet", (0.9, 0.0, 0.1), ["joy"], None, ("joy", "positive", "emolex")),
        ("wiktionary", None, None, "anger", ("anger", "negative", "classifier")),
        ("wiktionary", None, ["positive"], "fear", ("fear", "positive", "classifier")),
        ("wiktionary", None, None, None, ("neutral", "neutral", "none")),
        ("wordnet", (0.0, 0.5, 0.5), None, None, ("negative", "negative", "sentiwordnet")),
        ("wiktionary", None, ["negative"], None, ("negative", "negative", "emolex")),
        ("wiktionary", None, ["surprise"], "anger", ("surprise", "neutral", "emolex")),
        ("wiktionary", (0.9, 0.0, 0.1), [], None, ("neutral", "neutral", "none")),
        ("wiktionary", None, ["trust", "fear", "positive"], None, ("fear", "negative", "emolex")),
    ],
)
def test_emotion(spark, source, scores, labels, guess, expected):
    df = spark.createDataFrame([(source, scores, labels, guess)], "s string, c struct<pos: double, neg: double, obj: double>, l array<string>, g string")
    cols = emotion.emotion_columns(F.col("s"), F.col("c"), F.col("l"), F.col("g"))
    assert tuple(df.select(*[c.alias(n) for n, c in cols.items()]).first()) == expected


ROWS = [
    ("khazi", 1.0, ["slang"], None),
    ("Lavatory", None, ["formal", "slang"], (1, "", "", "", ["S", "T", "R", "EH1"])),
    ("toilet", 3.0, None, (1, "", "", "", ["M", "UW1"])),
    ("aye", -0.5, ["archaic"], (1, "", "", "", ["AY1"])),
    ("loo", 3.0, ["informal"], (1, "", "", "", ["L", "UW1"])),
]


@pytest.mark.parametrize(
    ("mode", "expected"),
    [
        (None, "khazi Lavatory toilet aye loo"),
        ("relevance", "khazi Lavatory toilet aye loo"),
        ("alpha", "aye khazi Lavatory loo toilet"),
        ("alpha_desc", "toilet loo Lavatory khazi aye"),
        ("shortest", "aye loo khazi toilet Lavatory"),
        ("longest", "Lavatory toilet khazi aye loo"),
        ("most_common", "loo toilet khazi Lavatory aye"),
        ("least_common", "aye Lavatory khazi loo toilet"),
        ("most_formal", "Lavatory toilet aye khazi loo"),
        ("oldest", "aye khazi Lavatory toilet loo"),
        ("most_modern", "khazi Lavatory toilet loo aye"),
        ("most_lyrical", "aye toilet loo Lavatory khazi"),
    ],
)
def test_orders(spark, mode, expected):
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(ROWS)], f"headword string, zipf double, tags array<string>, phonetics {PHONETICS}, pos_in_result int")
    assert " ".join(r.headword for r in ranked(df, mode).orderBy("rank").collect()) == expected
    with pytest.raises(ValueError):
        ranked(df, "sideways")


