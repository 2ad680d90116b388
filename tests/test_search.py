import json

import pytest
from pyspark.sql import functions as F

from lexmill import cli
from lexmill.functions.models import OverlapReranker, TableResolver
from lexmill.operators.vectors import batch_top_k, top_k, usable
from lexmill.plans.evaluate import case_ranks, recall, synonym_forms
from lexmill.plans.search import Lexicon, SearchRequest, pool_size
from lexmill.schema import CANDIDATE, PHONETICS, RESULT_ROW
from lexmill.sources.sinks import exact_preview, result_line, static_table
from lexmill.streaming.queries import answer_stream, running_counts

SHAPE = (
    f"row_id long, headword string, headword_lc string, pos string, definition string, examples array<string>, source string, sentiwordnet struct<pos: double, neg: double, obj: double>, "
    f"emolex array<string>, synonyms array<string>, tags array<string>, phonetics {PHONETICS}, zipf double, first boolean, embedding array<float>, norm double"
)


def sense(row, word, definition="", pos="noun", zipf=None, first=True, vector=(1.0, 0.0), tags=None, emolex=None, phonetics=None, synonyms=None):
    return (row, word, word.lower(), pos, definition, ["an example"], "wiktionary", None, emolex, synonyms, tags, phonetics, zipf, first, list(vector), 1.0)


class Fixed:
    """An embedder that knows one query."""

    dim = 2

    def encode_query(self, text):
        return [1.0, 0.0]


CAT = (1, "AE", "AE T", "/", ["K", "AE1", "T"])
ENTRY = {"syllable_count": 1, "primary_vowel": "AE", "rhyme_key": "AE T", "meter": "/", "phonemes": ["B", "AE1", "T"]}


def lexicon(spark, rows, **parts):
    return Lexicon(spark.createDataFrame(rows, SHAPE), embedder=Fixed(), reranker=OverlapReranker(), **parts)


def names(result):
    return [r.headword for r in result.candidates.orderBy("rank").collect()]


def test_structural_ranking_and_keys(spark):
    lex = lexicon(spark, [sense(0, "bluebird", zipf=1.5), sense(1, "blueprint", zipf=3.2), sense(2, "Blueprint", first=False), sense(3, "redbird"), sense(4, "blue", zipf=-0.5)])
    result = lex.search("blue*")
    assert names(result) == ["blueprint", "bluebird", "blue"]
    assert [r.relevance for r in result.candidates.orderBy("rank").collect()] == [100, 54, 0]
    assert tuple(result.candidates.columns[:11]) == CANDIDATE
    assert result.exact is None
    assert names(lex.search("blue*", top_n=1)) == ["blueprint"]
    assert names(lex.search("blue*", top_n=0)) == []
    assert names(lex.search("blue*", sort="alpha")) == ["blue", "bluebird", "blueprint"]
    with pytest.raises(ValueError):
        lex.search("blue*", top_n=-1)


def test_structural_filters_see_the_first_sense(spark):
    lex = lexicon(spark, [sense(0, "cat", pos="noun", phonetics=CAT), sense(1, "cat", pos="verb", first=False), sense(2, "cot", pos="verb")], resolver=TableResolver({"bat": ENTRY}))
    assert names(lex.search("c?t", category="verb")) == ["cot"]
    assert names(lex.search("c?t", syllables=0)) == []
    assert names(lex.search("c?t", rhymes_with="bat", sounds_like="bat", meter="/", primary_vowel="ae")) == ["cat"]
    for wrong in ({"category": "nope"}, {"sort": "nope"}, {"rhymes_with": "unknown"}):
        with pytest.raises(ValueError):
            lex.search("c?t", **wrong)


def test_meaning_dedupes_excludes_and_scales(spark):
    rows = [sense(0, "Happy", "feeling joy"), sense(1, "happy", "feeling great joy today", first=False), sense(2, "glad", "feeling great joy", zipf=5.0), sense(3, "Sad", "feeling down", vector=(0.0, 1.0)), sense(4, "joy", "great joy", pos="verb")]
    lex = lexicon(spark, rows)
    result = lex.search("great joy")
    assert names(result) == ["glad", "happy", "joy", "Sad"]
    top = result.candidates.orderBy("rank").first()
    assert (top.relevance, top.label, top.stress, top.tags) == (100, "neutral", None, [])
    assert names(lex.search("great joy", category="verb")) == ["joy"]
    assert "happy" not in [n.lower() for n in names(lex.search("HAPPY"))]
    exact = lex.search("HAPPY").rows().orderBy("position").first()
    assert (exact.headword, exact.is_exact, exact.relevance, exact.definition) == ("HAPPY", True, 100, "feeling joy")


def test_equal_scores_keep_the_order_of_first_appearance(spark):
    rows = [sense(0, "b", "x"), sense(1, "a", "x"), sense(2, "b", "x", first=False)]
    assert names(lexicon(spark, rows).search("query")) == ["b", "a"]


def test_filter_before_limit(spark):
    rows = [sense(0, "one", "big red dog", "adjective"), sense(1, "two", "big red"), sense(2, "three", "big")]
    assert names(lexicon(spark, rows).search("big red dog", top_n=2, category="noun")) == ["two", "three"]


def test_combined_small_and_large_pools(spark):
    few = lexicon(spark, [sense(0, "bluebell", "snow"), sense(1, "redwood", "snow snow"), sense(2, "blue", "snow", vector=(0.0, 1.0))])
    assert names(few.search("blue*:snow")) == ["bluebell", "blue"]
    assert few.search("blue*:snow").exact is None
    assert len(names(few.search(",:snow"))) == 3
    many = [sense(i, f"blueword{i}", "snow" if i == 42 else "rain", vector=(1.0, 0.01 * i)) for i in range(80)]
    many += [sense(100 + i, f"redword{i}", "snow") for i in range(80)]
    assert names(lexicon(spark, many).search("blue*:snow", top_n=1)) == ["blueword42"]
    assert (pool_size(1), pool_size(30)) == (75, 90)


def test_many_at_once(spark):
    lex = lexicon(spark, [sense(0, "Happy", "feeling joy"), sense(1, "happy", "great joy", first=False), sense(2, "glad", "great joy", zipf=5.0), sense(3, "sad", "down", "verb", vector=(0.0, 1.0))])
    queries = spark.createDataFrame([(1, "great joy", [1.0, 0.0]), (2, "GLAD", [1.0, 0.0]), (3, None, [0.0, 1.0])], "query_id long, text string, vec array<float>")
    rows = lex.search_many(queries, top_n=2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.row_id) for r in rows if r.query_id < 3] == [(1, 1, 2), (1, 2, 1), (2, 1, 0), (2, 2, 3)]
    assert [r.headword for r in lex.search_many(queries, category="verb").filter("query_id = 1").collect()] == ["sad"]
    assert lex.search_many(queries.limit(0)).count() == 0
    with pytest.raises(ValueError):
        lex.search_many(queries, category="nope")


def test_empty_index(spark):
    lex = lexicon(spark, [])
    for query in ("a*", "a meaning", "a*:meaning", "expand:ab", "**word**"):
        assert names(lex.search(query)) == []
        assert lex.search(query).rows().count() == 0


def test_lookup(spark):
    lex = lexicon(spark, [sense(1, "Set", "b"), sense(0, "set", "a"), sense(2, "sets", "c")])
    assert [r.row_id for r in lex.lookup("SET").collect()] == [0, 1]
    assert lex.lookup("none").count() == 0


def test_request():
    request = SearchRequest.from_dict({"query": "x", "top_n": None, "sort": "alpha", "unknown": 1})
    assert (request.query, request.top_n, request.sort, request.category) == ("x", 10, "alpha", None)


def test_rows_lines_and_previews(spark):
    lex = lexicon(spark, [sense(0, "set", "a " * 60, zipf=2.0, synonyms=["put"]), sense(1, "sett", None, zipf=1.0)])
    rows = lex.search("set*").rows()
    assert tuple(rows.columns) == (*RESULT_ROW, "position")
    lines = [r[0].split("\t") for r in rows.orderBy("position").select(result_line(F.col("position"))).collect()]
    assert [len(x) for x in lines] == [6, 6]
    assert lines[0][1].endswith("...")
    assert lines[1][4:] == ["1", "sett"]
    assert "sett" in static_table([r.asDict() for r in rows.orderBy("position").collect()])
    senses = lex.tagged(lex.lookup("set")).agg(F.collect_list(F.struct("pos", "definition", "stress", "label", "polarity", "synonyms", "examples")).alias("s"))
    text = senses.select(exact_preview(F.col("s"), "SET")).first()[0]
    assert text.startswith("Exact match — SET\n\n(noun) a ")
    assert "Synonyms: put" in text


def test_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.9, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [1.0]), (6, [2.0, 0.0]), (7, [1.0, None])], "row_id long, embedding array<float>")
    assert [r.row_id for r in top_k(df, [1.0, 0.0], 3).collect()] == [0, 6, 2]
    assert top_k(df, [1.0, 0.0], 99).count() == 4
    rows = usable(df, "row_id", "embedding", 2)
    whole = sorted(tuple(r) for r in batch_top_k(rows, rows, 2, 2).collect())
    assert whole == sorted(tuple(r) for r in batch_top_k(rows, rows, 2, 2, block_rows=1).collect())
    assert sorted((r[3], r[1]) for r in whole if r[0] == 0) == [(1, 6), (2, 2)]
    assert batch_top_k(rows.limit(0), rows, 2, 2).count() == 0


def test_recall(spark):
    forms = synonym_forms(spark.createDataFrame([("Happy", "h.1"), ("glad_one", "h.1"), ("sad", "s.1"), (None, "s.1"), ("x", None)], "headword string, synset string"))
    cases = spark.createDataFrame([(1, "f", "happy"), (2, "f", "happy"), (3, "g", "sad"), (4, "g", "none")], "case_id long, source string, word string")
    top = spark.createDataFrame([(1, 2, "happy"), (1, 1, "other"), (2, 1, "glad one"), (3, 1, "glad one")], "case_id long, rank int, word string")
    got = {r.source: (r.cases, r.exact_hits, r.either_hits) for r in recall(case_ranks(top, cases, forms)).collect()}
    assert got == {"f": (2, 1, 2), "g": (2, 0, 0), None: (4, 1, 2)}


def test_query_stream(spark, tmp_path):
    lex = lexicon(spark, [sense(0, "set", zipf=1.0), sense(1, "sea")])
    for n, line in enumerate(({"query_id": 1, "query": "se*"}, {"query_id": 2, "query": "  "}, {"query_id": 3, "query": "set"})):
        (tmp_path / f"{n}.json").write_text(json.dumps(line))
    answers = []
    stream = spark.readStream.schema("query_id long, query string").json(str(tmp_path))
    run = answer_stream(stream, lex, lambda df, epoch: answers.extend(df.select("query_id", "headword").collect())).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sorted(map(tuple, answers)) == [(1, "sea"), (1, "set"), (3, "sea"), (3, "set")]


def test_running_counts(spark, tmp_path):
    spark.createDataFrame([("run_VERB", ["2010,3,1"]), ("Run", ["2011,4,1"])], "token string, year_counts array<string>").write.parquet(str(tmp_path / "n"))
    stream = running_counts(spark.readStream.schema("token string, year_counts array<string>").parquet(str(tmp_path / "n")))
    run = stream.writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert [tuple(r) for r in spark.table("running").collect()] == [("run", 7)]


def test_cli(spark, tmp_path, capsys):
    spark.createDataFrame([sense(0, "set", "a place", zipf=1.0), sense(1, "sea", "water")], SHAPE).write.parquet(str(tmp_path / "senses"))
    assert cli.main(["se*", "--index", str(tmp_path), "--format", "jsonl"]) == 0
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [(r["headword"], r["is_exact"], r["stress"], r["synonyms"]) for r in rows] == [("set", False, None, []), ("sea", False, None, [])]
    assert cli.main(["se*", "--index", str(tmp_path), "--format", "lines", "--sort", "alpha"]) == 0
    assert capsys.readouterr().out.splitlines()[0].split("\t")[5] == "sea"
    assert cli.main(["se*", "--index", str(tmp_path)]) == 0
    assert "relevance" in capsys.readouterr().out
    assert cli.main(["se*", "--index", str(tmp_path), "--rhymes-with", "x"]) == 2
    for wrong in (["--meter", "ab"], ["--sort", "up"], ["--primary-vowel", "Q"]):
        with pytest.raises(SystemExit):
            cli.main(["x", "--index", str(tmp_path), *wrong])
