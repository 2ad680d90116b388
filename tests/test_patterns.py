import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.operators.patterns import VOWELS, clause_predicate, clauses_predicate, headword_predicate
from lexmill.plans.query import parse_query

CASES = [
    ("blue*", ["bluebird"], ["skyblue"]),
    ("*bird", ["mockingbird"], ["birdcage"]),
    ("bl????rd", ["blizzard"], ["blackbird", "blrd"]),
    ("#at", ["bat", "yat"], ["eat"]),
    ("c@t", ["cat", "cot"], ["cyt"]),
    ("-xyz", ["cat"], ["lazy", "year"]),
    ("+cat", ["tact", "act"], ["cats"]),
    ("//dear//", ["read", "dare"], ["dared", "dea"]),
    ("//fuljyo", ["joyful"], ["fully"]),
    ("a.b", ["a.b"], ["axb"]),
    ("*", ["", "anything at all"], []),
]


def words(spark, found):
    return spark.createDataFrame([(w,) for w in found], "w string")


@pytest.mark.parametrize(("clause", "yes", "no"), CASES)
def test_clause(spark, clause, yes, no):
    df = words(spark, [*yes, *no])
    assert sorted(r.w for r in df.filter(clause_predicate(F.col("w"), clause)).collect()) == sorted(yes)


def test_all_of_several_and_none(spark):
    df = words(spark, ["happy", "gold", "mystery"])
    assert [r.w for r in df.filter(clauses_predicate(F.col("w"), ("?????", "*y*"))).collect()] == ["happy"]
    assert df.filter(clauses_predicate(F.col("w"), ())).count() == 3


def test_expand_and_phrase(spark):
    df = words(spark, ["national aeronautics and space administration", "nasa", "winter sport", "harsh winter", "winter", "winters tale"])
    fits = lambda line: sorted(r.w for r in df.filter(headword_predicate(F.col("w"), parse_query(line))).collect())
    assert fits("expand:nasa") == ["national aeronautics and space administration"]
    assert fits("**winter**") == ["harsh winter", "winter sport"]
    with pytest.raises(ValueError):
        headword_predicate(F.col("w"), parse_query("plain meaning"))


def as_python(clause):
    wild = {"*": ".*", "?": ".", "#": "[bcdfghjklmnpqrstvwxyz]", "@": f"[{VOWELS}]"}
    return re.compile("^" + "".join(wild.get(c) or re.escape(c) for c in clause) + "$", re.IGNORECASE)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(clause=st.text("ab*?#@.é\n", min_size=1, max_size=5), found=st.lists(st.text("abcé.\n ", max_size=6), min_size=1, max_size=12))
def test_wildcards_agree_with_python(spark, clause, found):
    if "\n" in clause:
        return
    df = words(spark, found)
    from lexmill.operators.patterns import wildcard

    got = sorted(r.w for r in df.filter(wildcard(F.col("w"), clause)).collect())
    assert got == sorted(w for w in found if as_python(clause).match(w))


def test_prefix_reaches_the_scan(spark, tmp_path):
    words(spark, ["abc", "xyz"]).write.parquet(str(tmp_path / "w"))
    plan = spark.read.parquet(str(tmp_path / "w")).filter(clause_predicate(F.col("w"), "ab*"))._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith" in plan
