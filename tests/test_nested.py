import json

import pytest

from lexmill.operators.nested import ITEM_KINDS, flatten_entries, items, read_table, write_tables

SENSE = {"glosses": ["a", " ", None, 5, "b"], "tags": "lone", "examples": [{"text": "t"}, "bare", {"text": None}, {"ref": "x"}, None], "form_of": {"word": "w"}}


def found(spark, *lines):
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")
    return sorted(tuple(r) for r in items(flatten_entries(df)).select("line_no", "sense_no", "item_kind", "item_no").collect())


def test_positions_count_unusable_elements(spark):
    line = json.dumps({"word": "x", "senses": [None, SENSE, "no object"]})
    assert found(spark, line) == [(0, 1, "example", 0), (0, 1, "example", 1), (0, 1, "form_of", 0), (0, 1, "gloss", 0), (0, 1, "gloss", 4), (0, 1, "tag", 0)]


@pytest.mark.parametrize("line", [None, "", "   ", "[1]", "5", "null", '{"senses": [', '{"a": NaN}', '{"senses": []} x', '"{}"', "{}", '{"senses": null}', '{"senses": 7}'])
def test_nothing_usable(spark, line):
    assert found(spark, line) == []


def test_lone_sense_escapes_and_long_lines(spark):
    assert found(spark, '{"senses": {"glosses": "\\ud800 x"}}') == [(0, 0, "gloss", 0)]
    long = json.dumps({"senses": [{"glosses": ["g" * 50] * 60_000}]})
    assert len(found(spark, long)) == 60_000


def test_deep_nesting_is_no_crash(spark):
    assert found(spark, '{"a":' + "[" * 200_000 + "]" * 200_000 + "}") == []


def test_repeated_rows_clashing_columns_and_empty_table(spark):
    line = json.dumps({"senses": [{"tags": ["t"]}]})
    df = spark.createDataFrame([(1, line, "x"), (1, line, "y"), (None, line, "z")], "line_no long, line string, payload string")
    assert [tuple(r)[:4] for r in items(flatten_entries(df)).collect()] == [(1, 0, "tag", 0)] * 2
    assert items(flatten_entries(df.limit(0))).count() == 0


def test_flat_tables_link_to_parents(spark, tmp_path):
    line = json.dumps({"word": "run", "pos": "verb", "lang": 5, "senses": [SENSE, {"glosses": ["c"]}]})
    df = spark.createDataFrame([(7, line)], "line_no long, line string")
    write_tables(flatten_entries(df), str(tmp_path / "t"))
    entry = read_table(spark, str(tmp_path / "t"), "entry").first()
    assert (entry.entry_id, entry.word, entry.pos, entry.lang) == ("7", "run", "verb", None)
    senses = read_table(spark, str(tmp_path / "t"), "sense").orderBy("sense_no").collect()
    assert [(s.parent_id, s.n_glosses, s.n_form_of) for s in senses] == [("7", 5, 1), ("7", 1, 0)]
    known = {s.sense_id for s in senses}
    for kind in ITEM_KINDS:
        rows = read_table(spark, str(tmp_path / "t"), kind).collect()
        assert rows and all(r.parent_id in known for r in rows)
    assert sorted(r.text for r in read_table(spark, str(tmp_path / "t"), "gloss").collect()) == ["a", "b", "c"]
