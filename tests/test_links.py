import json

from pyspark.sql import functions as F

from lexmill.operators.nested import flatten_entries, links, write_tables
from lexmill.queries.nested import p2_links


def test_a_link_counts_where_the_parent_exists(spark, tmp_path):
    line = json.dumps({"word": "run", "senses": [{"glosses": ["a", "b"]}, {"tags": ["t"]}]})
    tagged = flatten_entries(spark.createDataFrame([(7, line), (8, line)], "line_no long, line string"))
    write_tables(tagged.filter(~((F.col("tag") == "sense") & (F.col("pk") == "8.0"))), str(tmp_path / "t"))
    got = {r.tag: (r.n_rows, r.n_linked, r.n_lines) for r in links(spark, str(tmp_path / "t")).collect()}
    assert got == {"entry": (2, 0, 2), "sense": (3, 3, 2), "gloss": (4, 2, 2), "tag": (2, 2, 2)}


def test_the_query_writes_the_tables(spark, tmp_path, monkeypatch):
    line = json.dumps({"senses": [{"glosses": ["a"]}]})
    spark.createDataFrame([(1, line)], "line_no long, line string").write.parquet(str(tmp_path / "wiktextract_raw.parquet"))
    monkeypatch.setattr("lexmill.queries.nested.shared_path", lambda *_: str(tmp_path / "out"), raising=False)
    assert {r.tag: r.n_linked for r in p2_links(spark, str(tmp_path)).collect()} == {"entry": 0, "sense": 1, "gloss": 1}
    assert (tmp_path / "out" / "tag=sense").is_dir()
