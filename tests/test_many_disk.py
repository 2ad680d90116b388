import os

import __spark_entry__
from lexmill import session


def test_many_searches_write_no_more_than_they_read(spark, tmp_path):
    folder = str(tmp_path / "tables")
    os.symlink(__spark_entry__.SMOKE_DIR, folder)
    __spark_entry__.queries()["search_many"](spark, folder)
    written = {name: path for (_, source, name), path in session._WRITTEN.items() if source == folder}
    assert set(written) == {"embedded"}
    rows = spark.read.parquet(written["embedded"])
    assert not {"phonetics", "examples", "synonyms", "sentiwordnet"} & set(rows.columns)
    assert rows.filter("embedding IS NULL").count() == 0
