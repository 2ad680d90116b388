import pytest
from pyspark.sql import functions as F

from lexmill.llm import copies
from lexmill.llm.queries import p4_counts
from tests.llm.test_copies import SHAPE

ROWS = [(1, "a", "n", "x; y", "s"), (2, "A", "n", "y; x", "s"), (3, "b", "n", "x", "s")]


def test_counts(spark, tmp_path):
    spark.createDataFrame(ROWS, SHAPE).write.parquet(str(tmp_path / "metadata.parquet"))
    assert sorted(map(tuple, p4_counts(spark, str(tmp_path)).collect())) == [(1, 2), (3, 1)]


def test_a_collision_fails_the_counts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(copies, "fingerprint", lambda *_: F.lit(5).cast("long"))
    spark.createDataFrame(ROWS, SHAPE).write.parquet(str(tmp_path / "metadata.parquet"))
    with pytest.raises(Exception, match="collide"):
        p4_counts(spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
