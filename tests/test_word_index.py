from lexmill.sources.sinks import read_index, read_word_index, write_index


def test_the_word_index_is_written_and_read(spark, tmp_path):
    senses = spark.createDataFrame([(0, "Bird", "bird"), (1, "blue", "blue"), (2, "bird", "bird"), (3, None, None)], "row_id long, headword string, headword_lc string")
    frequency = spark.createDataFrame([("bird", 4.0)], "word string, zipf double")
    write_index(senses, frequency, str(tmp_path), buckets=2)
    assert read_index(spark, str(tmp_path)).count() == 4
    assert {tuple(r) for r in read_word_index(spark, str(tmp_path)).collect()} == {("bird", 0, 2), ("blue", 1, 1)}
