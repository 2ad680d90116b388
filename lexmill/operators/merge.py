"""Two dictionaries merged into one, and lookups that enrich the merged records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import normalise_space_case


def merge_keys(headword: Column, definition: Column) -> list[Column]:
    return [normalise_space_case(F.coalesce(headword, F.lit(""))).alias("_h"), normalise_space_case(F.coalesce(definition, F.lit(""))).alias("_d")]


def merge_records(first: DataFrame, second: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """All records of the first source, then those of the second whose headword and definition, case and white space
    aside, neither the first source has nor an earlier record of the second.

    The earliest record of a key is found by an aggregation of ordinals, which combines before the shuffle, so a record
    delivered a million times costs its key one row for each input partition.
    """
    keyed = second.select("*", *merge_keys(F.col("headword"), F.col("definition")))
    known = first.select(*merge_keys(F.col("headword"), F.col("definition"))).distinct()
    earliest = second.select(*merge_keys(F.col("headword"), F.col("definition")), ordinal).groupBy("_h", "_d").agg(F.min(ordinal).alias("_o"))
    fresh = earliest.join(known, ["_h", "_d"], "left_anti").select("_h", "_d", "_o")
    survivors = keyed.join(fresh, (keyed["_h"] == fresh["_h"]) & (keyed["_d"] == fresh["_d"]) & (keyed[ordinal] == fresh["_o"]), "left_semi")
    return first.withColumn("source_rank", F.lit(0)).unionByName(survivors.drop("_h", "_d").withColumn("source_rank", F.lit(1)), allowMissingColumns=True)


def with_emotions(records: DataFrame, lexicon: DataFrame, into: str = "emolex") -> DataFrame:
    """Left lookup of the lower-case headword in the emotion lexicon."""
    return records.drop(into).join(lexicon.select(F.col("word").alias("_w"), F.col("labels").alias(into)), F.lower("headword") == F.col("_w"), "left").drop("_w")


def with_frequency(records: DataFrame, frequency: DataFrame, into: str = "zipf") -> DataFrame:
    return records.drop(into).join(frequency.select(F.col("word").alias("_w"), F.col("zipf").alias(into)), F.lower("headword") == F.col("_w"), "left").drop("_w")


def first_spellings(records: DataFrame, ordinal: str = "row_id") -> DataFrame:
    """Each distinct lower-case headword and part of speech with the spelling seen first: what a resolver is asked."""
    return records.groupBy(F.lower("headword").alias("headword_lc"), "pos").agg(F.min_by("headword", ordinal).alias("spelling"))


def headwords(senses: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Each lower-case headword with its first row and number of rows: the word index as a relation. A headword's rows
    are found by its key in the sense table, so that no list grows with a hot headword."""
    return senses.filter(F.col("headword").isNotNull()).groupBy(F.lower("headword").alias("headword_lc")).agg(F.min(row_id).alias("first_row"), F.count("*").alias("n_rows"))


#: row ids that one list of a key may span
LIST_SPAN = 100_000


def row_lists(senses: DataFrame, key: Column, name: str, row_id: str = "row_id", span: int = LIST_SPAN) -> DataFrame:
    """(key, block, ids): the rows of each key in order. Ids are listed by blocks of span, so no list grows with a hot
    key; the blocks of a key in their order are its whole list."""
    rows = senses.select(key.alias(name), F.floor(F.col(row_id) / span).cast("long").alias("block"), F.col(row_id).alias("_id"))
    return rows.groupBy(name, "block").agg(F.array_sort(F.collect_list("_id")).alias("ids"))


def unique_definitions(senses: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Each distinct definition with its first row and number of rows: what an embedder is asked once."""
    return senses.groupBy("definition").agg(F.min(row_id).alias("first_row"), F.count("*").alias("n_rows"))
