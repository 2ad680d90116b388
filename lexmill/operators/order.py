"""Sort orders of a result. Sorting permutes the rows that a limit has chosen; pos, their rank in the result, settles
ties, so every order is stable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.phonetics import mean_consonant_run
from lexmill.operators.filters import OLD_TAGS, any_tag

# The sort orders, and the tags of informal registers.
SORT_MODES = (
    "relevance",
    "alpha",
    "alpha_desc",
    "shortest",
    "longest",
    "most_common",
    "least_common",
    "most_formal",
    "oldest",
    "most_modern",
    "most_lyrical",
)
INFORMAL_TAGS = ("slang", "vulgar", "colloquial", "idiomatic", "informal")


def check_sort(mode: str | None) -> None:
    if mode and mode not in SORT_MODES:
        raise ValueError(f"unknown sort mode: {mode!r}")


def sort_keys(mode: str | None) -> list[Column]:
    """Of rows with headword, zipf, tags, phonetics and pos."""
    check_sort(mode)
    word, pos, zipf = F.lower("headword"), F.col("pos_in_result"), F.coalesce("zipf", F.lit(0.0))
    tags = F.col("tags")
    old = any_tag(tags, OLD_TAGS).cast("int")
    formal = F.coalesce(F.array_contains(tags, "formal"), F.lit(False))
    register = F.when(formal, 0).when(any_tag(tags, INFORMAL_TAGS), 2).otherwise(1)
    lyrical = F.coalesce(mean_consonant_run(F.col("phonetics.phonemes")), F.lit(float("inf")))
    keys = {
        "relevance": [],
        "alpha": [word],
        "alpha_desc": [word.desc()],
        "shortest": [F.length("headword"), word],
        "longest": [F.length("headword").desc(), word],
        "most_common": [zipf.desc(), word],
        "least_common": [zipf, word],
        "most_formal": [register],
        "oldest": [1 - old],
        "most_modern": [old],
        "most_lyrical": [lyrical],
    }[mode or "relevance"]
    return [*keys, pos]


def ranked(result: DataFrame, mode: str | None) -> DataFrame:
    """The rows of one bounded result with their rank from 1 under the mode."""
    return result.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*sort_keys(mode))))
