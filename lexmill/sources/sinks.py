"""Sinks: the index, result lines and previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators.merge import headwords

# The layout of a result line, and the words of previews.
EXACT_MARK, OTHER_MARK = "★", " "
LONGEST_GLOSS, CUT_GLOSS, ELLIPSIS = 70, 67, "..."
BETWEEN_LABELS = " · "
EXACT_TITLE, STRESS, EMOTION, CONFIDENCE, SYNONYMS = "Exact match — ", "Stress: ", "Emotion: ", "Match confidence: ", "Synonyms: "


def write_index(senses: DataFrame, frequency: DataFrame, path: str, buckets: int | None = None) -> None:
    """senses, the word index and frequencies as Parquet; buckets: files of senses, else as many as data ask for. Senses are range-partitioned and sorted by headword, so a
    lookup or a prefix reads the few row groups whose statistics hold it."""
    by = ("headword_lc", "row_id")
    spread = senses.repartitionByRange(buckets, *by) if buckets else senses.repartitionByRange(*by)
    spread = spread.sortWithinPartitions("headword_lc", "row_id")
    spread.write.mode("overwrite").parquet(f"{path}/senses")
    headwords(senses.sparkSession.read.schema(spread.schema).parquet(f"{path}/senses")).write.mode("overwrite").parquet(f"{path}/word_index")
    frequency.write.mode("overwrite").parquet(f"{path}/frequency")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/senses")


def read_word_index(spark: SparkSession, path: str) -> DataFrame:
    """headword_lc, first_row and n_rows of each headword."""
    return spark.read.parquet(f"{path}/word_index")


def short_gloss(definition: Column) -> Column:
    return F.when(F.length(definition) > LONGEST_GLOSS, F.concat(F.substring(definition, 1, CUT_GLOSS), F.lit(ELLIPSIS))).otherwise(definition)


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def result_line(index: Column) -> Column:
    """Six fields apart by tabs: mark and headword, part of speech and gloss, emotion, relevance, index, headword. Of
    rows with the columns of a flat result; index counts from 0 or is null for none."""
    mark = F.when(F.col("is_exact"), EXACT_MARK).otherwise(OTHER_MARK)
    return F.concat_ws(
        "\t",
        F.concat(mark, F.lit(" "), _text(F.col("headword"))),
        F.concat(F.lit("("), _text(F.col("pos")), F.lit(") "), _text(short_gloss(F.col("definition")))),
        F.concat(F.lit("["), F.col("label"), F.lit(BETWEEN_LABELS), F.col("polarity"), F.lit("]")),
        F.concat(_text(F.col("relevance")), F.lit("%")),
        _text(index),
        _text(F.col("headword")),
    )


def candidate_preview() -> Column:
    """Several lines on one candidate; lines without content are left out."""
    none = F.lit(None).cast("string")
    listed = F.when(F.size("synonyms") > 0, F.concat(F.lit(SYNONYMS), F.array_join("synonyms", ", ")))
    quoted = F.when(F.size("examples") > 0, F.concat(F.lit("\n"), F.array_join(F.transform("examples", lambda x: F.concat(F.lit('"'), x, F.lit('"'))), "\n")))
    return F.concat_ws(
        "\n",
        F.concat(_text(F.col("headword")), F.lit(" ("), _text(F.col("pos")), F.lit(")")),
        F.lit(""),
        _text(F.col("definition")),
        F.lit(""),
        F.coalesce(F.when(F.col("stress") != "", F.concat(F.lit(STRESS), F.col("stress"))), none),
        F.concat(F.lit(EMOTION), F.col("label"), F.lit(BETWEEN_LABELS), F.col("polarity")),
        F.concat(F.lit(CONFIDENCE), _text(F.col("relevance")), F.lit("%")),
        listed,
        quoted,
    )


def exact_preview(senses: Column, headword: str) -> Column:
    """Several lines on all senses of an exact match."""
    none = F.lit(None).cast("string")
    one = lambda s: F.concat_ws(
        "\n",
        F.concat(F.lit("("), _text(s["pos"]), F.lit(") "), _text(s["definition"])),
        F.coalesce(F.when(s["stress"] != "", F.concat(F.lit(STRESS), s["stress"])), none),
        F.concat(F.lit(EMOTION), s["label"], F.lit(BETWEEN_LABELS), s["polarity"]),
        F.when(F.size(s["synonyms"]) > 0, F.concat(F.lit(SYNONYMS), F.array_join(s["synonyms"], ", "))),
        F.when(F.size(s["examples"]) > 0, F.array_join(F.transform(s["examples"], lambda x: F.concat(F.lit('    "'), x, F.lit('"'))), "\n")),
        F.lit(""),
    )
    return F.concat(F.lit(f"{EXACT_TITLE}{headword}\n\n"), F.array_join(F.transform(senses, one), "\n"))


def static_table(rows: list[dict]) -> str:
    """A plain table of a bounded result, for a terminal."""
    names = ("#", "word", "pos", "definition", "stress", "emotion", "synonyms", "relevance")
    lines = [[str(n), r["headword"], r["pos"] or "", r["definition"] or "", r["stress"] or "", f"{r['label']}{BETWEEN_LABELS}{r['polarity']}", ", ".join(r["synonyms"] or []), f"{r['relevance']}%"] for n, r in enumerate(rows, 1)]
    widths = [max(len(x) for x in column) for column in zip(names, *lines, strict=True)]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(line, widths, strict=True)).rstrip() for line in [list(names), *lines])
