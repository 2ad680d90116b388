"""Sources of the index: dictionary dumps, frequency and emotion lexicons, and the index itself."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill import schema
from lexmill.functions.text import strip_pos_suffix

# Years whose counts make a word's frequency, and names of parts of speech by code.
FIRST_YEAR, LAST_YEAR = 2010, 2019
NGRAM_WINDOW = (FIRST_YEAR, LAST_YEAR)
WORDNET_POS = {"n": "noun", "v": "verb", "a": "adjective", "s": "adjective", "r": "adverb"}
WIKTIONARY_POS = {"adj": "adjective", "adv": "adverb"}


def _mapped(values: dict[str, str], column: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(names, column), column)


def must_exist(path: str) -> str:
    """Inputs are never downloaded: a missing local file is named at once."""
    if not re.match("[A-Za-z][A-Za-z0-9+.-]+:", path) and not any(c in path for c in "*?[") and not Path(path).exists():
        raise FileNotFoundError(path)
    return path


# --- WordNet ---


def wordnet_senses(synsets: DataFrame, sentiment: DataFrame | None = None) -> DataFrame:
    """A row for each lemma of each synset(synset, pos, definition, examples, lemmas): underscores are spaces, synonyms
    are the other lemmas, an unknown part of speech stays as it is, and missing sentiment is null."""
    names = F.transform("lemmas", lambda x: F.translate(x, "_", " "))
    rows = synsets.select("synset", _mapped(WORDNET_POS, F.col("pos")).alias("pos"), "definition", "examples", names.alias("names"), F.posexplode(names).alias("lemma_no", "headword"))
    rows = rows.withColumn("synonyms", F.filter("names", lambda x: x != F.col("headword"))).drop("names").withColumn("source", F.lit("wordnet"))
    if sentiment is None:
        return rows.withColumn("sentiwordnet", F.lit(None).cast(schema.SENTIMENT))
    scores = sentiment.select("synset", F.struct("pos", "neg", "obj").alias("sentiwordnet"))
    return rows.join(scores, "synset", "left")


def read_wordnet(spark: SparkSession, path: str, sentiment_path: str | None = None) -> DataFrame:
    synsets = spark.read.schema(schema.WORDNET).json(must_exist(path))
    return wordnet_senses(synsets, spark.read.schema(schema.SENTIMENT_ROWS).json(must_exist(sentiment_path)) if sentiment_path else None)


# --- Wiktionary ---


def combine_glosses(glosses: Column) -> Column:
    """One gloss as it is; a hierarchy as "a; b; c." without the dots that ended its parts."""
    joined = F.concat(F.array_join(F.transform(glosses, lambda g: F.regexp_replace(g, r"\.+$", "")), "; "), F.lit("."))
    return F.when(F.size(glosses) == 1, glosses[0]).otherwise(joined)


def _list(value: Column, path: str) -> Column:
    """The values at a path as an array: those of a list, or a lone value; null if absent or JSON null."""
    lone = F.try_variant_get(value, path, "variant")
    lone = F.when(lone.isNotNull() & ~F.is_variant_null(lone), F.array(lone))
    return F.coalesce(F.try_variant_get(value, path, "array<variant>"), lone)


def _is_string(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def _strings(values: Column) -> Column:
    """The strings among the values."""
    return F.transform(F.filter(values, _is_string), lambda v: F.try_variant_get(v, "$", "string"))


def wiktionary_senses(lines: DataFrame, line: str = "line", carry: tuple[str, ...] = ()) -> DataFrame:
    """English senses with a gloss, apart from inflected and alternative forms.

    Lines that don't hold a JSON object, senses that aren't objects, and list members of another kind than expected
    count as absent; a lone value counts as a list of one. carry: other columns to keep.
    """
    # generated, so that filters on fields don't parse the line again
    entries = lines.select(*carry, F.explode(F.array(F.try_parse_json(line))).alias("e"))
    field = lambda name: F.try_variant_get("e", f"$.{name}", "string")
    entries = entries.filter((field("lang_code") == "en") & (field("word") != "") & (field("pos") != ""))
    senses = entries.select(*carry, field("word").alias("word"), field("pos").alias("pos"), F.posexplode(_list(F.col("e"), "$.senses")).alias("sense_no", "s"))
    none = F.array().cast("array<string>")
    tags, glosses = F.coalesce(_strings(_list(F.col("s"), "$.tags")), none), F.coalesce(_strings(_list(F.col("s"), "$.glosses")), none)
    texts = F.transform(_list(F.col("s"), "$.examples"), lambda x: F.try_variant_get(x, "$.text", "string"))
    rows = senses.select(*carry, "sense_no", "word", "pos", tags.alias("tags"), glosses.alias("glosses"), F.coalesce(F.filter(texts, lambda t: t != ""), none).alias("examples"), F.size(_list(F.col("s"), "$.form_of")).alias("forms"))
    kept = rows.filter(~F.array_contains("tags", "form-of") & ~F.array_contains("tags", "alt-of") & F.col("forms").isNull() & (F.size("glosses") > 0))
    return kept.select(*carry, "sense_no", F.col("word").alias("headword"), _mapped(WIKTIONARY_POS, F.col("pos")).alias("pos"), combine_glosses(F.col("glosses")).alias("definition"), "examples", F.lit("wiktionary").alias("source"), "tags")


def read_wiktionary(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """A dump of JSON lines, plain or gzip. Gzip can't be split, so its lines are spread before parsing."""
    lines = spark.read.text(must_exist(path)).select(F.col("value").alias("line")).filter(F.trim("line") != "")
    if path.endswith(".gz"):
        lines = lines.repartition(partitions or spark.sparkContext.defaultParallelism)
    return wiktionary_senses(lines)


# --- n-grams ---


def recent_count(year_counts: Column, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> Column:
    """Matches of the years in the window, from "year,matches,volumes" strings; malformed ones count nothing."""
    fields = F.transform(F.coalesce(year_counts, F.array().cast("array<string>")), lambda y: F.split(y, ","))
    good = F.filter(fields, lambda f: F.coalesce((F.size(f) == 3) & F.forall(f, lambda x: x.rlike("^[0-9]{1,18}$")), F.lit(False)))
    inside = F.filter(good, lambda f: f[0].cast("long").between(first, last))
    return F.aggregate(inside, F.lit(0).cast("long"), lambda a, f: a + f[1].cast("long"))


def word_counts(ngrams: DataFrame, vocabulary: DataFrame | None = None, token: str = "token", years: str = "year_counts", first: int = FIRST_YEAR, last: int = LAST_YEAR) -> DataFrame:
    """(word, n): recent counts of each lower-case word, tags stripped; words without recent matches are absent. With a
    vocabulary(word), only its words, found by a semi-join before anything is added up."""
    rows = ngrams.filter(F.col(token) != "").select(F.lower(strip_pos_suffix(F.col(token))).alias("word"), recent_count(F.col(years), first, last).alias("n"))
    if vocabulary is not None:
        rows = rows.join(vocabulary.select(F.lower("word").alias("word")).distinct(), "word", "left_semi")
    return rows.filter("n > 0").groupBy("word").agg(F.sum("n").alias("n"))


def zipf_scale(counts: DataFrame, total: int) -> DataFrame:
    """log10 of matches in a billion; rare words are negative."""
    return counts.select("word", F.log10(F.col("n") / F.lit(float(total)) * 1e9).alias("zipf"))


def read_ngrams(spark: SparkSession, path: str) -> DataFrame:
    """Lines of token and tab-separated year counts; lines without a tab are skipped."""
    lines = spark.read.text(must_exist(path)).filter(F.col("value").contains("\t"))
    fields = F.split("value", "\t")
    return lines.select(fields[0].alias("token"), F.slice(fields, 2, F.size(fields)).alias("year_counts"))


def corpus_total(spark: SparkSession, path: str, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> int:
    """Matches of the window's years in a totals file of tab-separated "year,matches,pages,volumes"."""
    items = spark.read.text(must_exist(path), wholetext=True).select(F.explode(F.split("value", r"[\t\n]")).alias("f")).filter(F.trim("f") != "")
    parts = F.split(F.trim("f"), ",")
    return items.filter(parts[0].cast("int").between(first, last)).agg(F.sum(parts[1].cast("long"))).first()[0] or 0


# --- lexicons and the index ---


def read_emotions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of word to labels, as (word, labels)."""
    text = spark.read.text(must_exist(path), wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("word", "labels"))


def read_frequency(spark: SparkSession, path: str | None) -> DataFrame:
    """(word, zipf); empty if there is none at the path, which may be of any file system."""
    if path is not None:
        try:
            return spark.read.schema(schema.FREQUENCY).parquet(path)
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
    return spark.createDataFrame([], schema.FREQUENCY)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Sense rows from Parquet, or from JSON lines with blank ones skipped and missing keys null."""
    if path.rstrip("/").endswith((".jsonl", ".json", ".jsonl.gz")):
        return spark.read.schema(schema.RECORD).json(must_exist(path))
    return spark.read.parquet(must_exist(path))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """(source, word, description) of evaluation files {"source", "cases": {word: description}}."""
    files = spark.read.schema("source STRING, cases MAP<STRING, STRING>").option("multiLine", True).json(must_exist(path))
    return files.select("source", F.explode("cases").alias("word", "description"))
