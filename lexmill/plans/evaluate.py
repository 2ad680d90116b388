"""Recall of search over cases: rank of the wanted word, or of a word of its synsets, among a query's top words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def synonym_forms(wordnet: DataFrame) -> DataFrame:
    """(word, form): lower-case lemmas that share a synset with a word, itself included. wordnet: rows of headword and
    synset."""
    lemmas = wordnet.filter("synset IS NOT NULL AND headword IS NOT NULL").select("synset", F.lower(F.translate("headword", "_", " ")).alias("form")).distinct()
    return lemmas.withColumnRenamed("form", "word").join(lemmas, "synset").select("word", "form").distinct()


def case_ranks(top_words: DataFrame, cases: DataFrame, forms: DataFrame) -> DataFrame:
    """case_id, source, exact_rank and synonym_rank. top_words: (case_id, rank, word), words lower case; cases: (case_id,
    source, word). A case without candidates has null ranks."""
    wanted = cases.select("case_id", "source", F.lower("word").alias("wanted"))
    hits = wanted.join(top_words, "case_id", "left")
    near = forms.select(F.col("word").alias("wanted"), F.col("form").alias("_form"), F.lit(True).alias("_near"))
    hits = hits.join(near, (hits["wanted"] == near["wanted"]) & (hits["word"] == near["_form"]), "left").drop(near["wanted"])
    exact = F.min(F.when(F.col("word") == F.col("wanted"), F.col("rank")))
    either = F.min(F.when((F.col("word") == F.col("wanted")) | F.col("_near"), F.col("rank")))
    return hits.groupBy("case_id", "source").agg(exact.alias("exact_rank"), either.alias("synonym_rank"))


def recall(ranks: DataFrame) -> DataFrame:
    """Cases, exact hits and exact-or-synonym hits of each source, and of all under a null source."""
    return ranks.rollup("source").agg(F.count("*").alias("cases"), F.count("exact_rank").alias("exact_hits"), F.count("synonym_rank").alias("either_hits"))
