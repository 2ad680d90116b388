"""Queries of the training-data operators and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import strip_pos_suffix
from lexmill.llm import copies, linkage, lookalike, mixing, neighbours, splitting, tokens
from lexmill.operators import vectors
from lexmill.session import cut_lineage, spread, table


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(*columns))


def p1_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.match(spread(table(spark, sf_dir, "metadata").select("row_id", "source", "headword", "definition", "pos")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_matches(spark, sf_dir).select("row_id_a", "row_id_b")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = table(spark, sf_dir, "metadata").select(F.lit("metadata").alias("origin"), F.col("row_id").alias("row_key"), F.col("headword").alias("text"))
    tokens = table(spark, sf_dir, "ngram_counts").select(F.lit("ngram_counts").alias("origin"), F.col("ngram_id").alias("row_key"), strip_pos_suffix(F.col("token")).alias("text"))
    return lookalike.look_alike_rows(heads.unionByName(tokens), table(spark, sf_dir, "vocabulary"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.members(table(spark, sf_dir, "metadata"))


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.verified(table(spark, sf_dir, "metadata"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.nearest(table(spark, sf_dir, "sense_embeddings"))
    return found.select(F.col("id").alias("row_id"), "neighbour_id")


def p5_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """queries, pairs (of each and its 10 exact neighbours) and whether p5_found has 0.9 of them, for the vectors whose id
    is divisible by 20 against all."""
    rows = vectors.usable(table(spark, sf_dir, "sense_embeddings"), "row_id", "embedding", neighbours.DIM)
    exact = vectors.batch_top_k(rows.filter(F.col("key") % 20 == 0), rows, neighbours.K, neighbours.DIM)
    found = p5_found(spark, sf_dir).filter(F.col("row_id") % 20 == 0).select(F.col("row_id").alias("query_id"), F.col("neighbour_id").alias("key"), F.lit(1).alias("hit"))
    both = exact.join(found, ["query_id", "key"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("pairs"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_texts(_documents(spark, sf_dir, "doc_id", "text"))


def _sizes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, sf_dir, "mix_targets")
    return mixing.counted(_documents(spark, sf_dir, "doc_id", "source", "text"), targets), targets


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.short_sources(*_sizes(spark, sf_dir))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, targets = _sizes(spark, sf_dir)
    return mixing.mix(cut_lineage(sizes), targets)


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, targets = _sizes(spark, sf_dir)
    sizes = cut_lineage(sizes)
    return mixing.reached(mixing.mix(sizes, targets), mixing.source_totals(sizes, targets))


def p7_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's exponents by target and by repetition limit, and its tempered share at the common exponent."""
    sources = mixing.read_sources(mixing.source_totals(*_sizes(spark, sf_dir)))
    exponent, shares = mixing.tempered_shares(sources)
    near = lambda x: None if x is None else round(x, 6)
    rows = [(w.source, near(w.exponent), near(w.limit_exponent), round(w.share, 6), w.short, round(exponent, 6), round(shares[w.source], 6)) for w in mixing.weights(sources)]
    return spark.createDataFrame(rows, "source string, exponent double, limit_exponent double, share double, short boolean, common_exponent double, tempered_share double")


def p7_tempered_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, targets = _sizes(spark, sf_dir)
    return mixing.mix(cut_lineage(sizes), targets, tempering=True)


def p7_tempered_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, targets = _sizes(spark, sf_dir)
    sizes = cut_lineage(sizes)
    return mixing.reached(mixing.mix(sizes, targets, tempering=True), mixing.source_totals(sizes, targets))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.oversized(_documents(spark, sf_dir, "doc_id", "text"))


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_texts(_documents(spark, sf_dir, "doc_id", "text"))


_BAG = r"list_sort(list_filter(string_split(regexp_replace(lower(definition), '[^\p{L}\p{N};]+', '', 'g'), ';'), lambda g: g <> ''))"
_COPIES = rf"""
SELECT min(row_id) OVER w AS first_row_id, row_id, count(*) OVER w AS copies
FROM (SELECT row_id, source, pos, regexp_replace(lower(headword), '[^\p{{L}}\p{{N}}]+', '', 'g') AS hw, {_BAG} AS bag FROM metadata)
WHERE hw <> '' AND len(bag) > 0
WINDOW w AS (PARTITION BY source, pos, hw, bag)
"""

QUERIES = {"p1_found": p1_found, "p1_matches": p1_matches, "p5_found": p5_found, "p5_recall": p5_recall, "p3_found": p3_found, "p4_found": p4_found, "p4_counts": p4_counts, "p6_ids": p6_ids, "p7_found": p7_found, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_weights": p7_weights, "p7_tempered_mix": p7_tempered_mix, "p7_tempered_shares": p7_tempered_shares, "p8_found": p8_found, "p8_pieces": p8_pieces}
_VECTORS = "(SELECT row_id, embedding::DOUBLE[] AS vec FROM sense_embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL)) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"

SQL = {
    "p5_recall": f"""SELECT count(DISTINCT query_id) AS queries, count(*) AS pairs, true AS enough FROM (SELECT a.row_id AS query_id, row_number() OVER (PARTITION BY a.row_id ORDER BY round(list_cosine_similarity(a.vec, b.vec), 6) DESC, b.row_id) AS n
 FROM {_VECTORS} a JOIN {_VECTORS} b ON a.row_id % 20 = 0 AND a.row_id <> b.row_id) WHERE n <= 10""",
    "p4_found": f"SELECT first_row_id, row_id FROM ({_COPIES}) WHERE row_id <> first_row_id",
    "p4_counts": f"SELECT first_row_id, copies FROM ({_COPIES}) WHERE row_id = first_row_id",
}
