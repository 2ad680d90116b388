"""Building the index: merge, enrich, number, embed, write."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill import schema
from lexmill.functions.models import Embedder, PhoneticResolver, embed_definitions
from lexmill.functions.score import norm
from lexmill.operators.merge import first_spellings, headwords, merge_records, unique_definitions, with_emotions, with_frequency
from lexmill.session import written_table
from lexmill.sources.sinks import write_index


#: bits of monotonically_increasing_id that count rows within a partition
_ROW_BITS = 33


def number_rows(records: DataFrame) -> DataFrame:
    """row_id in the order of source_rank and ordinal, from 0, without gaps.

    A range sort is written once with each row's partition and place in it; the place plus the rows of all earlier
    partitions is the number. The driver sees one count for each partition.
    """
    ordered = records.repartitionByRange("source_rank", "ordinal").sortWithinPartitions("source_rank", "ordinal")
    place = F.monotonically_increasing_id()
    kept = written_table(ordered.withColumn("_part", F.spark_partition_id()).withColumn("_at", place.bitwiseAND(F.lit((1 << _ROW_BITS) - 1))), "numbered")
    counts = sorted((r["_part"], r["n"]) for r in kept.groupBy("_part").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    offsets = records.sparkSession.createDataFrame(starts, "_part int, _start long")
    return kept.join(F.broadcast(offsets), "_part").withColumn("row_id", F.col("_start") + F.col("_at")).drop("_part", "_start", "_at")  # a row for each partition


def resolve_phonetics(senses: DataFrame, resolver: PhoneticResolver) -> DataFrame:
    """phonetics by (lower headword, part of speech), resolved once for each distinct pair in the spelling seen first."""
    asked = first_spellings(senses)
    out = f"headword_lc STRING, pos STRING, spelling STRING, phonetics {schema.PHONETICS}"

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [resolver.resolve(w, p) if w is not None else None for w, p in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            kind = pa.struct([("syllable_count", pa.int32()), ("primary_vowel", pa.string()), ("rhyme_key", pa.string()), ("meter", pa.string()), ("phonemes", pa.list_(pa.string()))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, "phonetics"])

    known = asked.mapInArrow(resolve, out).select("headword_lc", F.col("pos").alias("_pos"), "phonetics")
    keyed = senses.drop("phonetics").withColumn("headword_lc", F.lower("headword"))
    return keyed.join(known, (keyed["headword_lc"] == known["headword_lc"]) & keyed["pos"].eqNullSafe(known["_pos"]), "left").drop(known["headword_lc"]).drop("_pos")


def embed(senses: DataFrame, embedder: Embedder) -> DataFrame:
    """Each distinct definition is embedded once and joined back."""
    texts = unique_definitions(senses).select("definition")
    vectors = embed_definitions(texts, embedder).select(F.col("definition").alias("_d"), "embedding")
    return senses.join(vectors, senses["definition"].eqNullSafe(F.col("_d")), "left").drop("_d").withColumn("norm", norm(F.col("embedding")))


def estimate_seconds(sample_seconds: float, sample_rows: int, rows: int) -> float:
    """Linear in rows; 0 for an empty sample."""
    return sample_seconds / sample_rows * rows if sample_rows else 0.0


def measure_embedder(senses: DataFrame, embedder: Embedder, rows: int = 200, seed: int = 42) -> float:
    """Seconds to embed all distinct definitions, from a seeded sample of bounded size."""
    texts = unique_definitions(senses).select("definition")
    sample = [r[0] for r in texts.orderBy(F.xxhash64(F.lit(seed), "definition")).limit(rows).collect()]
    began = time.perf_counter()
    embedder.encode_passages(sample)
    return estimate_seconds(time.perf_counter() - began, len(sample), texts.count())


def enrich(records: DataFrame, frequency: DataFrame, emotions: DataFrame, resolver: PhoneticResolver | None) -> DataFrame:
    """Numbered records with emotion labels, frequency, phonetics and the mark of a headword's first sense."""
    senses = with_frequency(with_emotions(records, emotions), frequency)
    senses = resolve_phonetics(senses, resolver) if resolver else senses.withColumn("headword_lc", F.lower("headword")).withColumn("phonetics", F.lit(None).cast(schema.PHONETICS))
    firsts = headwords(senses).select(F.col("first_row").alias("_first"))
    senses = senses.join(firsts, senses["row_id"] == F.col("_first"), "left")
    return senses.withColumn("first", F.col("_first").isNotNull()).drop("_first").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def build_lexicon(first: DataFrame, second: DataFrame, frequency: DataFrame, emotions: DataFrame, out_dir: str, embedder: Embedder, resolver: PhoneticResolver | None = None) -> None:
    """first and second: records of the two dictionaries with an ordinal. Writes the index under out_dir."""
    merged = number_rows(merge_records(first, second))
    senses = embed(enrich(merged, frequency, emotions, resolver), embedder)
    write_index(senses.select(*schema.SENSE_COLUMNS), frequency, out_dir)
