"""What search asks of models, and deterministic defaults that need no download.

A model is anything with the method of its protocol. The defaults are arithmetic on words, so that results are the same
everywhere and SQL can repeat them.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: what a bi-encoder of this family expects before a query, and never before a passage.
QUERY_INSTRUCTION = "Represent this sentence for searching relevant passages: "


def format_query_text(query: str) -> str:
    return QUERY_INSTRUCTION + query


class Embedder(Protocol):
    dim: int

    def encode_passages(self, texts: list[str]) -> list[list[float]]: ...

    def encode_query(self, text: str) -> list[float]: ...


class Reranker(Protocol):
    def score(self, query: str | Column, definition: Column) -> Column: ...


class Classifier(Protocol):
    def label(self, definition: Column) -> Column: ...


class PhoneticResolver(Protocol):
    def resolve(self, word: str, pos: str) -> dict | None: ...


class StressMarker(Protocol):
    def mark(self, word: Column, pos: Column) -> Column: ...


class HashedEmbedder:
    """Words hashed into a vector of length one. Queries carry no instruction here: every word would count."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def _one(self, text: str | None) -> list[float]:
        vector = [0.0] * self.dim
        for word in re.findall(r"\w+", (text or "").lower()):
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
            vector[h % self.dim] += 1.0 if h >> 63 else -1.0
        length = math.sqrt(sum(x * x for x in vector))
        return [x / length for x in vector] if length else vector

    def encode_passages(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def encode_query(self, text: str) -> list[float]:
        return self._one(text)


class OverlapReranker:
    """Share of the query's distinct words that the definition has, times a scale."""

    def __init__(self, scale: float = 10.0):
        self.scale = scale

    def score(self, query: str | Column, definition: Column) -> Column:
        own = F.split(F.lower(F.coalesce(definition, F.lit(""))), "[^a-z0-9]+")
        if isinstance(query, str):
            words = sorted(set(re.findall(r"[a-z0-9]+", query.lower())))
            if not words:
                return F.lit(0.0)
            return F.size(F.array_intersect(own, F.array(*map(F.lit, words)))).cast("double") * self.scale / len(words)
        asked = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(query, F.lit(""))), "[^a-z0-9]+"), lambda w: w != ""))
        return F.when(F.size(asked) > 0, F.size(F.array_intersect(own, asked)).cast("double") * self.scale / F.size(asked)).otherwise(F.lit(0.0))


class TableResolver:
    """Phonetics from a table of resolved words; words of several parts have none."""

    def __init__(self, entries: dict[tuple[str, str], dict] | dict[str, dict]):
        self.entries = entries

    def resolve(self, word: str, pos: str) -> dict | None:
        if " " in word or "-" in word:
            return None
        return self.entries.get((word.lower(), pos)) or self.entries.get(word.lower())


class IndexResolver:
    """Phonetics of a word from the rows of an index that have any: those of the part of speech asked for first, then in
    row order. Words of several parts have none."""

    def __init__(self, senses: DataFrame):
        self.senses = senses

    def resolve(self, word: str, pos: str) -> dict | None:
        word = word.strip().lower()
        if not word or " " in word or "-" in word:
            return None
        known = self.senses.filter((F.col("headword_lc") == word) & F.col("phonetics").isNotNull() & (F.size("phonetics.phonemes") > 0))
        rows = known.orderBy(F.coalesce(F.col("pos") != pos, F.lit(True)), "row_id").select("phonetics").limit(1).collect()
        return rows[0]["phonetics"].asDict() if rows else None


def embed_definitions(texts: DataFrame, embedder: Embedder, text: str = "definition", into: str = "embedding") -> DataFrame:
    """Vectors of a column of distinct texts, in Arrow batches; the model is loaded once for a worker."""
    schema = T.StructType([*[f for f in texts.schema.fields if f.name != into], T.StructField(into, T.ArrayType(T.FloatType()))])

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = embedder.encode_passages(batch.column(batch.schema.get_field_index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*batch.schema.names, into])

    return texts.drop(into).mapInArrow(embed, schema)


def best_label(scores: Column) -> Column:
    """The label of the largest score in an array of (label, score), lower case."""
    return F.lower(F.get(F.array_sort(scores, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(0)), F.lit(0))["label"])


def classify_batches(classify: object) -> object:
    """A pandas UDF from a function of one text to a label or None."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else classify(t))

    return run
