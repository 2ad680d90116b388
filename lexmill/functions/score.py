"""Scores and relevance."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

EPSILON = 1e-12


def norm(vector: Column) -> Column:
    """Length of a vector plus a hair, in double precision."""
    v = vector.cast("array<double>")
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)) + F.lit(EPSILON)


def dot(vector: Column, query: list[float]) -> Column:
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(vector.cast("array<double>"), q, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)


def cosine(vector: Column, query: list[float], stored_norm: Column | None = None) -> Column:
    """Cosine with a literal query vector; the row's norm is stored or computed."""
    length = sum(float(x) ** 2 for x in query) ** 0.5 + EPSILON
    unit = [float(x) / length for x in query]
    return dot(vector, unit) / (norm(vector) if stored_norm is None else stored_norm)


def combined_score(raw: Column, zipf: Column) -> Column:
    """The raw score plus the word's frequency; words without one, of one part or several, keep the raw score."""
    return raw + F.coalesce(zipf, F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def absolute_relevance(score: Column) -> Column:
    """0 to 100, rounded half to even."""
    return F.bround(sigmoid(score) * 100, 0).cast("int")


def relative_relevance(score: Column) -> Column:
    """0 to 100 between the smallest and the largest of the rows of a result; 50 if all are equal. The window holds the
    rows of one result, which a limit has bounded."""
    everything = Window.partitionBy(F.lit(1))
    low, high = F.min(score).over(everything), F.max(score).over(everything)
    return F.when(high == low, F.lit(50)).otherwise(F.bround((score - low) / F.nullif(high - low, F.lit(0.0)) * 100, 0)).cast("int")
