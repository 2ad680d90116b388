"""Emotion labels and polarity of senses, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The polarity of each emotion, and the labels that are sentiments rather than emotions.
EMOTION_POLARITY = {
    "joy": "positive",
    "trust": "positive",
    "anticipation": "positive",
    "anger": "negative",
    "disgust": "negative",
    "fear": "negative",
    "sadness": "negative",
    "surprise": "neutral",
}
SENTIMENTS = ("positive", "negative", "neutral")


def polarity_of_label(label: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in EMOTION_POLARITY.items() for x in pair])
    return F.when(label.isNotNull(), F.coalesce(F.try_element_at(known, label), F.lit("neutral")))


def polarity_from_scores(scores: Column) -> Column:
    """Null without scores."""
    pos, neg = scores["pos"], scores["neg"]
    return F.when(pos == neg, "neutral").when(pos > neg, "positive").when(pos < neg, "negative")


def specific_label(labels: Column) -> Column:
    """The alphabetically first label that is an emotion; null if none."""
    return F.array_min(F.array_except(labels, F.array(*map(F.lit, SENTIMENTS))))


def lexicon_polarity(labels: Column) -> Column:
    specific = specific_label(labels)
    return (
        F.when(labels.isNull(), F.lit(None).cast("string"))
        .when(specific.isNotNull(), polarity_of_label(specific))
        .when(F.array_contains(labels, "positive"), "positive")
        .when(F.array_contains(labels, "negative"), "negative")
        .otherwise("neutral")
    )


def emotion_columns(source: Column, scores: Column, labels: Column, classified: Column | None = None) -> dict[str, Column]:
    """label, polarity and emotion_source. classified: what a classifier said, or null; it counts only where the
    lexicon names no emotion."""
    none = F.lit(None).cast("string")
    specific = specific_label(labels)
    guess = F.when(specific.isNull(), classified) if classified is not None else none
    from_scores = F.when(source == "wordnet", polarity_from_scores(scores))
    from_scores = F.nullif(from_scores, F.lit("neutral"))
    from_lexicon = F.nullif(lexicon_polarity(labels), F.lit("neutral"))
    polarity = F.coalesce(from_scores, from_lexicon, polarity_of_label(guess), F.lit("neutral"))
    origin = (
        F.when(specific.isNotNull(), "emolex")
        .when(guess.isNotNull(), "classifier")
        .when(from_scores.isNotNull(), "sentiwordnet")
        .when(from_lexicon.isNotNull(), "emolex")
        .otherwise("none")
    )
    return {"label": F.coalesce(specific, guess, polarity), "polarity": polarity, "emotion_source": origin}
