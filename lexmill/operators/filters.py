"""Predicates on senses: category and pronunciation."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.phonetics import SOUNDS_LIKE_THRESHOLD, phoneme_distance

# Categories, and the tags and parts of speech that make two of them.
CATEGORIES = ("all", "noun", "adjective", "verb", "adverb", "idiom_slang", "old")
OLD_TAGS = ("archaic", "dated", "obsolete", "historical")
IDIOM_SLANG_TAGS = ("idiomatic", "slang", "vulgar", "colloquial")
IDIOM_SLANG_POS = ("phrase", "proverb")


def any_tag(tags: Column, wanted: tuple[str, ...]) -> Column:
    return F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, wanted))), F.lit(False))


def check_category(category: str | None) -> None:
    if category and category not in CATEGORIES:
        raise ValueError(f"unknown category: {category!r}")


def category_predicate(category: str | None, pos: Column, tags: Column) -> Column:
    """None and "all" keep every sense; null tags count as none."""
    check_category(category)
    if not category or category == "all":
        return F.lit(True)
    if category == "idiom_slang":
        return F.coalesce(pos.isin(*IDIOM_SLANG_POS), F.lit(False)) | any_tag(tags, IDIOM_SLANG_TAGS)
    if category == "old":
        return any_tag(tags, OLD_TAGS)
    return F.coalesce(pos == category, F.lit(False))


def phonetic_predicate(phonetics: Column, syllables: int | None = None, primary_vowel: str | None = None, rhyme_key: str | None = None, phonemes: list[str] | None = None, meter: str | None = None) -> Column:
    """All of the active filters. 0 syllables is a filter, while empty values of the others are none; a sense without
    phonetics fails any active filter."""
    checks = []
    if syllables is not None:
        checks.append(phonetics["syllable_count"] == syllables)
    if primary_vowel:
        checks.append(phonetics["primary_vowel"] == primary_vowel.upper())
    if rhyme_key:
        checks.append(phonetics["rhyme_key"] == rhyme_key)
    if phonemes:
        checks.append(phoneme_distance(phonetics["phonemes"], phonemes) <= SOUNDS_LIKE_THRESHOLD)
    if meter:
        checks.append(phonetics["meter"] == meter)
    return reduce(and_, (F.coalesce(c, F.lit(False)) for c in checks), F.lit(True))


def exclude_headword(headword_lc: Column, word: str | None) -> Column:
    return F.lit(True) if word is None else headword_lc != word.lower()
