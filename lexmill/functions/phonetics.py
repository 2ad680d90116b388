"""Pronunciation: what derives from phonemes, and distances between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The vowels and consonants of the phoneme alphabet, and the largest distance of words that sound alike.
ARPABET_VOWELS = ("AA", "AE", "AH", "AO", "AW", "AY", "EH", "ER", "EY", "IH", "IY", "OW", "OY", "UH", "UW")
ARPABET_CONSONANTS = ("B", "CH", "D", "DH", "F", "G", "HH", "JH", "K", "L", "M", "N", "NG", "P", "R", "S", "SH", "T", "TH", "V", "W", "Y", "Z", "ZH")
SOUNDS_LIKE_THRESHOLD = 0.34

#: one ASCII letter for each phoneme, so that string distance is phoneme distance
PHONEME_CODES = {p: chr(0x41 + n) if n < 26 else chr(0x61 + n - 26) for n, p in enumerate((*ARPABET_VOWELS, *ARPABET_CONSONANTS))}


def strip_stress(phoneme: Column) -> Column:
    return F.regexp_replace(phoneme, "[012]+$", "")


def code(phonemes: Column) -> Column:
    """Phonemes as a string of one letter each; an unknown one is "?"."""
    codes = F.create_map(*[F.lit(x) for pair in PHONEME_CODES.items() for x in pair])
    return F.array_join(F.transform(phonemes, lambda p: F.coalesce(F.try_element_at(codes, strip_stress(p)), F.lit("?"))), "")


def code_of(phonemes: list[str]) -> str:
    return "".join(PHONEME_CODES.get(p.rstrip("012"), "?") for p in phonemes)


def phoneme_distance(phonemes: Column, target: list[str]) -> Column:
    """Edits over the length of the longer, stress aside; null without phonemes."""
    own = code(F.filter(phonemes, lambda p: p.isNotNull()))
    return F.when(F.size(phonemes) > 0, F.levenshtein(own, F.lit(code_of(target))) / F.greatest(F.length(own), F.lit(len(target)), F.lit(1)))


def primary_index(phonemes: Column) -> Column:
    """From 0: the first vowel with main stress, else the first vowel, else 0. Vowels are what bears a stress digit."""
    marked = F.array_position(F.transform(phonemes, lambda p: F.substring(p, -1, 1)), "1")
    vowel = F.array_position(F.transform(phonemes, lambda p: p.rlike("[0-9]$")), True)
    return F.when(marked > 0, marked - 1).when(vowel > 0, vowel - 1).otherwise(F.lit(0).cast("long"))


def derive(phonemes: Column, syllables: Column, primary: Column, secondary: Column) -> Column:
    """The phonetics of a resolved word; null without phonemes. primary and secondary are positions of syllables."""
    at = primary_index(phonemes)
    bare = F.transform(phonemes, strip_stress)
    tail = F.slice(bare, (at + 1).cast("int"), F.greatest(F.size(bare), F.lit(1)))
    stressed = lambda i: (i == primary) | F.coalesce(F.array_contains(secondary, i), F.lit(False))
    beats = F.when(syllables > 0, F.transform(F.sequence(F.lit(0), syllables - 1), lambda i: F.when(stressed(i), "/").otherwise("x"))).otherwise(F.array().cast("array<string>"))
    return F.when(
        F.size(phonemes) > 0,
        F.struct(
            syllables.cast("int").alias("syllable_count"),
            F.get(bare, at.cast("int")).alias("primary_vowel"),
            F.array_join(tail, " ").alias("rhyme_key"),
            F.array_join(beats, "").alias("meter"),
            phonemes.alias("phonemes"),
        ),
    )


def resolvable(word: Column) -> Column:
    """Words of one part: several or hyphenated ones have no pronunciation of their own."""
    return ~word.rlike("[ -]")


def mean_consonant_run(phonemes: Column) -> Column:
    """Average length of runs of consonants; 0 without any; null without phonemes."""
    shape = F.array_join(F.transform(phonemes, lambda p: F.when(p.rlike("[0-9]$"), "V").otherwise("C")), "")
    runs = F.filter(F.split(shape, "V+"), lambda r: r != "")
    consonants = F.length(F.regexp_replace(shape, "V", ""))
    return F.when(F.size(phonemes) > 0, F.when(F.size(runs) > 0, consonants / F.size(runs)).otherwise(F.lit(0.0)))
