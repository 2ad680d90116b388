"""Scalar text cleaning as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Part-of-speech tags that may end an n-gram token.
NGRAM_TAGS = ("NOUN", "VERB", "ADJ", "ADV", "PRON", "DET", "ADP", "NUM", "CONJ", "PRT", "X")


def strip_pos_suffix(token: Column) -> Column:
    """The token without a trailing underscore and tag."""
    return F.regexp_replace(token, rf"_({'|'.join(NGRAM_TAGS)})[ \t\n\x0B\f\r]*$", "")


def normalise_space_case(text: Column) -> Column:
    """Lower case, runs of white space of any kind as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))
