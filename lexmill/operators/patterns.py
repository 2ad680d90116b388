"""Predicates on headwords as column expressions, from clauses of the query language.

Shapes with a plain prefix, suffix, infix or no wildcard become string functions, which reach the Parquet scan; the rest
become one anchored regular expression, compiled once for a query.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.plans.query import ParsedQuery

# The letters of # and @ in patterns, and the words that initials leave out.
CONSONANTS = "bcdfghjklmnpqrstvwxyz"
VOWELS = "aeiou"
INITIALS_SKIP = ("and", "of", "the", "for", "a", "an", "&")

_WILD = {"*": ".*", "?": ".", "#": f"[{CONSONANTS}]", "@": f"[{VOWELS}]"}


#: a wildcard doesn't span lines, though a word may end with one
_INNER_LINE_END = "\n[\\s\\S]"


def wildcard_regex(clause: str) -> str:
    body = "".join(_WILD.get(c) or (c if c.isalnum() else "\\" + c) for c in clause)
    return f"(?iud)^{body}$"


def wildcard(word: Column, clause: str) -> Column:
    """* any run, ? any letter, # a consonant, @ a vowel; the whole word, without case. word is lower case. Null words give
    null."""
    clause = clause.lower()
    core = clause.strip("*")
    if core and not any(c in _WILD for c in core):
        opens, closes = clause.startswith("*"), clause.endswith("*")
        one_line = ~word.rlike(_INNER_LINE_END)
        if not opens and not closes:
            return word.isin(core, core + "\n")
        if opens and closes:
            return word.contains(core) & one_line
        return (word.endswith(core) | word.endswith(core + "\n") if opens else word.startswith(core)) & one_line
    return word.rlike(wildcard_regex(clause))


def letters(word: Column) -> Column:
    return F.filter(F.split(word, ""), lambda c: c != "")


def _literal(chars: str) -> Column:
    return F.array(*[F.lit(c) for c in sorted(set(chars))]) if chars else F.array().cast("array<string>")


def without_letters(word: Column, chars: str) -> Column:
    return F.size(F.array_intersect(letters(word), _literal(chars.lower()))) == 0


def only_letters(word: Column, chars: str) -> Column:
    return F.size(F.array_except(letters(word), _literal(chars.lower()))) == 0


def anagram(word: Column, chars: str) -> Column:
    """The same letters, each as often."""
    wanted = "".join(sorted(chars.lower()))
    return (F.length(word) == len(wanted)) & (F.array_join(F.array_sort(letters(word)), "") == wanted)


def clause_predicate(word: Column, clause: str) -> Column:
    if "//" in clause:
        return anagram(word, clause.strip("/"))
    if clause.startswith("-"):
        return without_letters(word, clause[1:])
    if clause.startswith("+"):
        return only_letters(word, clause[1:])
    return wildcard(word, clause)


def clauses_predicate(word: Column, clauses: tuple[str, ...]) -> Column:
    """All clauses; true for none."""
    return reduce(and_, (clause_predicate(word, c) for c in clauses), F.lit(True))


def tokens(word: Column) -> Column:
    return F.filter(F.split(word, r"(?U)\s+"), lambda t: t != "")


def initials_are(word: Column, target: str) -> Column:
    """At least two words, apart from small ones, whose first letters spell the target."""
    kept = F.filter(tokens(word), lambda t: ~t.isin(*INITIALS_SKIP))
    return (F.size(kept) >= 2) & (F.array_join(F.transform(kept, lambda t: F.substring(t, 1, 1)), "") == target.lower())


def phrase_contains(word: Column, part: str) -> Column:
    """Several words, one of which is the part."""
    return (F.size(tokens(word)) >= 2) & F.array_contains(tokens(word), part.lower())


def headword_predicate(word: Column, parsed: ParsedQuery) -> Column:
    """word: the lower-case headword."""
    if parsed.mode in ("structural", "combined"):
        return clauses_predicate(word, parsed.clauses)
    if parsed.mode == "expand":
        return initials_are(word, parsed.expand_target)
    if parsed.mode == "phrase_contains":
        return phrase_contains(word, parsed.phrase_word)
    raise ValueError(f"no headword predicate for mode {parsed.mode!r}")
