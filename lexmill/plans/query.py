"""The query language: a line of text to the plan it asks for."""

from __future__ import annotations

from dataclasses import dataclass

MODES = ("meaning", "combined", "structural", "expand", "phrase_contains")
#: characters that make a line a pattern
_SPECIAL = frozenset("*?#@")


@dataclass(frozen=True)
class ParsedQuery:
    mode: str
    clauses: tuple[str, ...] = ()
    text: str = ""
    expand_target: str = ""
    phrase_word: str = ""


def split_clauses(text: str) -> tuple[str, ...]:
    return tuple(part.strip() for part in text.split(",") if part.strip())


def is_pattern(text: str) -> bool:
    return "//" in text or text[:1] in ("-", "+") or not _SPECIAL.isdisjoint(text)


def parse_query(raw: str) -> ParsedQuery:
    """The first form that fits: expand:abc, **word**, pattern:meaning, pattern, meaning."""
    line = raw.strip()
    head, colon, tail = line.partition(":")
    if colon and head.lower() == "expand":
        return ParsedQuery("expand", expand_target=tail.strip().lower())
    if len(line) > 4 and line.startswith("**") and line.endswith("**"):
        return ParsedQuery("phrase_contains", phrase_word=line[2:-2].strip().lower())
    if colon:
        if not head.strip():
            return ParsedQuery("meaning", text=tail.strip())
        return ParsedQuery("combined", clauses=split_clauses(head), text=tail.strip())
    if is_pattern(line):
        return ParsedQuery("structural", clauses=split_clauses(line))
    return ParsedQuery("meaning", text=line)
