"""Visually identical text brought to one form by a compiled longest-match transducer.

The mapping from sequences of code points is computed once from rules (widths, fonts, ligatures, spaces, invisible
characters) and lists of look-alike letters and of letters with overlaid marks. It is checked for conflicts and for being
idempotent, and compiled into an automaton. A text is rewritten in one pass over its grapheme clusters: each is
decomposed, the automaton replaces the longest sources from the left, and the result is composed. So marks count the same
whether they come apart or together, and syllables whether they are written in letters or as one. Joiners and variation
selectors stay where they change the look: in emoji and in scripts whose letters join. Spaces of any kind become plain
ones, one for one. Text in ASCII is its own canonical form and passes through untouched.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts that look like a Latin letter, with that letter.
LOOK_ALIKES = {
    # Cyrillic, lower case
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q",
    "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    # Cyrillic, upper case
    "А": "A", "В": "B", "С": "C", "Ԁ": "D", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "Ӏ": "L", "М": "M",
    "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y", "Ү": "Y", "Һ": "H",
    # Greek
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Armenian
    "հ": "h", "ո": "n", "օ": "o", "զ": "q", "ս": "u", "ց": "g", "Օ": "O", "Ս": "U",
    # Latin letters and signs outside ASCII
    "ɑ": "a", "ɡ": "g", "ı": "i", "ǀ": "l", "ʏ": "y", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z",
    "‐": "-",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮢ": "R",
    "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮍ": "Y", "Ꮓ": "Z",
    # Coptic
    "Ⲃ": "B", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X",
    "ⲟ": "o", "ⲣ": "p", "ⲥ": "c", "ⲭ": "x",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S",
    "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
}
# A letter with an overlaid mark, or with a dot that it has anyway, and the letter that looks the same.
OVERLAID = {
    "o\u0338": "ø", "O\u0338": "Ø", "o\u0337": "ø", "O\u0337": "Ø", "l\u0335": "ł", "L\u0335": "Ł", "l\u0337": "ł", "L\u0337": "Ł", "d\u0335": "đ", "D\u0335": "Đ",
    "h\u0335": "ħ", "H\u0335": "Ħ", "t\u0335": "ŧ", "T\u0335": "Ŧ", "b\u0335": "ƀ", "i\u0307": "i", "j\u0307": "j", "ı\u0307": "i", "ȷ\u0307": "j",
}

#: compatibility tags whose characters look like what they stand for
SAME_LOOK_TAGS = ("<wide>", "<narrow>", "<font>", "<noBreak>")
#: first and last code points of compatibility characters that look like their letters: roman numerals, Latin ligatures,
#: digraph letters
SAME_LOOK_RANGES = ((0x2160, 0x217F), (0xFB00, 0xFB06), (0x01C7, 0x01CC), (0x01F1, 0x01F3))
#: invisible characters that aren't of the format category
INVISIBLE_RANGES = ((0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF))
#: format characters that are seen: number signs of Arabic and others, layout of hieroglyphs
SEEN_RANGES = ((0x0600, 0x0605), (0x06DD, 0x06DD), (0x070F, 0x070F), (0x0890, 0x0891), (0x08E2, 0x08E2), (0x110BD, 0x110BD), (0x110CD, 0x110CD), (0x13430, 0x1345F))
#: joiners, variation selectors and tags, which stay after a letter of a joining script or an emoji
CONTEXT_RANGES = ((0x200C, 0x200D), (0xFE00, 0xFE0F), (0xE0020, 0xE007F), (0xE0100, 0xE01EF), (0x180B, 0x180F))
LAST_CODE_POINT = 0x1FFFF
TAIL_CODE_POINTS = range(0xE0000, 0xE0200)
_KEEPS_CONTEXT = regex.compile(r"[\p{Extended_Pictographic}\p{Regional_Indicator}\p{Script=Arabic}\p{Script=Syriac}\p{Script=Mongolian}\p{Script=Nko}\p{Script=Devanagari}\p{Script=Bengali}\p{Script=Gurmukhi}\p{Script=Gujarati}\p{Script=Oriya}\p{Script=Tamil}\p{Script=Telugu}\p{Script=Kannada}\p{Script=Malayalam}\p{Script=Sinhala}\p{Script=Khmer}\p{Script=Han}]")


class MappingConflict(ValueError):
    """Two rules map one character to different texts, or a target isn't its own canonical form."""


def _within(ranges: tuple, code: int) -> bool:
    return any(a <= code <= b for a, b in ranges)


def rule_target(ch: str) -> str | None:
    """What the rules make of one character; None where they leave it."""
    code, category = ord(ch), unicodedata.category(ch)
    if code < 0x80:
        return None
    if (category == "Cf" and not _within(SEEN_RANGES, code)) or _within(INVISIBLE_RANGES, code):
        return ""
    if category in ("Zs", "Zl", "Zp") or code == 0x85:
        return " "
    tag = unicodedata.decomposition(ch).split(" ")[0]
    if tag in SAME_LOOK_TAGS or (tag == "<compat>" and _within(SAME_LOOK_RANGES, code)):
        return unicodedata.normalize("NFKD", ch)
    return None


def build_mapping(pairs: list[tuple[str, str]]) -> dict[str, str]:
    """One target for each source, both decomposed. Raises MappingConflict on two targets for a source, or on a target
    that the mapping itself would change, so that applying it twice equals applying it once."""
    mapping: dict[str, str] = {}
    for source, target in pairs:
        source, target = unicodedata.normalize("NFD", source), unicodedata.normalize("NFD", target)
        if mapping.setdefault(source, target) != target:
            raise MappingConflict(f"{source!r}: {mapping[source]!r} and {target!r}")
    automaton = Automaton(mapping)
    mapping = {source: automaton(target) for source, target in mapping.items()}
    automaton = Automaton(mapping)
    for source, target in mapping.items():
        if automaton(target) != target:
            raise MappingConflict(f"{source!r} leads to {target!r}, which isn't canonical")
    return mapping


class Automaton:
    """A trie of the sources: state 0 is the start, next_ has the transitions of each state and out what is written for
    the source that ends there, or None."""

    def __init__(self, mapping: dict[str, str]):
        self.next_: list[dict[str, int]] = [{}]
        self.out: list[str | None] = [None]
        for source, target in mapping.items():
            state = 0
            for c in source:
                state = self.next_[state].setdefault(c, len(self.next_))
                if state == len(self.next_):
                    self.next_.append({})
                    self.out.append(None)
            self.out[state] = target

    def __call__(self, text: str) -> str:
        """The longest source from each place on replaced, other code points copied."""
        written, at = [], 0
        while at < len(text):
            state, end, target, look = 0, at + 1, text[at], at
            while look < len(text) and (state := self.next_[state].get(text[look], -1)) >= 0:
                look += 1
                if self.out[state] is not None:
                    end, target = look, self.out[state]
            written.append(target)
            at = end
        return "".join(written)


@lru_cache(maxsize=1)
def standard_mapping() -> dict[str, str]:
    codes = [*range(0x80, LAST_CODE_POINT + 1), *TAIL_CODE_POINTS]
    by_rule = [(c, t) for c in map(chr, codes) if (t := rule_target(c)) is not None]
    return build_mapping([*by_rule, *LOOK_ALIKES.items(), *OVERLAID.items()])


class Transducer:
    """The automaton over grapheme clusters. A cluster goes on over invisible characters among which its marks hide."""

    def __init__(self, mapping: dict[str, str]):
        self.anywhere = Automaton(mapping)
        self.joining = Automaton({s: t for s, t in mapping.items() if not (len(s) == 1 and _within(CONTEXT_RANGES, ord(s)))})
        invisible = "".join(regex.escape(s) for s, t in mapping.items() if t == "" and len(s) == 1)
        self.pattern = regex.compile(rf"[ -~]+(?=[ -~])|\X(?:[{invisible}]+\p{{M}}\X?)*" if invisible else r"[ -~]+(?=[ -~])|\X")
        self.memo: dict[str, str] = {}

    def cluster(self, match: regex.Match) -> str:
        found = match.group()
        if found.isascii():
            return found
        target = self.memo.get(found)
        if target is None:
            automaton = self.joining if _KEEPS_CONTEXT.match(found) else self.anywhere
            target = unicodedata.normalize("NFC", automaton(unicodedata.normalize("NFD", found)))
            if len(self.memo) < 50_000:
                self.memo[found] = target
        return target

    def __call__(self, text: str) -> str:
        return text if text.isascii() else self.pattern.sub(self.cluster, text)


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    return Transducer(standard_mapping())


def canonical_texts(texts: pa.Array) -> pa.Array:
    """The canonical form of each text; null for null. Each distinct text of a batch is rewritten once, and only if it
    has characters outside ASCII."""
    if pc.all(pc.string_is_ascii(texts)).as_py() is not False:
        return texts
    apply = transducer()
    return pa.array([t if t is None else apply(t) for t in texts.to_pylist()], pa.string())


def with_canonical(df: DataFrame, text: str, into: str = "canonical") -> DataFrame:
    """df with the canonical form of a text column. A null text stays null and an empty one empty; a text of any length
    is rewritten whole; repeated rows stay. If df has a column of the new name, it is replaced."""
    kept = df.drop(into)
    schema = T.StructType([*kept.schema.fields, T.StructField(into, T.StringType())])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, canonical_texts(texts)], names=[*batch.schema.names, into])

    return kept.mapInArrow(rewrite, schema)


def comparison_form(text: Column) -> Column:
    """Without letter case and without ASCII white space at the ends or repeated."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\x0B\f\r]+", " "))


def look_alike_rows(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(origin, row_key, word_id): rows of words(origin, row_key, text) whose text looks the same as a vocabulary word but
    is another string, case and ASCII white space aside.

    Null texts never match; a row that looks like several words yields a row for each. Only the canonical form and the
    keys are shuffled, rows that are in ASCII and equal a word's canonical form drop out before the join only if they
    can't match: an ASCII text is its own form, so it is kept for words that are written with look-alikes.
    """
    forms = with_canonical(words.filter("text IS NOT NULL").select("origin", "row_key", "text"), "text")
    forms = forms.select("origin", "row_key", comparison_form(F.col("text")).alias("own"), comparison_form(F.col("canonical")).alias("form"))
    known = with_canonical(vocabulary.filter("word IS NOT NULL").select("word_id", "word"), "word")
    known = known.select("word_id", comparison_form(F.col("word")).alias("word_own"), comparison_form(F.col("canonical")).alias("form"))
    return forms.join(known, "form").filter("own != word_own").select("origin", "row_key", "word_id")
