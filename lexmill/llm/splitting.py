"""Oversized texts cut at natural boundaries into pieces of bounded size that overlap.

A text's tokens are counted word by word into prefix sums. The offsets at which a paragraph, line, sentence or word ends
are sorted arrays; each cut is the last boundary under the limit, found by binary search at the highest level that fills
enough of the piece, and a hard cut where no word ends in reach. The next piece starts a fixed overlap before the cut.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.tokens import DEFAULT_VOCABULARY, Tokenizer, in_slices, tokenizer

LIMIT = 1024
OVERLAP = 64
#: share of the limit that a cut above the level of words must fill
LEAST_FILL = 0.5
LEVELS = ("paragraph", "line", "sentence", "word")
_SENTENCE_END = regex.compile(r"""[.!?…。！？؟]["'”’»)\]]*\s*""")
_BLANK_LINE = regex.compile(r"(\r\n?|\n)[^\S\r\n]*(\r\n?|\n)")
_LINE_END = regex.compile(r"[\r\n\u2028\u2029]")


def boundaries(words: list[str], ends: list[int]) -> dict[str, list[int]]:
    """Sorted token offsets at which each level ends. A word that opens with white space begins after it, so what
    follows decides whether a full stop ends a sentence."""
    found: dict[str, list[int]] = {level: [] for level in LEVELS}
    found["word"] = ends
    for n, (word, end) in enumerate(zip(words, ends, strict=True)):
        if _LINE_END.search(word):
            found["line"].append(end)
            if _BLANK_LINE.search(word) or (n and words[n - 1].strip() == "" and _LINE_END.search(words[n - 1])):
                found["paragraph"].append(end)
        elif _SENTENCE_END.fullmatch(word.lstrip()) and (n + 1 == len(words) or words[n + 1][:1].isspace() or word.strip()[0] in "。！？؟"):
            found["sentence"].append(end)
    return found


def cut(total: int, found: dict[str, list[int]], limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(first token, end token, kind of cut) of each piece; consecutive pieces share exactly overlap tokens."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be smaller than limit")
    pieces, start = [], 0
    while total - start > limit:
        most = start + limit
        end, kind = most, "hard"
        for level in LEVELS:
            least = start + overlap if level == "word" else start + max(overlap, int(limit * LEAST_FILL))
            at = bisect_right(found[level], most) - 1
            if at >= 0 and found[level][at] > least:
                end, kind = found[level][at], level
                break
        pieces.append((start, end, kind))
        start = end - overlap
    pieces.append((start, total, "end"))
    return pieces


def split_text(own: Tokenizer, text: str, ids: list[list[int]], limit: int, overlap: int) -> list[tuple[int, int, str]]:
    words = own.split(text)
    ends = list(accumulate(map(len, ids)))
    total = ends[-1] if ends else 0
    return cut(total, boundaries(words, ends) if total > limit else {}, limit, overlap)


def split_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, only_oversized: bool = False, with_text: bool = True, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, piece_no, first_token, n_tokens, cut, text): every text in pieces of at most limit tokens.

    A null text has no piece and an empty one a single empty piece; a text within the limit is one piece, left out with
    only_oversized. A text of any length is split whole; repeated rows are split each. Texts of at most limit bytes
    can't hold more tokens, so with only_oversized they aren't read into Python. A hard cut may part the bytes of a
    character; its text then shows the replacement character, while the tokens stay exact. Narrow: no shuffle.
    """
    fields = [docs.schema[key], T.StructField("piece_no", T.IntegerType()), T.StructField("first_token", T.LongType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("cut", T.StringType())]
    if with_text:
        fields.append(T.StructField("text", T.StringType()))
    names = [f.name for f in fields]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string()]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(vocabulary)
        for part, texts in in_slices(batches, text):
            at: list[int] = []
            columns: list[list] = [[] for _ in types]
            for n, (one, ids) in enumerate(zip(texts, own.word_ids(texts), strict=True)):
                if one is None:
                    continue
                pieces = split_text(own, one, ids, limit, overlap)
                if only_oversized and len(pieces) == 1:
                    continue
                flat = [i for word in ids for i in word] if with_text else []
                for piece_no, (start, end, kind) in enumerate(pieces):
                    at.append(n)
                    row = (piece_no, start, end - start, kind, own.decode(flat[start:end]).decode("utf-8", "replace") if with_text else None)
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), *arrays][: len(names)], names=names)

    rows = docs.select(F.col(key), F.col(text).cast("string").alias(text)).filter(F.col(text).isNotNull())
    if only_oversized:
        rows = rows.filter(F.octet_length(text) > limit)
    return rows.mapInArrow(split, T.StructType(fields))


def oversized(docs: DataFrame, key: str = "doc_id", **options: object) -> DataFrame:
    """Keys of the texts that must be cut: those with a second piece."""
    return split_texts(docs, key, only_oversized=True, with_text=False, **options).filter("piece_no = 1").select(key)
