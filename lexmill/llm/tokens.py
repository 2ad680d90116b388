"""Token ids of a public byte-level BPE vocabulary, by recursive SQL in each partition.

Texts are cut into words by the vocabulary's pattern. The distinct words that a worker hasn't met go into an embedded
SQL engine as token-position rows: a row for each token with the next one and its position. A recursive query joins
neighbouring tokens with the merge table, finds each word's pair of minimum rank and contracts it, from the left,
until nothing merges; an ordered aggregation then gives each word's ids. A pair that occurs in a word several times is
contracted at all of its places in one round, as one after the other would: a pair that a contraction makes has a larger
rank, so nothing could come in between. Of places that overlap, which only a pair of equal tokens has, every other one is
taken.

One query serves words of any length, which it cuts into cells no shorter than any token that the word could hold. What
merges of smaller rank build up next to a pair and could take part of it away would be a token that holds both, so only
merges in its own and the neighbouring cells matter: in each round every cell contracts its pair of minimum rank if its
neighbours have no smaller one. The leftmost pair of minimum rank of a word is always among those.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: default place of the vocabulary; a parameter everywhere, as every executor must find the file there
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: the pattern that cuts texts into words before merging.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: words, and ids of words, that a worker remembers; the memory is emptied when full
MEMORY_WORDS, MEMORY_IDS = 200_000, 3_000_000
#: bytes of distinct words that go into one recursive query, a longer word alone
BATCH_BYTES = 400_000
#: token-position rows that one recursive query may gather over its rounds; words that aren't done then go into another
GATHERED_ROWS = 8_000_000
#: a position is a word's number in the query and a place within the word; a cell likewise
PLACE_BITS = 36

_CONTRACT = f"""
WITH RECURSIVE state(pos, nxt, cell, tok, ntok, rank, merged, step) AS (
    SELECT p.pos, p.nxt, p.cell, p.tok, p.ntok, m.rank, m.merged, 0 FROM pieces p LEFT JOIN merges m ON m.a = p.tok AND m.b = p.ntok
    UNION ALL
    (
        WITH best AS MATERIALIZED (
            SELECT cell, min(rank) AS rank FROM state WHERE rank IS NOT NULL AND step < $rounds GROUP BY 1
        ), alive AS (
            SELECT DISTINCT cell >> {PLACE_BITS} AS word FROM best
        ), around AS (
            SELECT b.cell, b.rank FROM best b LEFT JOIN best l ON l.cell = b.cell - 1 LEFT JOIN best r ON r.cell = b.cell + 1 WHERE b.rank = least(b.rank, l.rank, r.rank)
        ), least AS MATERIALIZED (
            SELECT s.pos, s.pos >> {PLACE_BITS} AS word, s.nxt AS gone, s.rank, s.merged, s.tok = s.ntok AS twin FROM state s JOIN around b ON s.cell = b.cell AND s.rank = b.rank
        ), chained AS (
            SELECT *, row_number() OVER (PARTITION BY word ORDER BY pos) AS n, coalesce(lag(gone) OVER (PARTITION BY word ORDER BY pos) = pos, false) AS goes_on FROM least WHERE twin
        ), runs AS (
            SELECT *, max(CASE WHEN NOT goes_on THEN n END) OVER (PARTITION BY word ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM chained
        ), hanging AS (
            SELECT r.word, r.run FROM runs r JOIN state o ON o.nxt = r.pos AND o.rank = r.rank WHERE NOT r.goes_on
        ), picked AS (
            SELECT pos, gone, merged FROM least WHERE NOT twin
            UNION ALL
            SELECT pos, gone, merged FROM runs ANTI JOIN hanging USING (word, run) WHERE (n - run) % 2 = 0
        ), taken AS MATERIALIZED (
            SELECT k.pos, k.gone, k.merged, q.nxt AS after, q.ntok FROM picked k JOIN state q ON q.pos = k.gone
        ), moved AS (
            SELECT s.pos, s.cell, CASE WHEN k.pos IS NULL THEN s.nxt ELSE k.after END AS nxt, coalesce(k.merged, s.tok) AS tok, CASE WHEN k.pos IS NULL THEN s.ntok ELSE k.ntok END AS ntok, s.rank, s.merged, k.pos IS NOT NULL AS new, s.step + 1 AS step
            FROM state s SEMI JOIN alive b ON s.pos >> {PLACE_BITS} = b.word ANTI JOIN taken g ON s.pos = g.gone LEFT JOIN taken k ON s.pos = k.pos
        ), facing AS MATERIALIZED (
            SELECT m.pos, m.nxt, m.cell, m.tok, coalesce(n.merged, m.ntok) AS ntok, m.rank, m.merged, m.new OR n.pos IS NOT NULL AS new, m.step FROM moved m LEFT JOIN taken n ON m.nxt = n.pos
        )
        SELECT pos, nxt, cell, tok, ntok, rank, merged, step FROM facing WHERE NOT new
        UNION ALL
        SELECT f.pos, f.nxt, f.cell, f.tok, f.ntok, m.rank, m.merged, f.step FROM facing f LEFT JOIN merges m ON m.a = f.tok AND m.b = f.ntok WHERE f.new
    )
)
SELECT s.pos >> {PLACE_BITS} AS word, list(s.tok ORDER BY s.pos) AS ids, any_value(s.step) AS step
FROM state s JOIN (SELECT pos >> {PLACE_BITS} AS word, max(step) AS step FROM state GROUP BY 1) l ON s.pos >> {PLACE_BITS} = l.word AND s.step = l.step
GROUP BY 1
"""


def byte_letters() -> dict[str, int]:
    """The printable letter that the vocabulary file writes for each byte, by its rule: printable Latin-1 stands for
    itself, the rest are numbered upwards from code point 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


class Tokenizer:
    """One per worker process: the merge table in an embedded engine, and the words met so far."""

    def __init__(self, vocabulary: str):
        import duckdb

        model = json.load(open(vocabulary, encoding="utf-8"))["model"]
        ids: dict[str, int] = model["vocab"]
        letters = byte_letters()
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.byte_ids = [0] * 256
        for letter, b in letters.items():
            self.byte_ids[b] = ids[letter]
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in ids.items() if all(c in letters for c in t)}
        self.words = regex.compile(WORD_PATTERN)
        self.letters_only = regex.compile(r" ?[A-Za-z]+")
        of_letters = regex.compile(rb" ?[A-Za-z]+")
        self.longest = max(map(len, self.bytes_of.values()))
        self.longest_of_letters = max(len(b) for b in self.bytes_of.values() if of_letters.fullmatch(b))
        self.memory: dict[str, list[int]] = {}
        self.remembered = 0
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        products = [ids[a + b] for a, b in merges]
        rows = pa.table({"a": pa.array([ids[a] for a, _ in merges], pa.int32()), "b": pa.array([ids[b] for _, b in merges], pa.int32()), "merged": pa.array(products, pa.int32()), "rank": pa.array(range(len(merges)), pa.int32())})
        made = {token: rank for rank, token in enumerate(products)}
        if len(made) < len(products) or any(made.get(ids[part], -1) >= rank for rank, pair in enumerate(merges) for part in pair):
            raise ValueError("a pair must have a larger rank than the pairs its tokens are made of")
        self.db.register("merge_rows", rows)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merge_rows")
        self.db.unregister("merge_rows")

    def split(self, text: str) -> list[str]:
        return self.words.findall(text)

    def learn(self, words: Iterable[str]) -> None:
        """Contract the words that aren't remembered."""
        new = [w for w in words if w not in self.memory]
        if len(self.memory) + len(new) > MEMORY_WORDS or self.remembered > MEMORY_IDS:
            self.memory.clear()
            self.remembered = 0
            new = list(words)
        batch: list[tuple[str, list[int]]] = []
        size = 0
        for word in new:
            toks = [self.byte_ids[x] for x in word.encode("utf-8", "replace")]
            if batch and size + len(toks) > BATCH_BYTES:
                self._contract(batch)
                batch, size = [], 0
            batch.append((word, toks))
            size += len(toks)
        self._contract(batch)

    def _contract(self, batch: list[tuple[str, list[int]]]) -> None:
        """Recursive queries until every word of the batch is at its fixpoint."""
        while batch:
            lengths = np.array([len(toks) for _, toks in batch], np.int64)
            starts = np.cumsum(lengths) - lengths
            place = np.arange(lengths.sum()) - np.repeat(starts, lengths)
            pos = np.repeat(np.arange(len(batch), dtype=np.int64) << PLACE_BITS, lengths) + place
            last = place + 1 == np.repeat(lengths, lengths)
            width = np.array([self.longest_of_letters if self.letters_only.fullmatch(word) else self.longest for word, _ in batch])
            cell = (pos - place) + place // np.repeat(width, lengths)
            tok = np.fromiter((t for _, toks in batch for t in toks), np.int32, len(pos))
            rounds = max(4, GATHERED_ROWS // max(len(pos), 1))
            self.db.register("pieces", pa.table({"pos": pa.array(pos), "nxt": pa.array(pos + 1, mask=last), "cell": pa.array(cell), "tok": pa.array(tok), "ntok": pa.array(np.roll(tok, -1), mask=last)}))
            done = self.db.sql(_CONTRACT, params={"rounds": rounds}).to_arrow_table()
            self.db.unregister("pieces")
            rest = []
            for n, ids, step in zip(done.column("word").to_pylist(), done.column("ids").to_pylist(), done.column("step").to_pylist(), strict=True):
                if step == rounds:
                    rest.append((batch[n][0], ids))
                else:
                    self.memory[batch[n][0]] = ids
                    self.remembered += len(ids)
            batch = rest

    def word_ids(self, texts: list[str | None]) -> Iterator[list[list[int]]]:
        """The ids of each word of each text; none for null and empty texts."""
        split = [self.split(t) if t else [] for t in texts]
        self.learn(dict.fromkeys(w for words in split for w in words))
        memory = self.memory
        for words in split:
            yield [memory[w] for w in words]

    def encode(self, texts: list[str | None]) -> Iterator[list[int]]:
        for words in self.word_ids(texts):
            yield [i for ids in words for i in ids]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(self.bytes_of[i] for i in ids)


@lru_cache(maxsize=2)
def tokenizer(vocabulary: str = DEFAULT_VOCABULARY) -> Tokenizer:
    return Tokenizer(vocabulary)


def in_slices(batches: Iterator[pa.RecordBatch], text: str, chars: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of the batches that hold about so many characters of text, so that memory follows texts, not rows."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text)).cast(pa.string()).to_pylist()
        start = size = 0
        for n, t in enumerate(texts):
            size += len(t or "")
            if size >= chars or n + 1 == len(texts):
                yield batch.slice(start, n + 1 - start), texts[start : n + 1]
                start, size = n + 1, 0


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """key and ids of each row, without special tokens. Null and empty texts give an empty list; a text that holds the
    name of a special token is ordinary text; repeated rows stay; other columns aren't read. Narrow: no shuffle."""
    schema = T.StructType([docs.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(vocabulary)
        for part, texts in in_slices(batches, text):
            ids = pa.array(own.encode(texts), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[key, "ids"])

    return docs.select(F.col(key), F.col(text).cast("string").alias(text)).mapInArrow(encode, schema)


def with_token_counts(docs: DataFrame, text: str = "text", into: str = "n_tokens", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The other columns with the number of tokens of the text in its place; 0 for null and empty texts. Only counts
    leave the worker."""
    kept = [f for f in docs.schema.fields if f.name not in (text, into)]
    schema = T.StructType([*kept, T.StructField(into, T.LongType())])
    names = [f.name for f in kept]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(vocabulary)
        for part, texts in in_slices(batches, text):
            totals = pa.array([sum(map(len, words)) for words in own.word_ids(texts)], pa.int64())
            yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(n)) for n in names], totals], names=[*names, into])

    return docs.select(*names, text).mapInArrow(count, schema)
