"""Search over the index: lookup, patterns, meanings, and many queries at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.emotion import emotion_columns
from lexmill.functions.models import Classifier, Embedder, HashedEmbedder, IndexResolver, OverlapReranker, PhoneticResolver, Reranker, StressMarker
from lexmill.functions.score import absolute_relevance, combined_score, cosine, relative_relevance
from lexmill.operators.filters import category_predicate, check_category, exclude_headword, phonetic_predicate
from lexmill.operators.order import check_sort, ranked
from lexmill.operators.patterns import headword_predicate
from lexmill.operators.vectors import batch_top_k
from lexmill.plans.query import ParsedQuery, parse_query
from lexmill.schema import CANDIDATE, RESULT_ROW

# The least size of a retrieval pool and its multiple of the result; the default sizes of results.
LEAST_POOL, POOL_FACTOR = 75, 3
DEFAULT_TOP_N, CLI_TOP_N = 10, 30


def pool_size(top_n: int) -> int:
    return max(LEAST_POOL, POOL_FACTOR * top_n)


@dataclass(frozen=True)
class SearchRequest:
    """What a client may ask; absent keys are None."""

    query: str
    top_n: int = DEFAULT_TOP_N
    sort: str | None = None
    category: str | None = None
    syllables: int | None = None
    primary_vowel: str | None = None
    rhymes_with: str | None = None
    sounds_like: str | None = None
    meter: str | None = None

    @classmethod
    def from_dict(cls, request: dict) -> SearchRequest:
        return cls(**{k: v for k, v in request.items() if k in cls.__dataclass_fields__ and (v is not None or k == "query")})


@dataclass(frozen=True)
class SearchResult:
    """candidates: the keys of a candidate, rank and zipf; exact: sense rows of the word itself, in row order, or None
    where the mode has no exact match. An exact frame without rows means that there is no such word."""

    candidates: DataFrame
    exact: DataFrame | None
    word: str

    def rows(self) -> DataFrame:
        """Flat rows, the exact match (its first sense) before the candidates, with a position from 0."""
        empty = F.array().cast("array<string>")
        of = lambda df, exact: df.select(
            "headword", "pos", "definition", "stress", "label", "polarity", F.coalesce("synonyms", empty).alias("synonyms"), "examples", "relevance", F.lit(exact).alias("is_exact"), "rank"
        )
        rows = of(self.candidates, False)
        if self.exact is not None:
            first = self.exact.orderBy("row_id").limit(1)
            first = first.withColumn("headword", F.lit(self.word)).withColumn("relevance", F.lit(100)).withColumn("rank", F.lit(0))
            rows = of(first, True).unionByName(rows)
        at = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("rank")) - 1  # the rows of one result
        return rows.withColumn("position", at).select(*RESULT_ROW, "position")


class Lexicon:
    """senses: an index as build writes it; embedding, norm and phonetics may be null."""

    def __init__(self, senses: DataFrame, embedder: Embedder | None = None, reranker: Reranker | None = None, classifier: Classifier | None = None, resolver: PhoneticResolver | None = None, stress: StressMarker | None = None):
        self.senses = senses
        self.embedder = embedder or HashedEmbedder()
        self.reranker = reranker or OverlapReranker()
        self.classifier, self.stress = classifier, stress
        self.resolver = resolver or (IndexResolver(senses) if "phonetics" in senses.columns else None)

    # --- pieces ---

    def lookup(self, word: str) -> DataFrame:
        """All senses of a word, case aside, in row order; a filter that the scan takes on."""
        return self.senses.filter(F.col("headword_lc") == word.lower()).orderBy("row_id")

    def phonetic_target(self, word: str | None, flag: str) -> dict | None:
        if not word:
            return None
        found = self.resolver.resolve(word, "noun") if self.resolver else None
        if not found:
            raise ValueError(f"{flag}: no pronunciation for {word!r}")
        return found

    def _checks(self, request: SearchRequest) -> tuple[Column, Column]:
        """Category and pronunciation predicates; mistakes are raised before any row is touched."""
        check_category(request.category)
        check_sort(request.sort)
        if request.top_n < 0:
            raise ValueError("top_n must not be negative")
        rhyme = self.phonetic_target(request.rhymes_with, "rhymes_with")
        sound = self.phonetic_target(request.sounds_like, "sounds_like")
        phonetic = phonetic_predicate(F.col("phonetics"), request.syllables, request.primary_vowel, rhyme and rhyme["rhyme_key"], sound and sound["phonemes"], request.meter)
        return category_predicate(request.category, F.col("pos"), F.col("tags")), phonetic

    def tagged(self, rows: DataFrame) -> DataFrame:
        """Emotion and stress of the rows of a result; models see nothing else."""
        guess = self.classifier.label(F.col("definition")) if self.classifier else None
        stress = self.stress.mark(F.col("headword"), F.col("pos")) if self.stress else F.lit(None).cast("string")
        return rows.withColumns(emotion_columns(F.col("source"), F.col("sentiwordnet"), F.col("emolex"), guess)).withColumn("stress", stress)

    def _finish(self, rows: DataFrame, mode: str | None) -> DataFrame:
        """rows have relevance and pos_in_result."""
        tagged = self.tagged(rows).withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
        return ranked(tagged, mode).select(*CANDIDATE, "zipf", "rank")

    # --- modes ---

    def structural(self, parsed: ParsedQuery, request: SearchRequest) -> DataFrame:
        """Headwords that fit, by frequency, then alphabet. Filters see a headword's first sense."""
        category, phonetic = self._checks(request)
        fits = self.senses.filter(F.col("first") & headword_predicate(F.col("headword_lc"), parsed) & category & phonetic)
        score = F.coalesce("zipf", F.lit(0.0))
        best = fits.withColumn("score", score).orderBy(F.desc("score"), "headword_lc").limit(request.top_n)
        at = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "headword_lc"))  # top_n rows
        return self._finish(best.withColumn("relevance", relative_relevance(F.col("score"))).withColumn("pos_in_result", at), request.sort)

    def retrieve(self, parsed: ParsedQuery, vector: list[float], k: int) -> DataFrame:
        """The pool: the k most similar senses, ties to the smaller row; for a pattern with few matches all of them, in
        the order of the word index, without similarity. Rows have pos_in_pool."""
        senses = self.senses
        if parsed.mode == "combined":
            senses = senses.filter(headword_predicate(F.col("headword_lc"), parsed))
            few = senses.select("row_id").limit(k + 1).count() <= k
            if few:
                first = F.min("row_id").over(Window.partitionBy("headword_lc"))
                order = Window.partitionBy(F.lit(1)).orderBy("_first", "row_id")  # at most k rows
                return senses.withColumn("_first", first).withColumn("pos_in_pool", F.row_number().over(order)).drop("_first")
        score = F.round(cosine(F.col("embedding"), vector, F.col("norm")), 6)
        pool = senses.filter(F.col("embedding").isNotNull()).withColumn("similarity", score).orderBy(F.desc("similarity"), "row_id").limit(k)
        return pool.withColumn("pos_in_pool", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("similarity"), "row_id"))).drop("similarity")

    def meaning(self, parsed: ParsedQuery, request: SearchRequest, vector: list[float] | None = None) -> DataFrame:
        """Retrieve, rerank, add frequency, keep each headword's best sense, drop the word itself, filter, cut, scale."""
        category, phonetic = self._checks(request)
        query = vector if vector is not None else self.embedder.encode_query(parsed.text)
        pool = self.retrieve(parsed, query, pool_size(request.top_n))
        raw = self.reranker.score(parsed.text, F.col("definition"))
        scored = pool.withColumn("score", F.round(combined_score(raw, F.col("zipf")), 6))
        own = Window.partitionBy("headword_lc")
        best = scored.withColumn("_n", F.row_number().over(own.orderBy(F.desc("score"), "pos_in_pool"))).withColumn("_seen", F.min("pos_in_pool").over(own)).filter("_n = 1")
        kept = best.filter(exclude_headword(F.col("headword_lc"), None if parsed.mode == "combined" else parsed.text) & category & phonetic)
        order = [F.desc("score"), F.asc("_seen")]
        top = kept.orderBy(*order).limit(request.top_n)
        at = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))  # top_n rows
        return self._finish(top.withColumn("relevance", absolute_relevance(F.col("score"))).withColumn("pos_in_result", at), request.sort)

    def search(self, query: str | SearchRequest, vector: list[float] | None = None, **options: object) -> SearchResult:
        """The result of one line of the query language. vector stands for the encoded meaning, if given."""
        request = query if isinstance(query, SearchRequest) else SearchRequest(query, **options)
        parsed = parse_query(request.query)
        if parsed.mode in ("meaning", "combined"):
            candidates = self.meaning(parsed, request, vector)
            exact = self.tagged(self.lookup(parsed.text)) if parsed.mode == "meaning" else None
            return SearchResult(candidates, exact, parsed.text)
        return SearchResult(self.structural(parsed, request), None, request.query)

    def search_many(self, queries: DataFrame, top_n: int = DEFAULT_TOP_N, category: str | None = None) -> DataFrame:
        """(query_id, rank, row_id, headword, score, relevance) for many meanings at once.

        queries: (query_id, text, vec), a stated query set with its encoded vectors. The pool of each comes from exact
        block products; reranking, best senses, filters and the cut are windows of one query's pool. Only ids and scores
        are shuffled before the pool's rows are joined.
        """
        check_category(category)
        pool = pool_size(top_n)
        vectors = self.senses.filter(F.col("embedding").isNotNull()).select(F.col("row_id").alias("key"), F.col("embedding").alias("vec"))
        found = batch_top_k(queries.select(F.col("query_id").alias("key"), "vec"), vectors, pool, self.embedder.dim, apart_from_self=False)
        rows = found.select("query_id", F.col("key").alias("row_id"), F.col("rank").alias("place")).join(self.senses.select("row_id", "headword", "headword_lc", "pos", "tags", "definition", "zipf"), "row_id")
        rows = rows.join(queries.select("query_id", "text"), "query_id")
        score = F.round(combined_score(self.reranker.score(F.col("text"), F.col("definition")), F.col("zipf")), 6)
        own = Window.partitionBy("query_id", "headword_lc")
        best = rows.withColumn("score", score).withColumn("_n", F.row_number().over(own.orderBy(F.desc("score"), "place"))).withColumn("_seen", F.min("place").over(own)).filter("_n = 1")
        kept = best.filter((F.col("headword_lc") != F.lower("text")) & category_predicate(category, F.col("pos"), F.col("tags")))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "_seen"))
        return kept.withColumn("rank", rank).filter(F.col("rank") <= top_n).select("query_id", "rank", "row_id", "headword", "score", absolute_relevance(F.col("score")).alias("relevance"))
