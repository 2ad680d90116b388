"""Queries over the sense index and their SQL: patterns, filters, orders, scores, ingest and whole searches."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.emotion import EMOTION_POLARITY, emotion_columns
from lexmill.functions.models import best_label
from lexmill.functions.phonetics import PHONEME_CODES, derive, mean_consonant_run, phoneme_distance
from lexmill.functions.score import absolute_relevance, combined_score, norm, relative_relevance
from lexmill.operators.filters import CATEGORIES, IDIOM_SLANG_POS, IDIOM_SLANG_TAGS, OLD_TAGS, category_predicate, exclude_headword, phonetic_predicate
from lexmill.operators.merge import first_spellings, headwords, merge_records, row_lists, unique_definitions, with_emotions, with_frequency
from lexmill.operators.order import INFORMAL_TAGS, SORT_MODES, ranked
from lexmill.operators.patterns import clause_predicate, clauses_predicate, initials_are, phrase_contains
from lexmill.operators.vectors import batch_top_k, top_k, usable
from lexmill.plans.evaluate import case_ranks, recall, synonym_forms
from lexmill.plans.search import Lexicon
from lexmill.session import shared_path, table, written_once, written_table
from lexmill.sources.readers import NGRAM_WINDOW, corpus_total, read_frequency, read_ngrams, read_wordnet, recent_count, wiktionary_senses, word_counts, zipf_scale
from lexmill.sources.sinks import candidate_preview, read_index, read_word_index, result_line, write_index
from lexmill.streaming.queries import run_to_table, running_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

DIM = 64
MEANING_TEXT = "a small wooden tool used to cut bread in the kitchen"
TARGET_PHONEMES = ["S", "EH1", "T"]


#: columns that are integers here and wider in SQL
_INTS = {"dedupe_best_sense": "score", "result_rows_flat": "position", "result_lines": "position", "recall_at_k": ""}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        narrow = _INTS[name] if name in _INTS else ("rank" if "AS rank" in sql else "")
        SQL[name] = f"SELECT * REPLACE ({narrow}::INT AS {narrow}) FROM ({sql})" if narrow else sql


# --- views that several queries share ---


def metadata(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "metadata")


def lower_headword(rows: DataFrame) -> DataFrame:
    return rows.withColumn("headword_lc", F.lower("headword"))


def index_path(spark: SparkSession, d: str) -> str:
    """The folder of the index over the sense table: built and written once, then queried."""

    def write(path: str) -> None:
        frequency = table(spark, d, "literary_frequency")
        senses = lower_headword(with_frequency(metadata(spark, d), frequency))
        firsts = headwords(metadata(spark, d)).select(F.col("first_row").alias("_first"))
        senses = senses.join(firsts, senses["row_id"] == F.col("_first"), "left").withColumn("first", F.col("_first").isNotNull()).drop("_first")
        vectors = usable(table(spark, d, "sense_embeddings"), "row_id", "embedding", DIM)
        vectors = vectors.select(F.col("key").alias("row_id"), F.col("vec").alias("embedding"), norm(F.col("vec")).alias("norm"))
        write_index(senses.join(vectors, "row_id", "left"), frequency, path)

    return written_once(spark, d, "index", write)


def sense_index(spark: SparkSession, d: str) -> DataFrame:
    """The sense table as an index: frequency, vectors and the mark of a headword's first sense."""
    return read_index(spark, index_path(spark, d))


def embedded_index(spark: SparkSession, d: str) -> DataFrame:
    return sense_index(spark, d).filter("embedding IS NOT NULL")


def embedded_senses(spark: SparkSession, d: str) -> DataFrame:
    """What many searches by meaning read: the few columns of the senses that have a vector, written once. Other columns
    and senses aren't shuffled."""

    def write(path: str) -> None:
        vectors = usable(table(spark, d, "sense_embeddings"), "row_id", "embedding", DIM).select(F.col("key").alias("row_id"), F.col("vec").alias("embedding"))
        senses = metadata(spark, d).select("row_id", "headword", "pos", "tags", "definition").join(vectors, "row_id")
        lower_headword(with_frequency(senses, table(spark, d, "literary_frequency"))).write.parquet(path)

    return spark.read.parquet(written_once(spark, d, "embedded", write))


def first_vector(spark: SparkSession, d: str) -> list[float]:
    """The usable vector of the smallest row: the query of the vector queries."""
    row = usable(table(spark, d, "sense_embeddings"), "row_id", "embedding", DIM).orderBy("key").limit(1).collect()
    return [float(x) for x in row[0]["vec"]] if row else [1.0] * DIM


_FIRSTS = "(SELECT lower(headword) AS headword_lc, min(row_id) AS first_row, count(*) AS n_rows FROM metadata WHERE headword IS NOT NULL GROUP BY 1)"
_INDEX = f"""(SELECT m.*, lower(m.headword) AS headword_lc, f.zipf, h.first_row IS NOT NULL AS first
 FROM metadata m LEFT JOIN literary_frequency f ON lower(m.headword) = f.word LEFT JOIN {_FIRSTS} h ON m.row_id = h.first_row)"""
_USABLE = "(SELECT row_id, embedding::DOUBLE[] AS vec FROM sense_embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL)) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"
_FIRST_VECTOR = f"(SELECT vec AS q FROM {_USABLE} ORDER BY row_id LIMIT 1)"
_WS = r"[\t\n\x0b\f\r \x{85}\p{Z}]"


def _list(values: tuple[str, ...] | list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# --- headword patterns ---


def _pattern(clauses: tuple[str, ...]) -> Query:
    return lambda s, d: lower_headword(metadata(s, d)).filter(clauses_predicate(F.col("headword_lc"), clauses)).select("headword_lc").distinct()


def _pattern_sql(condition: str) -> str:
    return f"SELECT DISTINCT w AS headword_lc FROM (SELECT lower(headword) AS w FROM metadata) WHERE {condition}"


def _rx(body: str) -> str:
    return f"regexp_matches(w, '(?i)^{body}\\n?$')"


_C, _V, _ANY = "[bcdfghjklmnpqrstvwxyz]", "[aeiou]", r"[^\n]"
_add("wildcard_literal", _pattern(("set",)), _pattern_sql(_rx("set")))
_add("wildcard_prefix", _pattern(("th*",)), _pattern_sql(_rx(f"th{_ANY}*")))
_add("wildcard_suffix", _pattern(("*ness",)), _pattern_sql(_rx(f"{_ANY}*ness")))
_add("wildcard_contains", _pattern(("*oa*",)), _pattern_sql(_rx(f"{_ANY}*oa{_ANY}*")))
_add("wildcard_fixed_len", _pattern(("s????le?",)), _pattern_sql(_rx(f"s{_ANY}{{4}}le{_ANY}")))
_add("wildcard_consonant_vowel", _pattern(("#@#@*",)), _pattern_sql(_rx(f"{_C}{_V}{_C}{_V}{_ANY}*")))
_add("disallow_letters", _pattern(("-eaio",)), _pattern_sql("w IS NOT NULL AND NOT regexp_matches(w, '[eaio]')"))
_add("restrict_letters", _pattern(("+setlamornid",)), _pattern_sql("regexp_full_match(w, '[setlamornid]*')"))
_add("anagram", _pattern(("//tes//",)), _pattern_sql("list_sort(string_split(w, '')) = ['e', 's', 't']"))
_add("clauses_and", _pattern(("?????", "*e*", "-x")), _pattern_sql(f"{_rx(_ANY + '{5}')} AND {_rx(_ANY + '*e' + _ANY + '*')} AND NOT regexp_matches(w, 'x')"))
_add("clauses_none", _pattern(()), _pattern_sql("true"))
_TOKENS = f"list_filter(regexp_split_to_array(w, '{_WS}+'), lambda t: t <> '')"
_add(
    "expand_initials",
    lambda s, d: lower_headword(metadata(s, d)).filter(initials_are(F.col("headword_lc"), "bw")).select("headword_lc").distinct(),
    _pattern_sql(f"len(list_filter({_TOKENS}, lambda t: t NOT IN ('and', 'of', 'the', 'for', 'a', 'an', '&'))) >= 2 AND list_aggregate(list_transform(list_filter({_TOKENS}, lambda t: t NOT IN ('and', 'of', 'the', 'for', 'a', 'an', '&')), lambda t: t[1]), 'string_agg', '') = 'bw'"),
)
_add(
    "phrase_contains",
    lambda s, d: lower_headword(metadata(s, d)).filter(phrase_contains(F.col("headword_lc"), "and")).select("headword_lc").distinct(),
    _pattern_sql(f"len({_TOKENS}) >= 2 AND list_contains({_TOKENS}, 'and')"),
)

# --- lookup and filters ---

_add(
    "exact_lookup",
    lambda s, d: lower_headword(metadata(s, d)).filter(F.col("headword_lc") == "coarse").select("row_id", "headword", "pos", "definition"),
    "SELECT row_id, headword, pos, definition FROM metadata WHERE lower(headword) = 'coarse'",
)
_add(
    "exclude_exact",
    lambda s, d: lower_headword(metadata(s, d)).filter(exclude_headword(F.col("headword_lc"), "Set")).select("row_id"),
    "SELECT row_id FROM metadata WHERE lower(headword) <> 'set'",
)
_CATEGORY_SQL = {
    "all": "true",
    "idiom_slang": f"coalesce(pos IN ('{IDIOM_SLANG_POS[0]}', '{IDIOM_SLANG_POS[1]}'), false) OR coalesce(list_has_any(tags, {_list(IDIOM_SLANG_TAGS)}), false)",
    "old": f"coalesce(list_has_any(tags, {_list(OLD_TAGS)}), false)",
}
for _c in CATEGORIES:
    _add(
        f"category_{_c}",
        lambda s, d, c=_c: metadata(s, d).filter(category_predicate(c, F.col("pos"), F.col("tags"))).select("row_id"),
        f"SELECT row_id FROM metadata WHERE {_CATEGORY_SQL.get(_c, f"pos = '{_c}'")}",
    )
for _n, _options, _condition in (
    ("syllables", {"syllables": 2}, "phonetics.syllable_count = 2"),
    ("vowel", {"primary_vowel": "ae"}, "phonetics.primary_vowel = 'AE'"),
    ("rhyme", {"rhyme_key": "EH T"}, "phonetics.rhyme_key = 'EH T'"),
    ("meter", {"meter": "/x"}, "phonetics.meter = '/x'"),
):
    _add(f"phonetic_{_n}", lambda s, d, o=_options: metadata(s, d).filter(phonetic_predicate(F.col("phonetics"), **o)).select("row_id"), f"SELECT row_id FROM metadata WHERE {_condition}")
_CODES = ", ".join(f"'{p}': '{c}'" for p, c in PHONEME_CODES.items())
_CODE = f"list_aggregate(list_transform(phonetics.phonemes, lambda p: coalesce(list_extract(map_extract(MAP {{{_CODES}}}, regexp_replace(p, '[012]+$', '')), 1), '?')), 'string_agg', '')"
_TARGET = "".join(PHONEME_CODES[p.rstrip("012")] for p in TARGET_PHONEMES)
_add(
    "phonetic_sounds_like",
    lambda s, d: metadata(s, d).filter(phonetic_predicate(F.col("phonetics"), phonemes=TARGET_PHONEMES)).select("row_id", F.round(phoneme_distance(F.col("phonetics.phonemes"), TARGET_PHONEMES), 6).alias("distance")),
    f"SELECT row_id, round(levenshtein(c, '{_TARGET}') / greatest(len(c), {len(_TARGET)}, 1), 6) AS distance FROM (SELECT row_id, {_CODE} AS c FROM metadata WHERE len(phonetics.phonemes) > 0) WHERE levenshtein(c, '{_TARGET}') / greatest(len(c), {len(_TARGET)}, 1) <= 0.34",
)

# --- structural search, orders, lines ---


def _structural(query: str, **options: object) -> Query:
    return lambda s, d: Lexicon(sense_index(s, d)).search(query, **options).candidates.select("rank", "headword", "pos", "definition", "relevance", F.round("zipf", 6).alias("zipf"))


def _structural_base(condition: str, n: int) -> str:
    top = f"""SELECT *, coalesce(zipf, 0.0) AS score FROM {_INDEX} i WHERE first AND {condition} ORDER BY score DESC, headword_lc LIMIT {n}"""
    return f"""SELECT *, row_number() OVER (ORDER BY score DESC, headword_lc) AS place,
 (CASE WHEN max(score) OVER () = min(score) OVER () THEN 50 ELSE round_even((score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) * 100, 0) END)::INT AS relevance FROM ({top})"""


def _structural_sql(condition: str, n: int, order: str = "place") -> str:
    return f"SELECT row_number() OVER (ORDER BY {order}) AS rank, headword, pos, definition, relevance, round(zipf, 6) AS zipf FROM ({_structural_base(condition, n)})"


_TH = "headword_lc LIKE 'th%' AND headword_lc NOT LIKE E'th%\\n_%'"
_add("structural_topn_by_zipf", _structural("th*", top_n=30), _structural_sql(_TH, 30))
_add("structural_filtered", _structural("s*", top_n=50, category="noun", syllables=2), _structural_sql("headword_lc LIKE 's%' AND headword_lc NOT LIKE E's%\\n_%' AND pos = 'noun' AND phonetics.syllable_count = 2", 50))
_LYRICAL = """coalesce((CASE WHEN len(phonetics.phonemes) > 0 THEN (SELECT CASE WHEN len(runs) > 0 THEN len(replace(shape, 'V', '')) / len(runs) ELSE 0.0 END FROM (SELECT shape, list_filter(regexp_split_to_array(shape, 'V+'), lambda r: r <> '') AS runs FROM (SELECT list_aggregate(list_transform(phonetics.phonemes, lambda p: CASE WHEN regexp_matches(p, '[0-9]$') THEN 'V' ELSE 'C' END), 'string_agg', '') AS shape))) END), 'inf'::DOUBLE)"""
_OLD_SQL = f"(CASE WHEN coalesce(list_has_any(tags, {_list(OLD_TAGS)}), false) THEN 1 ELSE 0 END)"
_ORDER_SQL = {
    "relevance": "place",
    "alpha": "lower(headword), place",
    "alpha_desc": "lower(headword) DESC, place",
    "shortest": "len(headword), lower(headword), place",
    "longest": "len(headword) DESC, lower(headword), place",
    "most_common": "coalesce(zipf, 0.0) DESC, lower(headword), place",
    "least_common": "coalesce(zipf, 0.0), lower(headword), place",
    "most_formal": f"CASE WHEN coalesce(list_contains(tags, 'formal'), false) THEN 0 WHEN coalesce(list_has_any(tags, {_list(INFORMAL_TAGS)}), false) THEN 2 ELSE 1 END, place",
    "oldest": f"1 - {_OLD_SQL}, place",
    "most_modern": f"{_OLD_SQL}, place",
    "most_lyrical": f"{_LYRICAL}, place",
}
for _m in SORT_MODES:
    _add(f"sort_{_m}", _structural("*e*", top_n=120, sort=_m), _structural_sql("headword_lc LIKE '%e%' AND NOT regexp_matches(headword_lc, '\\n[\\s\\S]')", 120, _ORDER_SQL[_m]))


def _lyrical(s: SparkSession, d: str) -> DataFrame:
    return metadata(s, d).select("row_id", F.round(F.coalesce(mean_consonant_run(F.col("phonetics.phonemes")), F.lit(-1.0)), 6).alias("mean_run"))


_add("mean_consonant_run", _lyrical, f"SELECT row_id, round(CASE WHEN isinf(r) THEN -1.0 ELSE r END, 6) AS mean_run FROM (SELECT row_id, {_LYRICAL} AS r FROM metadata)")

# --- scores ---

_add(
    "combine_score",
    lambda s, d: sense_index(s, d).select("row_id", F.round(combined_score(F.length("definition") / F.lit(10.0), F.col("zipf")), 6).alias("score")),
    f"SELECT row_id, round(len(definition) / 10.0 + coalesce(zipf, 0.0), 6) AS score FROM {_INDEX}",
)
_add(
    "absolute_relevance",
    lambda s, d: sense_index(s, d).select("row_id", absolute_relevance(F.coalesce("zipf", F.lit(0.0)) - F.lit(4.0)).alias("relevance")),
    f"SELECT row_id, round_even(100 * (1 / (1 + exp(-(coalesce(zipf, 0.0) - 4.0)))), 0)::INT AS relevance FROM {_INDEX}",
)


def _relative(s: SparkSession, d: str) -> DataFrame:
    top = table(s, d, "literary_frequency").filter("zipf IS NOT NULL").orderBy(F.desc("zipf"), "word").limit(200)
    return top.select("word", relative_relevance(F.col("zipf")).alias("relevance"))


_add(
    "relative_relevance",
    _relative,
    """SELECT word, (CASE WHEN max(zipf) OVER () = min(zipf) OVER () THEN 50 ELSE round_even((zipf - min(zipf) OVER ()) / (max(zipf) OVER () - min(zipf) OVER ()) * 100, 0) END)::INT AS relevance
 FROM (SELECT * FROM literary_frequency WHERE zipf IS NOT NULL ORDER BY zipf DESC, word LIMIT 200)""",
)

# --- vectors ---

_add(
    "cosine_topk",
    lambda s, d: top_k(table(s, d, "sense_embeddings"), first_vector(s, d), 75),
    f"SELECT row_id, round(list_cosine_similarity(vec, q), 6) AS score FROM {_USABLE}, {_FIRST_VECTOR} ORDER BY score DESC, row_id LIMIT 75",
)
_add(
    "cosine_topk_restricted",
    lambda s, d: top_k(embedded_index(s, d).filter(clause_predicate(F.col("headword_lc"), "s*")), first_vector(s, d), 75),
    f"SELECT row_id, round(list_cosine_similarity(vec, q), 6) AS score FROM {_USABLE} JOIN metadata USING (row_id), {_FIRST_VECTOR} WHERE lower(headword) LIKE 's%' AND NOT regexp_matches(lower(headword), '\\n[\\s\\S]') ORDER BY score DESC, row_id LIMIT 75",
)


def _batch(s: SparkSession, d: str, k: int) -> DataFrame:
    rows = usable(table(s, d, "sense_embeddings"), "row_id", "embedding", DIM)
    return batch_top_k(rows.filter(F.col("key") % 20 == 0), rows, k, DIM)  # the stated query set


_BATCH_SQL = f"""SELECT query_id, row_id, score, rank FROM (SELECT a.row_id AS query_id, b.row_id, round(list_cosine_similarity(a.vec, b.vec), 6) AS score,
 row_number() OVER (PARTITION BY a.row_id ORDER BY round(list_cosine_similarity(a.vec, b.vec), 6) DESC, b.row_id) AS rank
 FROM {_USABLE} a JOIN {_USABLE} b ON a.row_id % 20 = 0 AND a.row_id <> b.row_id) WHERE rank <= 10"""
_add("batch_cosine_topk", lambda s, d: _batch(s, d, 10).withColumnRenamed("key", "row_id"), _BATCH_SQL)


def _best_sense(s: SparkSession, d: str) -> DataFrame:
    """Each headword's best-scored sense, the first of equals, with the place where the headword first appears."""
    rows = lower_headword(metadata(s, d)).filter("headword IS NOT NULL").select("headword_lc", "row_id", F.coalesce(F.length("definition"), F.lit(0)).alias("score"))
    return rows.groupBy("headword_lc").agg(F.max(F.struct("score", (-F.col("row_id")).alias("r"))).alias("b"), F.min("row_id").alias("first_seen")).select("headword_lc", (-F.col("b.r")).alias("row_id"), F.col("b.score").alias("score"), "first_seen")


_add(
    "dedupe_best_sense",
    _best_sense,
    """SELECT headword_lc, row_id, score, first_seen FROM (SELECT lower(headword) AS headword_lc, row_id, coalesce(len(definition), 0) AS score, min(row_id) OVER (PARTITION BY lower(headword)) AS first_seen,
 row_number() OVER (PARTITION BY lower(headword) ORDER BY coalesce(len(definition), 0) DESC, row_id) AS n FROM metadata WHERE headword IS NOT NULL) WHERE n = 1""",
)

# --- whole searches by meaning ---


def _meaning(query: str, **options: object) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        found = Lexicon(embedded_index(s, d)).search(query, vector=first_vector(s, d), **options).candidates
        return found.select("rank", "headword", "pos", "definition", "label", "polarity", "relevance", F.size("tags").alias("n_tags"))

    return run


def _emotion_sql(rows: str) -> str:
    known = ", ".join(f"'{k}': '{v}'" for k, v in EMOTION_POLARITY.items())
    of = lambda label: f"coalesce(list_extract(map_extract(MAP {{{known}}}, {label}), 1), 'neutral')"
    return f"""SELECT *, coalesce(specific, polarity) AS label, CASE WHEN specific IS NOT NULL THEN 'emolex' WHEN by_scores IS NOT NULL THEN 'sentiwordnet' WHEN by_lexicon IS NOT NULL THEN 'emolex' ELSE 'none' END AS emotion_source
 FROM (SELECT *, coalesce(by_scores, by_lexicon, 'neutral') AS polarity FROM (SELECT *,
 CASE WHEN source = 'wordnet' THEN CASE WHEN sentiwordnet.pos > sentiwordnet.neg THEN 'positive' WHEN sentiwordnet.pos < sentiwordnet.neg THEN 'negative' END END AS by_scores,
 nullif(CASE WHEN emolex IS NULL THEN NULL WHEN specific IS NOT NULL THEN {of('specific')} WHEN list_contains(emolex, 'positive') THEN 'positive' WHEN list_contains(emolex, 'negative') THEN 'negative' ELSE 'neutral' END, 'neutral') AS by_lexicon
 FROM (SELECT *, list_min(list_filter(emolex, lambda l: l NOT IN ('positive', 'negative', 'neutral'))) AS specific FROM {rows})))"""


_QUERY_WORDS = sorted(set(MEANING_TEXT.split()))
_RAW = f"len(list_distinct(list_intersect(regexp_split_to_array(lower(coalesce(definition, '')), '[^a-z0-9]+'), {_list(_QUERY_WORDS)}))) * 10.0 / {len(_QUERY_WORDS)}"
_VECTORS = f"(SELECT i.*, u.vec FROM {_INDEX} i JOIN {_USABLE} u USING (row_id))"


def _meaning_sql(pool: str, n: int, kept: str = "true") -> str:
    best = f"""SELECT *, row_number() OVER (PARTITION BY headword_lc ORDER BY score DESC, place) AS n, min(place) OVER (PARTITION BY headword_lc) AS seen
 FROM (SELECT *, round({_RAW} + coalesce(zipf, 0.0), 6) AS score FROM ({pool}))"""
    top = f"(SELECT *, row_number() OVER (ORDER BY score DESC, seen) AS rank FROM ({best}) WHERE n = 1 AND {kept} ORDER BY score DESC, seen LIMIT {n})"
    return f"SELECT rank, headword, pos, definition, label, polarity, round_even(100 * (1 / (1 + exp(-score))), 0)::INT AS relevance, coalesce(len(tags), 0)::INT AS n_tags FROM ({_emotion_sql(top)})"


def _pool_sql(k: int, condition: str = "true") -> str:
    return f"SELECT *, row_number() OVER (ORDER BY sim DESC, row_id) AS place FROM (SELECT *, round(list_cosine_similarity(vec, q), 6) AS sim FROM {_VECTORS}, {_FIRST_VECTOR} WHERE {condition} ORDER BY sim DESC, row_id LIMIT {k})"


_add("search_meaning_e2e", _meaning(MEANING_TEXT, top_n=30), _meaning_sql(_pool_sql(90), 30, f"headword_lc <> '{MEANING_TEXT}'"))
_add("search_meaning_filtered", _meaning(MEANING_TEXT, top_n=30, category="noun"), _meaning_sql(_pool_sql(90), 30, f"pos = 'noun' AND headword_lc <> '{MEANING_TEXT}'"))
_FITS = "headword_lc LIKE 's%' AND NOT regexp_matches(headword_lc, '\\n[\\s\\S]')"
_COMBINED_POOL = f"""SELECT * FROM (SELECT *, CASE WHEN count(*) OVER () <= 75 THEN row_number() OVER (ORDER BY fs, row_id) ELSE row_number() OVER (ORDER BY sim DESC, row_id) END AS place
 FROM (SELECT *, min(row_id) OVER (PARTITION BY headword_lc) AS fs, round(list_cosine_similarity(vec, q), 6) AS sim FROM {_VECTORS}, {_FIRST_VECTOR} WHERE {_FITS})) WHERE place <= 75"""
_add("search_combined_e2e", _meaning(f"s*:{MEANING_TEXT}", top_n=10), _meaning_sql(_COMBINED_POOL, 10))



def _many(s: SparkSession, d: str) -> DataFrame:
    """The definitions and vectors of the stated query set, asked all at once."""
    index = embedded_senses(s, d)
    queries = index.filter((F.col("row_id") % 20 == 0) & F.col("definition").isNotNull()).select(F.col("row_id").alias("query_id"), F.col("definition").alias("text"), F.col("embedding").alias("vec"))
    return Lexicon(index).search_many(queries, top_n=15).select("query_id", "rank", "row_id", "score", "relevance")


_WORDS_OF = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^a-z0-9]+'), lambda w: w <> ''))"
_add(
    "search_many",
    _many,
    f"""WITH v AS {_VECTORS}, q AS (SELECT row_id AS query_id, definition AS text, vec AS q FROM v WHERE row_id % 20 = 0 AND definition IS NOT NULL),
 p AS (SELECT * FROM (SELECT v.*, query_id, text, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(vec, q), 6) DESC, row_id) AS place FROM v, q) WHERE place <= 75),
 c AS (SELECT *, round(CASE WHEN len({_WORDS_OF.format("text")}) > 0 THEN len(list_intersect({_WORDS_OF.format("definition")}, {_WORDS_OF.format("text")})) * 10.0 / len({_WORDS_OF.format("text")}) ELSE 0.0 END + coalesce(zipf, 0.0), 6) AS score FROM p),
 b AS (SELECT *, row_number() OVER (PARTITION BY query_id, headword_lc ORDER BY score DESC, place) AS n, min(place) OVER (PARTITION BY query_id, headword_lc) AS seen FROM c),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS rank FROM b WHERE n = 1 AND headword_lc <> lower(text))
 SELECT query_id, rank, row_id, score, round_even(100 * (1 / (1 + exp(-score))), 0)::INT AS relevance FROM r WHERE rank <= 15""",
)

# --- emotions, flat rows and lines ---


def _emotions(s: SparkSession, d: str) -> DataFrame:
    cols = emotion_columns(F.col("source"), F.col("sentiwordnet"), F.col("emolex"))
    return metadata(s, d).select("row_id", *[c.alias(n) for n, c in cols.items()])


_add("emotion_tag", _emotions, f"SELECT row_id, label, polarity, emotion_source FROM ({_emotion_sql('metadata')})")


def _rows(s: SparkSession, d: str) -> DataFrame:
    rows = Lexicon(embedded_index(s, d)).search("coarse", vector=first_vector(s, d), top_n=20).rows()
    return rows.select("position", "headword", "pos", "label", "polarity", F.array_join("synonyms", ",").alias("synonyms"), "relevance", "is_exact")


_EXACT = f"SELECT * FROM {_VECTORS} WHERE headword_lc = 'coarse' ORDER BY row_id LIMIT 1"
_COARSE_WORDS = "len(list_distinct(list_intersect(regexp_split_to_array(lower(coalesce(definition, '')), '[^a-z0-9]+'), ['coarse']))) * 10.0"
_COARSE = f"""(SELECT * EXCLUDE (place), row_number() OVER (ORDER BY score DESC, seen) AS place, round_even(100 * (1 / (1 + exp(-score))), 0)::INT AS relevance FROM (SELECT *, row_number() OVER (PARTITION BY headword_lc ORDER BY score DESC, place) AS n,
 min(place) OVER (PARTITION BY headword_lc) AS seen FROM (SELECT *, round({_COARSE_WORDS} + coalesce(zipf, 0.0), 6) AS score FROM ({_pool_sql(75)}))) WHERE n = 1 AND headword_lc <> 'coarse' ORDER BY score DESC, seen LIMIT 20)"""
_JOINED = "coalesce(list_aggregate(synonyms, 'string_agg', ','), '')"
_add(
    "result_rows_flat",
    _rows,
    f"""SELECT row_number() OVER (ORDER BY place) - 1 AS position, headword, pos, label, polarity, synonyms, relevance, is_exact FROM (
 SELECT 0 AS place, 'coarse' AS headword, pos, label, polarity, {_JOINED} AS synonyms, 100 AS relevance, true AS is_exact FROM ({_emotion_sql(f'({_EXACT})')})
 UNION ALL SELECT place, headword, pos, label, polarity, {_JOINED}, relevance, false FROM ({_emotion_sql(_COARSE)}))""",
)
_LINE_ROWS = _emotion_sql(f"({_structural_base(_TH, 30)})")
_TAB = "chr(9)"
_add(
    "result_lines",
    lambda s, d: Lexicon(sense_index(s, d)).search("th*", top_n=30).rows().select("position", result_line(F.col("position")).alias("line")),
    f"""SELECT place - 1 AS position, '  ' || headword || {_TAB} || '(' || coalesce(pos, '') || ') ' || coalesce(CASE WHEN len(definition) > 70 THEN definition[1:67] || '...' ELSE definition END, '') || {_TAB}
 || '[' || label || ' · ' || polarity || ']' || {_TAB} || relevance || '%' || {_TAB} || (place - 1) || {_TAB} || headword AS line FROM ({_LINE_ROWS})""",
)
_add(
    "result_previews",
    lambda s, d: Lexicon(sense_index(s, d)).search("th*", top_n=30).candidates.select("rank", candidate_preview().alias("preview")),
    f"""SELECT place AS rank, concat_ws(chr(10), headword || ' (' || coalesce(pos, '') || ')', '', coalesce(definition, ''), '', 'Emotion: ' || label || ' · ' || polarity, 'Match confidence: ' || relevance || '%',
 CASE WHEN len(synonyms) > 0 THEN 'Synonyms: ' || list_aggregate(synonyms, 'string_agg', ', ') END,
 CASE WHEN len(examples) > 0 THEN chr(10) || list_aggregate(list_transform(examples, lambda x: '"' || x || '"'), 'string_agg', chr(10)) END) AS preview FROM ({_LINE_ROWS})""",
)

# --- ingest ---


def _gloss(s: SparkSession, d: str) -> DataFrame:
    kept = wiktionary_senses(table(s, d, "wiktextract_raw"), carry=("line_no",))
    return kept.select("line_no", "sense_no", "headword", "pos", "definition", F.array_join("examples", "|").alias("examples"), F.array_join("tags", "|").alias("tags"))


_AS_LIST = "CASE WHEN {0} IS NULL OR json_type({0}) = 'NULL' THEN NULL WHEN json_type({0}) = 'ARRAY' THEN json_extract({0}, '$[*]') ELSE [{0}] END"
_TEXTS = "coalesce(list_transform(list_filter({0}, lambda x: json_type(x) = 'VARCHAR'), lambda x: x ->> '$'), [])"
_add(
    "ingest_wiktionary",
    _gloss,
    f"""WITH e AS (SELECT line_no, line::JSON AS j FROM (SELECT line_no, line FROM wiktextract_raw WHERE line IS NOT NULL AND coalesce(json_valid(line), false)) WHERE json_type(line) = 'OBJECT'),
 k AS (SELECT line_no, j ->> '$.word' AS word, j ->> '$.pos' AS pos, {_AS_LIST.format("json_extract(j, '$.senses')")} AS l FROM e WHERE j ->> '$.lang_code' = 'en' AND j ->> '$.word' <> '' AND j ->> '$.pos' <> ''),
 s AS (SELECT line_no, word, pos, unnest(l) AS s, (unnest(generate_series(1, len(l))) - 1)::INT AS sense_no FROM k),
 t AS (SELECT line_no, sense_no, word, pos, {_TEXTS.format(_AS_LIST.format("json_extract(s, '$.tags')"))} AS tags, {_TEXTS.format(_AS_LIST.format("json_extract(s, '$.glosses')"))} AS glosses,
  {_AS_LIST.format("json_extract(s, '$.form_of')")} AS forms, list_filter(list_transform(coalesce({_AS_LIST.format("json_extract(s, '$.examples')")}, []), lambda x: x ->> '$.text'), lambda x: x <> '') AS examples FROM s)
 SELECT line_no, sense_no, word AS headword, CASE pos WHEN 'adj' THEN 'adjective' WHEN 'adv' THEN 'adverb' ELSE pos END AS pos,
 CASE WHEN len(glosses) = 1 THEN glosses[1] ELSE list_aggregate(list_transform(glosses, lambda g: regexp_replace(g, '\\.+$', '')), 'string_agg', '; ') || '.' END AS definition,
 coalesce(list_aggregate(examples, 'string_agg', '|'), '') AS examples, coalesce(list_aggregate(tags, 'string_agg', '|'), '') AS tags
 FROM t WHERE forms IS NULL AND len(glosses) > 0 AND NOT list_contains(tags, 'form-of') AND NOT list_contains(tags, 'alt-of')""",
)


def _merged(s: SparkSession, d: str) -> DataFrame:
    rows = metadata(s, d).withColumn("ordinal", F.col("row_id"))
    merged = merge_records(rows.filter("source = 'wordnet'"), rows.filter("source = 'wiktionary'"))
    return merged.select("row_id", "source_rank")


def _norm_sql(c: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({c}, '')), '{_WS}+', ' ', 'g'), ' ')"


_add(
    "merge_dedupe",
    _merged,
    f"""WITH k AS (SELECT row_id, source, {_norm_sql('headword')} AS h, {_norm_sql('definition')} AS d FROM metadata),
 w AS (SELECT * FROM k WHERE source = 'wordnet'), x AS (SELECT *, row_number() OVER (PARTITION BY h, d ORDER BY row_id) AS n FROM k WHERE source = 'wiktionary')
 SELECT row_id, 0 AS source_rank FROM w UNION ALL SELECT row_id, 1 FROM x WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM w WHERE w.h = x.h AND w.d = x.d)""",
)
_YEARS = "list_filter(coalesce(year_counts, []), lambda y: coalesce(regexp_full_match(y, '[0-9]{1,18},[0-9]{1,18},[0-9]{1,18}'), false))"
_RECENT = f"coalesce(list_sum(list_transform(list_filter({_YEARS}, lambda y: string_split(y, ',')[1]::BIGINT BETWEEN {NGRAM_WINDOW[0]} AND {NGRAM_WINDOW[1]}), lambda y: string_split(y, ',')[2]::BIGINT)), 0)::BIGINT"
_WORD = r"lower(regexp_replace(token, '_(NOUN|VERB|ADJ|ADV|PRON|DET|ADP|NUM|CONJ|PRT|X)[ \t\n\x0b\f\r]*$', ''))"
_add(
    "ngram_recent_sum",
    lambda s, d: table(s, d, "ngram_counts").select("ngram_id", recent_count(F.col("year_counts")).alias("n")),
    f"SELECT ngram_id, {_RECENT} AS n FROM ngram_counts",
)
_COUNTS = f"(SELECT {_WORD} AS word, sum({_RECENT})::BIGINT AS n FROM ngram_counts WHERE token <> '' AND {_RECENT} > 0 GROUP BY 1)"
_add("ngram_word_counts", lambda s, d: word_counts(table(s, d, "ngram_counts")), f"SELECT word, n FROM {_COUNTS}")


def _stream(s: SparkSession, d: str) -> DataFrame:
    """The same counts from a stream over the table's files."""
    path = Path(f"{d}/ngram_counts.parquet")
    source = s.readStream.schema("token STRING, year_counts ARRAY<STRING>")
    if path.is_file():
        source = source.option("pathGlobFilter", path.name)
    return run_to_table(running_counts(source.parquet(d if path.is_file() else str(path))), "stream-counts")


_add("stream_word_counts", _stream, SQL["ngram_word_counts"])


def _zipf(s: SparkSession, d: str) -> DataFrame:
    """Frequencies of vocabulary words; the total is that of all words' recent counts, which are added up once."""
    counts = written_table(word_counts(table(s, d, "ngram_counts")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 1
    known = table(s, d, "vocabulary").select(F.lower("word").alias("word")).distinct()
    return zipf_scale(counts.join(known, "word", "left_semi"), total).select("word", F.round("zipf", 6).alias("zipf"))


_add("zipf_frequency", _zipf, f"SELECT word, round(log10(n / (SELECT sum(n) FROM {_COUNTS})::DOUBLE * 1e9), 6) AS zipf FROM {_COUNTS} WHERE word IN (SELECT lower(word) FROM vocabulary)")
_add("word_index_build", lambda s, d: headwords(metadata(s, d)), f"SELECT headword_lc, first_row, n_rows FROM {_FIRSTS}")
_add("group_by_definition", lambda s, d: unique_definitions(metadata(s, d)), "SELECT definition, min(row_id) AS first_row, count(*) AS n_rows FROM metadata GROUP BY definition")
_add("distinct_headwords", lambda s, d: metadata(s, d).filter("headword IS NOT NULL").select(F.lower("headword").alias("word")).distinct(), "SELECT DISTINCT lower(headword) AS word FROM metadata WHERE headword IS NOT NULL")
_add(
    "first_spellings",
    lambda s, d: first_spellings(metadata(s, d)),
    "SELECT lower(headword) AS headword_lc, pos, arg_min(headword, row_id) AS spelling FROM metadata GROUP BY 1, 2",
)
_add(
    "enrich_emolex",
    lambda s, d: with_emotions(metadata(s, d), table(s, d, "emolex")).select("row_id", F.array_join(F.array_sort("emolex"), ",").alias("labels")),
    "SELECT m.row_id, list_aggregate(list_sort(e.labels), 'string_agg', ',') AS labels FROM metadata m LEFT JOIN emolex e ON lower(m.headword) = e.word",
)
_add(
    "enrich_zipf",
    lambda s, d: with_frequency(metadata(s, d), table(s, d, "literary_frequency")).select("row_id", "zipf"),
    "SELECT m.row_id, f.zipf FROM metadata m LEFT JOIN literary_frequency f ON lower(m.headword) = f.word",
)
_add(
    "vector_norms",
    lambda s, d: table(s, d, "sense_embeddings").filter("embedding IS NOT NULL").select("row_id", F.round(norm(F.col("embedding")), 6).alias("norm")),
    "SELECT row_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM sense_embeddings WHERE embedding IS NOT NULL",
)

# --- what is written and read back ---

_add(
    "index_read",
    lambda s, d: sense_index(s, d).select("row_id", "headword_lc", F.round("zipf", 6).alias("zipf"), "first", F.size(F.coalesce("synonyms", F.array().cast("array<string>"))).alias("n_synonyms"), F.round("norm", 6).alias("norm")),
    f"""SELECT row_id, headword_lc, round(zipf, 6) AS zipf, first, coalesce(len(synonyms), 0)::INT AS n_synonyms, round(sqrt(list_sum(list_transform(vec, lambda x: x * x))), 6) AS norm
 FROM {_INDEX} LEFT JOIN {_USABLE} USING (row_id)""",
)
_add("word_index_read", lambda s, d: read_word_index(s, index_path(s, d)), f"SELECT headword_lc, first_row, n_rows FROM {_FIRSTS}")
_add("frequency_read", lambda s, d: read_frequency(s, f"{index_path(s, d)}/frequency"), "SELECT word, zipf FROM literary_frequency")
_JOINED_IDS = "list_aggregate(list(row_id ORDER BY row_id), 'string_agg', ',') AS ids"
_add(
    "word_index_rows",
    lambda s, d: row_lists(metadata(s, d).filter("headword IS NOT NULL"), F.lower("headword"), "headword_lc").withColumn("ids", F.array_join("ids", ",")),
    f"SELECT lower(headword) AS headword_lc, row_id // 100000 AS block, {_JOINED_IDS} FROM metadata WHERE headword IS NOT NULL GROUP BY 1, 2",
)
_add(
    "definition_rows",
    lambda s, d: row_lists(metadata(s, d), F.col("definition"), "definition").withColumn("ids", F.array_join("ids", ",")),
    f"SELECT definition, row_id // 100000 AS block, {_JOINED_IDS} FROM metadata GROUP BY 1, 2",
)


def _wordnet(s: SparkSession, d: str) -> DataFrame:
    """Synsets and their sentiment written as JSON lines and read as a dictionary dump: a row for each lemma."""
    rows = metadata(s, d).filter("synset IS NOT NULL AND headword IS NOT NULL")
    lemmas = F.array_sort(F.collect_set(F.translate("headword", " ", "_"))).alias("lemmas")  # the lemmas of one synset
    synsets = rows.groupBy("synset").agg(F.min(F.substring("pos", 1, 1)).alias("pos"), F.min("definition").alias("definition"), lemmas)
    scores = rows.filter("sentiwordnet IS NOT NULL").groupBy("synset").agg(*[F.max(f"sentiwordnet.{c}").alias(c) for c in ("pos", "neg", "obj")])
    path = shared_path(s, "wordnet")
    synsets.write.json(f"{path}/synsets")
    scores.write.json(f"{path}/scores")
    read = read_wordnet(s, f"{path}/synsets", f"{path}/scores")
    return read.select("synset", "lemma_no", "headword", "pos", "definition", F.array_join("synonyms", "|").alias("synonyms"), F.col("sentiwordnet.pos").alias("positive"))


_add(
    "wordnet_read",
    _wordnet,
    """WITH r AS (SELECT * FROM metadata WHERE synset IS NOT NULL AND headword IS NOT NULL),
 y AS (SELECT synset, min(pos[1]) AS p, min(definition) AS definition, list_transform(list_sort(list_distinct(list(replace(headword, ' ', '_')))), lambda x: replace(x, '_', ' ')) AS names FROM r GROUP BY synset),
 c AS (SELECT synset, max(sentiwordnet.pos) AS positive FROM r WHERE sentiwordnet IS NOT NULL GROUP BY synset),
 e AS (SELECT synset, p, definition, names, unnest(names) AS headword, (unnest(generate_series(1, len(names))) - 1)::INT AS lemma_no FROM y)
 SELECT synset, lemma_no, headword, CASE p WHEN 'n' THEN 'noun' WHEN 'v' THEN 'verb' WHEN 'a' THEN 'adjective' WHEN 's' THEN 'adjective' WHEN 'r' THEN 'adverb' ELSE p END AS pos, definition,
 coalesce(list_aggregate(list_filter(names, lambda x: x <> headword), 'string_agg', '|'), '') AS synonyms, positive FROM e LEFT JOIN c USING (synset)""",
)
_PLAIN_TOKEN = r"^[^\s\x00-\x1f\x{85}\x{2028}\x{2029}]+$"


def _ngram_lines(s: SparkSession, d: str) -> str:
    """The counts as lines of token and tab-separated years, of tokens without white space or control characters."""
    path = shared_path(s, "ngrams")
    rows = table(s, d, "ngram_counts").filter(F.col("token").rlike(_PLAIN_TOKEN) & (F.size("year_counts") > 0))
    rows.select(F.concat_ws("\t", F.array("token"), F.transform("year_counts", lambda y: F.coalesce(y, F.lit(""))))).write.text(path)
    return path


_PLAIN_SQL = f"(SELECT * FROM ngram_counts WHERE regexp_matches(token, '{_PLAIN_TOKEN}') AND len(year_counts) > 0)"
_add("ngrams_read", lambda s, d: word_counts(read_ngrams(s, _ngram_lines(s, d))), f"SELECT {_WORD} AS word, sum({_RECENT})::BIGINT AS n FROM {_PLAIN_SQL} WHERE {_RECENT} > 0 GROUP BY 1")


def _total(s: SparkSession, d: str) -> DataFrame:
    """Totals of each year written as a tab-separated file; the sum of the recent ones read from it."""
    fields = F.split("y", ",")
    years = table(s, d, "ngram_counts").select(F.explode("year_counts").alias("y")).filter(F.col("y").rlike("^[0-9]{1,4},[0-9]{1,18},[0-9]{1,18}$"))
    totals = years.groupBy(fields[0].cast("int").alias("year")).agg(F.sum(fields[1].cast("long")).alias("n"))
    path = shared_path(s, "totals")
    totals.select(F.concat(F.lit("\t"), F.concat_ws(",", "year", "n", F.lit(1), F.lit(1)))).write.text(path)
    return s.range(1).select(F.lit(corpus_total(s, path)).cast("long").alias("total"))


_add("corpus_total_read", _total, f"SELECT coalesce(sum({_RECENT}), 0)::BIGINT AS total FROM ngram_counts")

# --- pronunciation ---

_PH = "phonetics.phonemes"
_LAST = f"list_transform({_PH}, lambda p: right(p, 1))"
_AT = f"coalesce(nullif(list_position({_LAST}, '1'), 0), nullif(list_position(list_transform({_LAST}, lambda c: regexp_matches(c, '[0-9]')), true), 0), 1)"
_BARE = f"list_transform({_PH}, lambda p: regexp_replace(p, '[012]+$', ''))"


def _derived(s: SparkSession, d: str) -> DataFrame:
    p = derive(F.col(_PH), F.col("phonetics.syllable_count"), F.lit(0), F.array().cast("array<int>"))
    return metadata(s, d).filter(F.size(_PH) > 0).select("row_id", p.alias("p")).select("row_id", "p.primary_vowel", "p.rhyme_key", "p.meter")


_add(
    "phonetic_derive",
    _derived,
    f"""SELECT row_id, list_extract({_BARE}, {_AT}) AS primary_vowel, list_aggregate(list_slice({_BARE}, {_AT}, len({_PH})), 'string_agg', ' ') AS rhyme_key,
 CASE WHEN phonetics.syllable_count > 0 THEN '/' || repeat('x', phonetics.syllable_count - 1) ELSE '' END AS meter FROM metadata WHERE len({_PH}) > 0""",
)
_KNOWN = f"FROM metadata WHERE lower(headword) = 'set' AND len({_PH}) > 0 ORDER BY coalesce(pos <> 'noun', true), row_id LIMIT 1"
_add("search_rhymes_with", _structural("*e*", top_n=60, rhymes_with="set"), _structural_sql(f"headword_lc LIKE '%e%' AND NOT regexp_matches(headword_lc, '\\n[\\s\\S]') AND phonetics.rhyme_key = (SELECT phonetics.rhyme_key {_KNOWN})", 60))
_SOUND_CODE = "list_aggregate(list_transform({0}, lambda p: coalesce(list_extract(map_extract(MAP {{{1}}}, regexp_replace(p, '[012]+$', '')), 1), '?')), 'string_agg', '')"
_OWN_CODE, _SET_CODE = _SOUND_CODE.format(_PH, _CODES), f"(SELECT {_SOUND_CODE.format(_PH, _CODES)} {_KNOWN})"
_add("search_sounds_like", _structural("*e*", top_n=60, sounds_like="set"), _structural_sql(f"headword_lc LIKE '%e%' AND NOT regexp_matches(headword_lc, '\\n[\\s\\S]') AND len({_PH}) > 0 AND levenshtein({_OWN_CODE}, {_SET_CODE}) / greatest(len({_OWN_CODE}), len({_SET_CODE}), 1) <= 0.34", 60))


def _best(s: SparkSession, d: str) -> DataFrame:
    scores = F.array(*[F.struct(F.lit(label).alias("label"), F.col(f"sentiwordnet.{c}").alias("score")) for label, c in (("Positive", "pos"), ("Negative", "neg"), ("Neutral", "obj"))])
    return metadata(s, d).filter("sentiwordnet.pos IS NOT NULL AND sentiwordnet.neg IS NOT NULL AND sentiwordnet.obj IS NOT NULL").select("row_id", best_label(scores).alias("label"))


_add(
    "best_label",
    _best,
    """SELECT row_id, CASE WHEN sentiwordnet.pos >= sentiwordnet.neg AND sentiwordnet.pos >= sentiwordnet.obj THEN 'positive' WHEN sentiwordnet.neg >= sentiwordnet.obj THEN 'negative' ELSE 'neutral' END AS label
 FROM metadata WHERE sentiwordnet.pos IS NOT NULL AND sentiwordnet.neg IS NOT NULL AND sentiwordnet.obj IS NOT NULL""",
)

# --- evaluation ---


def _recall(s: SparkSession, d: str) -> DataFrame:
    """Cases: rows of the stated query set; their top words are the headwords of their nearest senses."""
    senses = metadata(s, d).filter("headword IS NOT NULL").select("row_id", F.lower("headword").alias("word"), "source", "synset")
    found = _batch(s, d, 10)
    cases = senses.filter(F.col("source").isNotNull()).join(found.select(F.col("query_id").alias("row_id")).distinct(), "row_id").select(F.col("row_id").alias("case_id"), "source", "word")
    top = found.join(senses.select(F.col("row_id").alias("key"), "word"), "key").select(F.col("query_id").alias("case_id"), "rank", "word")
    forms = synonym_forms(metadata(s, d).select("headword", "synset"))
    return recall(case_ranks(top, cases, forms))


_add(
    "recall_at_k",
    _recall,
    f"""WITH b AS ({_BATCH_SQL}), m AS (SELECT row_id, lower(headword) AS word, source FROM metadata WHERE headword IS NOT NULL),
 l AS (SELECT DISTINCT synset, lower(replace(headword, '_', ' ')) AS form FROM metadata WHERE synset IS NOT NULL AND headword IS NOT NULL),
 f AS (SELECT DISTINCT x.form AS word, y.form FROM l x JOIN l y USING (synset)),
 c AS (SELECT DISTINCT m.row_id AS case_id, m.source, m.word FROM m JOIN b ON b.query_id = m.row_id WHERE m.source IS NOT NULL),
 r AS (SELECT c.case_id, c.source, min(b.rank) FILTER (n.word = c.word) AS e, min(b.rank) FILTER (n.word = c.word OR f.form IS NOT NULL) AS s
  FROM c LEFT JOIN (b JOIN m n ON b.row_id = n.row_id) ON b.query_id = c.case_id LEFT JOIN f ON f.word = c.word AND f.form = n.word GROUP BY 1, 2)
 SELECT source, count(*) AS cases, count(e) AS exact_hits, count(s) AS either_hits FROM r GROUP BY ROLLUP (source)""",
)
