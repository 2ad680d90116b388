"""Schemas of the sense index, of its sources and of results, as DDL."""

from __future__ import annotations

PHONETICS = "STRUCT<syllable_count: INT, primary_vowel: STRING, rhyme_key: STRING, meter: STRING, phonemes: ARRAY<STRING>>"
SENTIMENT = "STRUCT<pos: DOUBLE, neg: DOUBLE, obj: DOUBLE>"
#: what merging yields and enrichment extends
RECORD = f"headword STRING, pos STRING, definition STRING, examples ARRAY<STRING>, source STRING, synset STRING, sentiwordnet {SENTIMENT}, synonyms ARRAY<STRING>, tags ARRAY<STRING>"
WORDNET = "synset STRING, pos STRING, definition STRING, examples ARRAY<STRING>, lemmas ARRAY<STRING>"
SENTIMENT_ROWS = "synset STRING, pos DOUBLE, neg DOUBLE, obj DOUBLE"
WIKTIONARY_LINE = "word STRING, pos STRING, lang_code STRING, senses ARRAY<STRUCT<glosses: ARRAY<STRING>, tags: ARRAY<STRING>, form_of: ARRAY<STRUCT<word: STRING>>, examples: ARRAY<STRUCT<text: STRING>>>>"
FREQUENCY = "word STRING, zipf DOUBLE"
EMOTIONS = "word STRING, labels ARRAY<STRING>"
#: columns of the index, in order
SENSE_COLUMNS = ("row_id", "headword", "headword_lc", "pos", "definition", "examples", "source", "sentiwordnet", "emolex", "synonyms", "tags", "phonetics", "zipf", "first", "embedding", "norm")
#: keys of a candidate, in order
CANDIDATE = ("headword", "pos", "definition", "examples", "label", "polarity", "relevance", "stress", "synonyms", "tags", "phonetics")
#: keys of a flat result row, in order
RESULT_ROW = ("headword", "pos", "definition", "stress", "label", "polarity", "synonyms", "examples", "relevance", "is_exact")
