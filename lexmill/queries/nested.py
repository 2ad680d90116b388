"""Queries of the nested-record operator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators.nested import ITEM_KINDS, flatten_entries, links, read_table, write_tables
from lexmill.session import shared_path, table


def _tables(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the flat tables, which are written once."""
    path = shared_path(spark, "entries")
    write_tables(flatten_entries(table(spark, sf_dir, "wiktextract_raw")), path)
    return path


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _tables(spark, sf_dir)
    return reduce(DataFrame.unionByName, [read_table(spark, path, kind).select("line_no", "sense_no", F.lit(kind).alias("item_kind"), "item_no") for kind in ITEM_KINDS])


def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each flat table, with the rows whose parent stands in its table."""
    return links(spark, _tables(spark, sf_dir))


_AS_LIST = "CASE WHEN {0} IS NULL OR json_type({0}) = 'NULL' THEN [] WHEN json_type({0}) = 'ARRAY' THEN json_extract({0}, '$[*]') ELSE [{0}] END"
_USABLE = r"json_type(t) = 'VARCHAR' AND regexp_matches(t ->> '$', '[^\s\x0b\x1c-\x1f\x{85}\p{Z}]')"
_KINDS = {"gloss": ("glosses", None), "tag": ("tags", None), "example": ("examples", "text"), "form_of": ("form_of", "word")}


def _kind_sql(kind: str) -> str:
    field, inner = _KINDS[kind]
    text = f"CASE WHEN json_type(x) = 'OBJECT' THEN json_extract(x, '$.{inner}') ELSE x END" if inner else "x"
    return f"""SELECT line_no, sense_no, '{kind}' AS item_kind, item_no FROM (SELECT line_no, sense_no, item_no, {text} AS t FROM
 (SELECT line_no, sense_no, unnest(items) AS x, (unnest(generate_series(1, len(items))) - 1)::INT AS item_no FROM
 (SELECT line_no, sense_no, {_AS_LIST.format(f"json_extract(s, '$.{field}')")} AS items FROM senses WHERE json_type(s) = 'OBJECT'))) WHERE {_USABLE}"""


_LISTS_SQL = f"""WITH entries AS (SELECT line_no, line::JSON AS j FROM (SELECT line_no, line FROM wiktextract_raw WHERE line IS NOT NULL AND coalesce(json_valid(line), false)) WHERE json_type(line) = 'OBJECT'),
 lists AS (SELECT line_no, {_AS_LIST.format("json_extract(j, '$.senses')")} AS l FROM entries),
 senses AS (SELECT line_no, unnest(l) AS s, (unnest(generate_series(1, len(l))) - 1)::INT AS sense_no FROM lists)"""
_FOUND_SQL = f"""{_LISTS_SQL}
 {" UNION ALL ".join(_kind_sql(k) for k in _KINDS)}"""

_LINKS_SQL = f"""{_LISTS_SQL}, items AS ({" UNION ALL ".join(_kind_sql(k) for k in _KINDS)})
 SELECT 'entry' AS tag, count(*) AS n_rows, 0::BIGINT AS n_linked, count(DISTINCT line_no) AS n_lines FROM entries
 UNION ALL SELECT 'sense', count(*), count(*), count(DISTINCT line_no) FROM senses WHERE json_type(s) = 'OBJECT'
 UNION ALL SELECT item_kind, count(*), count(*), count(DISTINCT line_no) FROM items GROUP BY item_kind"""

QUERIES = {"p2_found": p2_found, "p2_links": p2_links}
SQL = {"p2_found": _FOUND_SQL, "p2_links": _LINKS_SQL}
