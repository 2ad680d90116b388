"""Deeply nested records into flat, linked tables.

One pass over the lines: a depth-first visitor emits (tag, primary key, parent key, payload) for every object it meets.
The tagged rows are written partitioned by tag and each table is read back under its own schema, so that any number of
tables costs one parse of the input and no shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: item field -> (item kind, field of an element that holds its text; None where the element itself must be a string)
ITEM_FIELDS = {
    "glosses": ("gloss", None),
    "tags": ("tag", None),
    "examples": ("example", "text"),
    "form_of": ("form_of", "word"),
}
ITEM_KINDS = tuple(kind for kind, _ in ITEM_FIELDS.values())

TAGGED_SCHEMA = T.StructType(
    [
        T.StructField("tag", T.StringType()),
        T.StructField("pk", T.StringType()),
        T.StructField("parent", T.StringType()),
        T.StructField("line_no", T.LongType()),
        T.StructField("sense_no", T.IntegerType()),
        T.StructField("item_no", T.IntegerType()),
        T.StructField("payload", T.StringType()),
    ]
)
_ARROW = pa.schema(
    [
        ("tag", pa.string()),
        ("pk", pa.string()),
        ("parent", pa.string()),
        ("line_no", pa.int64()),
        ("sense_no", pa.int32()),
        ("item_no", pa.int32()),
        ("payload", pa.string()),
    ]
)

#: payload schema of each table; the payload of an item is its text
PAYLOADS = {
    "entry": "word STRING, pos STRING, lang STRING, lang_code STRING",
    "sense": "n_glosses INT, n_tags INT, n_examples INT, n_form_of INT",
}


_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?")
_NAMED = {"true": True, "false": False, "null": None}


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


def _utf8(text: str) -> str:
    """Lone surrogates, which JSON escapes may hold, as the replacement character."""
    try:
        text.encode()
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text


def parse_deep(text: str) -> object:
    """The JSON value of a text nested however deeply, or None if it is none."""
    try:
        return _parse_deep(text)
    except (ValueError, IndexError):
        return None


def _parse_deep(text: str) -> object:
    skip = lambda at: _SPACE.match(text, at).end()

    def key(at: int) -> tuple[str, int]:
        if text[at] != '"':
            raise ValueError("no key")
        found, at = scanstring(text, at + 1, True)
        at = skip(at)
        if text[at] != ":":
            raise ValueError("no colon")
        return found, skip(at + 1)

    open_: list[tuple[dict | list, str | None]] = []
    at = skip(0)
    while True:
        c = text[at]
        if c in "{[":
            inner, name, at = {} if c == "{" else [], None, skip(at + 1)
            if text[at] != ("}" if c == "{" else "]"):
                if c == "{":
                    name, at = key(at)
                open_.append((inner, name))
                continue
            value, at = inner, at + 1
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
        elif found := _SCALAR.match(text, at):
            value, at = _NAMED[found[0]] if found[0] in _NAMED else float(found[0]), found.end()
        else:
            raise ValueError("no value")
        while open_:
            outer, name = open_[-1]
            if isinstance(outer, dict):
                outer[name] = value
            else:
                outer.append(value)
            at = skip(at)
            if text[at] == ",":
                at = skip(at + 1)
                if isinstance(outer, dict):
                    name, at = key(at)
                    open_[-1] = outer, name
                break
            if text[at] != ("}" if isinstance(outer, dict) else "]"):
                raise ValueError("not closed")
            open_.pop()
            value, at = outer, at + 1
        else:
            if skip(at) != len(text):
                raise ValueError("more than one value")
            return value


def parse_object(line: str | None) -> dict | None:
    """The line's object, or None if the line isn't one whole JSON object."""
    if line is None:
        return None
    try:
        value = json.loads(line, parse_constant=_no_constant, parse_int=float)  # as int, long ones are refused; numbers are no items
    except RecursionError:
        value = parse_deep(line)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def as_list(value: object) -> list:
    """Absent values hold nothing; a lone value counts as a list of one."""
    if value is None:
        return []
    return value if isinstance(value, list) else [value]


def item_text(element: object, field: str | None) -> str | None:
    """The text of a usable item, else None."""
    if field is not None and isinstance(element, dict):
        element = element.get(field)
    return element if isinstance(element, str) and element.strip() else None


def visit(line_no: int, line: str | None) -> Iterator[tuple]:
    """Depth first: the entry, then each of its senses followed by the sense's items."""
    entry = parse_object(line)
    if entry is None:
        return
    text = lambda key: _utf8(entry[key]) if isinstance(entry.get(key), str) else None
    pk = str(line_no)
    yield "entry", pk, None, line_no, None, None, json.dumps({k: text(k) for k in ("word", "pos", "lang", "lang_code")}, ensure_ascii=False)
    for sense_no, sense in enumerate(as_list(entry.get("senses"))):
        if not isinstance(sense, dict):
            continue
        sense_pk = f"{pk}.{sense_no}"
        lists = {field: as_list(sense.get(field)) for field in ITEM_FIELDS}
        yield "sense", sense_pk, pk, line_no, sense_no, None, json.dumps({f"n_{f}": len(v) for f, v in lists.items()})
        for field, (kind, inner) in ITEM_FIELDS.items():
            for item_no, element in enumerate(lists[field]):
                found = item_text(element, inner)
                if found is not None:
                    yield kind, f"{sense_pk}.{kind}.{item_no}", sense_pk, line_no, sense_no, item_no, _utf8(found)


def flatten_entries(lines: DataFrame, key: str = "line_no", line: str = "line", batch_rows: int = 20_000) -> DataFrame:
    """Tagged rows of every record. A null key or line, or a line that isn't one whole JSON object, yields nothing;
    repeated lines yield their rows once for each key; other columns are not read. Narrow: no shuffle, and batches of
    output are bounded, however long a line is."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for k, text in zip(batch.column(0), batch.column(1), strict=True):
                k = k.as_py()
                if k is None:
                    continue
                for row in visit(k, text.as_py()):
                    rows.append(row)
                    if len(rows) >= batch_rows:
                        yield _batch(rows)
                        rows = []
        if rows:
            yield _batch(rows)

    return lines.select(F.col(key).cast("long"), F.col(line).cast("string")).mapInArrow(emit, TAGGED_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def items(tagged: DataFrame) -> DataFrame:
    """The usable items with their positions as written."""
    return tagged.filter(F.col("tag").isin(*ITEM_KINDS)).select("line_no", "sense_no", F.col("tag").alias("item_kind"), "item_no", F.col("payload").alias("text"))


def write_tables(tagged: DataFrame, path: str) -> None:
    """One write for all tables, a folder for each tag."""
    tagged.write.mode("overwrite").partitionBy("tag").parquet(path)


def read_table(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """One flat table under its schema; only its folder is read."""
    rows = spark.read.schema(TAGGED_SCHEMA).parquet(path).filter(F.col("tag") == tag)
    keys = [F.col("pk").alias(f"{tag}_id"), F.col("parent").alias("parent_id"), "line_no", "sense_no", "item_no"]
    if tag in PAYLOADS:
        body = F.from_json("payload", PAYLOADS[tag])
        return rows.select(*keys, body.alias("body")).select(f"{tag}_id", "parent_id", "line_no", "sense_no", "body.*")
    return rows.select(*keys, F.col("payload").alias("text"))


def links(spark: SparkSession, path: str) -> DataFrame:
    """tag, n_rows, n_linked (rows whose parent exists) and n_lines of each table of a written folder that has rows."""
    found = []
    for tag, parent in [("entry", None), ("sense", "entry"), *[(kind, "sense") for kind in ITEM_KINDS]]:
        rows = read_table(spark, path, tag).select("parent_id", "line_no")
        if parent is None:
            rows = rows.withColumn("known", F.lit(None).cast("string"))
        else:
            known = read_table(spark, path, parent).select(F.col(f"{parent}_id").alias("known")).distinct()
            rows = rows.join(known, F.col("parent_id") == F.col("known"), "left")
        found.append(rows.select(F.lit(tag).alias("tag"), "line_no", "known"))
    return reduce(DataFrame.unionByName, found).groupBy("tag").agg(F.count("*").alias("n_rows"), F.count("known").alias("n_linked"), F.count_distinct("line_no").alias("n_lines"))
