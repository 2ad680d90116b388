"""One query from the command line: JSON lines, tab-separated lines or a table."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from lexmill.functions.models import HashedEmbedder
from lexmill.functions.phonetics import ARPABET_VOWELS
from lexmill.operators.filters import CATEGORIES
from lexmill.operators.order import SORT_MODES
from lexmill.plans.search import CLI_TOP_N, Lexicon, SearchRequest
from lexmill.schema import RESULT_ROW
from lexmill.session import local_session
from lexmill.sources.sinks import read_index, result_line, static_table


def meter_pattern(value: str) -> str:
    if not value or value.strip("/x"):
        raise argparse.ArgumentTypeError(f"a meter has only / and x: {value!r}")
    return value


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexmill", description="Search a sense index.")
    p.add_argument("query", nargs="*", help="a word, a description or a pattern; standard input without one")
    p.add_argument("--index", required=True, help="folder of the index")
    p.add_argument("-n", type=int, default=CLI_TOP_N)
    p.add_argument("--sort", choices=SORT_MODES)
    p.add_argument("--category", choices=CATEGORIES)
    p.add_argument("--syllables", type=int)
    p.add_argument("--primary-vowel", type=str.upper, choices=ARPABET_VOWELS)
    p.add_argument("--rhymes-with")
    p.add_argument("--sounds-like")
    p.add_argument("--meter", type=meter_pattern)
    p.add_argument("--format", choices=("table", "jsonl", "lines"), default="table")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    query = " ".join(args.query) or sys.stdin.readline().strip()
    if not query:
        return 0
    spark = local_session()
    request = SearchRequest(query, args.n, args.sort, args.category, args.syllables, args.primary_vowel, args.rhymes_with, args.sounds_like, args.meter)
    try:
        index = read_index(spark, args.index)
        vector = index.filter("embedding IS NOT NULL").select(F.size("embedding").alias("dim")).first()
        rows = Lexicon(index, HashedEmbedder(vector["dim"]) if vector else None).search(request).rows().orderBy("position")
    except ValueError as problem:
        print(problem, file=sys.stderr)
        return 2
    if args.format == "table":
        print(static_table([r.asDict() for r in rows.collect()]))
    else:
        lines = rows.select(F.to_json(F.struct(*RESULT_ROW), {"ignoreNullFields": "false"}) if args.format == "jsonl" else result_line(F.col("position")))
        for (line,) in lines.collect():  # the rows of one result
            print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
