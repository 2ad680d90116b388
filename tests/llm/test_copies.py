import random
from collections import defaultdict

from lexmill.llm.copies import collapse, members

SHAPE = "row_id long, headword string, pos string, definition string, source string"


def brute(rows):
    alnum = lambda s: "".join(c for c in s.lower() if c.isalnum())
    groups = defaultdict(list)
    for row_id, head, pos, text, source in rows:
        if head is None or text is None:
            continue
        key = alnum(head), tuple(sorted(g for g in map(alnum, text.split(";")) if g))
        if all(key):
            groups[source, pos, key].append(row_id)
    return groups


def test_against_brute_force(spark):
    rng = random.Random(4)
    heads = ["Set", "set ", "s-e-t", "SET!", "sett", "naïve", "NAÏVE", "", "--", None]
    texts = ["a b; c", "C;  A.B", "c;ab", "ab; c; c", "c; ab; c", "ab;;c", "", " ; ", "...", None, "x" * 50_000, "X" * 50_000 + "!"]
    rows = [(i, rng.choice(heads), rng.choice(["noun", None]), rng.choice(texts), rng.choice(["w", None])) for i in range(600)]
    df = spark.createDataFrame(rows, SHAPE)
    groups = brute(rows)
    assert {tuple(r) for r in members(df).collect()} == {(min(ids), i) for ids in groups.values() for i in ids if i != min(ids)}
    assert {(r.first_row_id, r.copies) for r in collapse(df).collect()} == {(min(ids), len(ids)) for ids in groups.values()}


def test_a_third_of_all_rows_in_one_group(spark):
    rows = [(i, "Set", "noun", "hot; row" if i % 3 == 0 else f"row {i}", "w") for i in range(3000)]
    found = members(spark.createDataFrame(rows, SHAPE)).collect()
    assert len(found) == 999
    assert {r.first_row_id for r in found} == {0}


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", "n", "b", "s", "x", 9), (2, "A", "n", "B", "s", "y", 9)], SHAPE + ", hw string, fa long")
    assert [tuple(r) for r in members(df).collect()] == [(1, 2)]
    assert members(df.limit(0)).count() == 0


def test_gloss_multiplicity_matters(spark):
    rows = [(1, "a", "n", "x; x; y", "s"), (2, "a", "n", "x; y; y", "s"), (3, "a", "n", "y; x; x", "s")]
    assert [tuple(r) for r in members(spark.createDataFrame(rows, SHAPE)).collect()] == [(1, 3)]
