"""Duplicates hidden by formatting: commutative multiset fingerprints over normalised fields.

Each normalised field-name and value pair is hashed; a list field (the glosses of a definition) hashes each element, and
the hashes are added, so that neither the order of fields nor that of elements matters and nothing is sorted. Rows meet
by fingerprint; the fields of every row are then compared with those of the group's first row, element by element.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.session import written_table

#: everything but letters and digits of any script
NOT_ALNUM = r"[^\p{L}\p{N}]+"
GLOSS_SEPARATOR = ";"
ALNUM = r"[\p{L}\p{N}]"
#: seeds of the two independent halves of a fingerprint
SEEDS = ("a", "b")
FP = ["fa", "fb"]
#: sums of hashes are taken modulo 2**62, so that two addends can't overflow
MASK = 2**62 - 1


def alnum(value: Column) -> Column:
    """Letters and digits only, without case."""
    return F.regexp_replace(F.lower(value), NOT_ALNUM, "")


def glosses(definition: Column) -> Column:
    """The normalised glosses that have a letter or digit, as a bag; null for a null definition. Glosses are split
    after normalisation, which keeps the separator, so that a text is scanned once."""
    kept = F.regexp_replace(F.lower(definition), r"[^\p{L}\p{N};]+", "")
    return F.filter(F.split(kept, GLOSS_SEPARATOR), lambda g: g != "")


def _masked(value: Column) -> Column:
    return value.bitwiseAND(F.lit(MASK))


def fingerprint(scalars: dict[str, Column], bags: dict[str, Column], seed: str) -> Column:
    """A 62-bit half of the fingerprint: the sum, modulo 2**62, of the hashes of all name-value pairs. Null equals null
    and differs from every value."""
    parts = [F.xxhash64(F.lit(f"{seed}:{name}"), value.isNull(), value) for name, value in scalars.items()]
    for name, bag in bags.items():
        label = F.lit(f"{seed}:{name}")
        total = F.aggregate(bag, F.lit(0).cast("long"), lambda a, e: _masked(a + _masked(F.xxhash64(label, e))))
        parts.append(F.xxhash64(label, F.size(bag), total))
    return reduce(lambda a, h: _masked(a + h), map(_masked, parts))


def same_bag(a: Column, b: Column) -> Column:
    """Equal as multisets, without sorting: every element occurs equally often in both."""
    times = lambda bag, e: F.size(F.filter(bag, lambda x: x == e))
    return (a == b) | ((F.size(a) == F.size(b)) & F.forall(a, lambda e: times(a, e) == times(b, e)))


def normalised(records: DataFrame, row_id: str = "row_id") -> DataFrame:
    """row_id, the comparison fields, and the two halves of the fingerprint. Rows without a letter or digit in headword
    or definition take no part (so null and empty ones don't either)."""
    base = records.filter(F.col("headword").rlike(ALNUM) & F.col("definition").rlike(ALNUM) & F.col(row_id).isNotNull())
    base = base.select(F.col(row_id).alias("row_id"), "source", "pos", alnum(F.col("headword")).alias("hw"), glosses(F.col("definition")).alias("bag"))
    scalars = {"source": F.col("source"), "pos": F.col("pos"), "headword": F.col("hw")}
    return base.select("*", *[fingerprint(scalars, {"definition": F.col("bag")}, s).alias(f"f{s}") for s in SEEDS])


def collapse(records: DataFrame, row_id: str = "row_id") -> DataFrame:
    """One row for each record that remains: its first row_id and the number of its copies. Rows that take no part are
    left out. Ids and fingerprints only, combined before the one shuffle, so a group of any size reaches its task as a
    row for each input partition."""
    return normalised(records, row_id).groupBy(*FP).agg(F.min("row_id").alias("first_row_id"), F.count("*").alias("copies"))


def members(records: DataFrame, row_id: str = "row_id") -> DataFrame:
    """(first_row_id, row_id) of every copy but the first of its group.

    Copies: equal source and pos (null equals null), equal headword and bag of glosses when only letters and digits
    count. A repeated row_id is one row. Rows join the groups by fingerprint, the groups' side having one row for each
    fingerprint, so a hot group is split by adaptive skew handling without loss. The rows that have copies are written
    once; among them are the first rows, which bring the fields to compare with. Should two different records share all 124 bits, the query fails
    and names the remedy rather than merge or lose them.
    """
    groups = collapse(records, row_id).filter("copies > 1")
    rows = written_table(normalised(records, row_id).join(groups, FP), "copies")  # only rows that have copies
    names = ["source", "pos", "hw", "bag"]
    firsts = rows.filter("row_id = first_row_id").select(*FP, *[F.col(n).alias(f"first_{n}") for n in names])
    joined = rows.filter("row_id != first_row_id").join(firsts, FP)
    equal = (
        F.col("source").eqNullSafe(F.col("first_source"))
        & F.col("pos").eqNullSafe(F.col("first_pos"))
        & (F.col("hw") == F.col("first_hw"))
        & same_bag(F.col("bag"), F.col("first_bag"))
    )
    first = F.when(equal, F.col("first_row_id")).otherwise(F.raise_error(F.lit("fingerprints collide: change SEEDS")).cast("long"))
    return joined.select(first.alias("first_row_id"), "row_id")


def verified(records: DataFrame, row_id: str = "row_id") -> DataFrame:
    """(first_row_id, copies) of each record that remains, as collapse counts them; the fields of all copies are compared
    as members does it, and a collision fails the query."""
    checked = members(records, row_id).groupBy("first_row_id").agg(F.count("*").alias("checked"))
    joined = collapse(records, row_id).select("first_row_id", "copies").join(checked, "first_row_id", "left")
    return joined.select("first_row_id", F.when(F.col("checked").isNull() | (F.col("checked") > 0), F.col("copies")).alias("copies"))  # reads checked, so that it is computed
