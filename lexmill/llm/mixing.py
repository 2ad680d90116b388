"""Sources mixed by temperature, in tokens of a public tokenizer.

A source's weight is its token share to the power of an exponent. One exponent for all, bisected to a target entropy and
to the repetition limits, gives tempered shares. Where target shares are given, each source has an exponent of its own,
bisected to its target, and another that is bisected to its repetition limit; a source whose target asks for a smaller
exponent than its limit allows falls short of it. The weights are normalised under the limits, and become whole passes
over a source plus a part of one, which is a prefix of a permutation by blocks: blocks in permuted order, whole until
the budget runs out, and the one block on the edge in permuted order of its documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.tokens import DEFAULT_VOCABULARY, with_token_counts

#: documents that a block of a source's permutation has on average; only the block on the edge of the budget is ordered by
#: document
BLOCK_DOCUMENTS = 4_096
SEED = 17
#: exponents in question: token shares of 1e-12 and more reach any weight from 1e-12 to 1e12 by one of these
LEAST_EXPONENT, MOST_EXPONENT = -1e9, 1e9


@dataclass(frozen=True)
class Source:
    name: str
    tokens: int
    target: float
    max_repeats: int
    docs: int = 0


@dataclass(frozen=True)
class Weight:
    """exponent: what makes the source's token share its target; limit_exponent: what makes it as much as its repetitions
    give; None where the source has no tokens or the weight is 0, which no exponent gives. short: the limit stays below
    the target."""

    source: str
    exponent: float | None
    limit_exponent: float | None
    share: float
    short: bool


def bisect_root(f: Callable[[float], float], low: float, high: float, steps: int = 200) -> float:
    """Where the rising f crosses zero; an end of the interval if it doesn't."""
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def tempered(tokens: dict[str, int], exponent: float) -> dict[str, float]:
    """Token shares to the power of the exponent, normalised; sources without tokens get nothing."""
    logs = {s: exponent * math.log(n) for s, n in tokens.items() if n > 0}
    top = max(logs.values(), default=0.0)
    weights = {s: math.exp(x - top) for s, x in logs.items()}
    total = sum(weights.values())
    return {s: weights.get(s, 0.0) / total if total else 0.0 for s in tokens}


def entropy(shares: dict[str, float]) -> float:
    return -sum(p * math.log(p) for p in shares.values() if p > 0)


def exponent_for_entropy(tokens: dict[str, int], target: float) -> float:
    """The exponent in [0, 1] whose tempered shares have the entropy; it falls as the exponent rises."""
    return bisect_root(lambda a: target - entropy(tempered(tokens, a)), 0.0, 1.0)


def exponent_for_repeats(tokens: dict[str, int], limits: dict[str, float]) -> float:
    """The smallest exponent in [0, 1] at which a mix as large as all tokens repeats no source beyond its limit."""
    total = sum(tokens.values())
    slack = lambda a: min((limits[s] * n - p * total) for s, p in tempered(tokens, a).items() if (n := tokens[s]))
    return bisect_root(slack, 0.0, 1.0) if slack(0.0) < 0 else 0.0


def own_exponent(share: float, weight: float) -> float | None:
    """The exponent, by bisection, that makes the weight of a token share below 1."""
    if not 0 < share < 1 or weight <= 0:
        return None
    return bisect_root(lambda a: math.log(weight) - a * math.log(share), LEAST_EXPONENT, MOST_EXPONENT)


def weights(sources: list[Source]) -> list[Weight]:
    """Each source's exponents and its share of the mix: the smaller of its limit and its weight, the weights of those
    below their limits being raised in common until all shares sum to one, or every limit where they can't.

    Whether a source is short is read off its exponents and, where rounding could decide, checked in whole tokens.
    """
    total = sum(s.tokens for s in sources)
    if not total:
        return [Weight(s.name, None, None, 0.0, False) for s in sources]
    share = {s.name: s.tokens / total for s in sources}
    wanted = {s.name: own_exponent(share[s.name], s.target) for s in sources}
    limit = {s.name: own_exponent(share[s.name], share[s.name] * s.max_repeats) for s in sources}
    caps = {s.name: share[s.name] * s.max_repeats for s in sources}
    raw = {s.name: share[s.name] ** wanted[s.name] if wanted[s.name] is not None else max(s.target, 0.0) for s in sources}
    at = lambda x: {n: min(caps[n], math.exp(x) * raw[n]) for n in raw}
    shares = at(bisect_root(lambda x: sum(at(x).values()) - 1, -50.0, 50.0))

    def short(s: Source) -> bool:
        a, b = wanted[s.name], limit[s.name]
        if a is not None and b is not None and abs(a - b) > 1e-6:
            return a < b
        return s.tokens * s.max_repeats < s.target * total

    return [Weight(s.name, wanted[s.name], limit[s.name], shares[s.name], short(s)) for s in sources]


def tempered_shares(sources: list[Source]) -> tuple[float, dict[str, float]]:
    """The exponent and shares of tempered mixing: as even as the targets' entropy asks for, as far as the repetition
    limits allow."""
    of = {s.name: s.tokens for s in sources}
    exponent = max(exponent_for_entropy(of, entropy({s.name: s.target for s in sources})), exponent_for_repeats(of, {s.name: float(s.max_repeats) for s in sources}))
    return exponent, tempered(of, exponent)


def counted(docs: DataFrame, targets: DataFrame, text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents whose source has a target. Null sources and ones without a target
    drop out before the texts are read into Python."""
    wanted = targets.filter("source IS NOT NULL").select("source").distinct()
    return with_token_counts(docs.select("doc_id", "source", text).join(wanted, "source", "left_semi"), text, vocabulary=vocabulary)


def source_totals(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """A row for each source with a target: its documents and tokens (0 for a source without documents). Combined before
    the shuffle."""
    per = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
    rows = targets.filter("source IS NOT NULL").join(per, "source", "left").na.fill(0, ["docs", "tokens"])
    return rows.select("source", "target_share", "max_repeats", "docs", "tokens")


def read_sources(totals: DataFrame) -> list[Source]:
    """To the driver: a row for each source that has a target, never one for a document."""
    return [Source(r["source"], r["tokens"], r["target_share"] or 0.0, r["max_repeats"] or 0, r["docs"]) for r in totals.orderBy("source").collect()]


def budgets(sources: list[Source], shares: dict[str, float]) -> list[tuple[str, int, int, int]]:
    """(source, whole passes, tokens of the partial pass, blocks of the permutation)."""
    total = sum(s.tokens for s in sources)
    out = []
    for s in sources:
        tokens = min(round(shares[s.name] * total), s.tokens * s.max_repeats)
        passes = tokens // s.tokens if s.tokens else 0
        out.append((s.name, passes, tokens - passes * s.tokens, max(1, s.docs // BLOCK_DOCUMENTS)))
    return out


def short_sources(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source): those whose repetitions don't give their target."""
    found = weights(read_sources(source_totals(sizes, targets)))
    return sizes.sparkSession.createDataFrame([(w.source,) for w in found if w.short], "source string")


def realise(sizes: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, n_tokens, uses) of every document used at least once.

    plan: (source, passes, rest, blocks). The partial pass takes documents in permuted order while at least half of the next
    one fits, so a source misses its budget by at most half a document. A source of any size is ordered by block sums;
    only its one block on the edge is ordered by document. Documents without tokens aren't used; ties in the
    permutation go by id, and rows with a repeated id are taken one by one.
    """
    spread = sizes.filter("n_tokens > 0").join(plan, "source")
    spread = spread.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("blocks")))
    sums = spread.filter("rest > 0").groupBy("source", "block", "rest").agg(F.sum("n_tokens").alias("block_tokens"))
    before = F.sum("block_tokens").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("before", F.coalesce(before, F.lit(0))).select("source", "block", "before", "block_tokens")
    placed = spread.join(sums, ["source", "block"], "left")
    whole = F.col("before") + F.col("block_tokens") <= F.col("rest")
    edge = (F.col("before") < F.col("rest")) & ~whole
    placed = placed.withColumn("edge", F.coalesce(edge, F.lit(False))).withColumn("whole", F.coalesce(whole, F.lit(False)))
    sure = placed.filter("NOT edge").select("doc_id", "source", "n_tokens", (F.col("passes") + F.col("whole").cast("long")).alias("uses"))
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("before") + F.sum("n_tokens").over(order)
    fits = (upto * 2 - F.col("n_tokens")) <= F.col("rest") * 2
    unsure = placed.filter("edge").select("doc_id", "source", "n_tokens", (F.col("passes") + fits.cast("long")).alias("uses"))
    return sure.unionByName(unsure).filter("uses > 0")


def mix(sizes: DataFrame, targets: DataFrame, tempering: bool = False, seed: int = SEED) -> DataFrame:
    """The documents of the mix with the number of times each is used, never above its source's max_repeats. The mix is
    as large as all documents; its shares are the targets or, with tempering, the tempered token shares."""
    sources = read_sources(source_totals(sizes, targets))
    shares = tempered_shares(sources)[1] if tempering else {w.source: w.share for w in weights(sources)}
    plan = sizes.sparkSession.createDataFrame(budgets(sources, shares), "source string, passes long, rest long, blocks long")
    return realise(sizes, plan, seed=seed)


def reached(mixed: DataFrame, totals: DataFrame) -> DataFrame:
    """The shares that a mix reached, for each source with a target."""
    per = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("mix_tokens"), F.max("uses").alias("most_uses"))
    rows = totals.join(per, "source", "left").na.fill(0, ["mix_tokens", "most_uses"])
    everything = F.sum("mix_tokens").over(Window.partitionBy(F.lit(1)))  # a row for each source
    share = F.round(F.col("mix_tokens") / F.nullif(everything, F.lit(0)), 6)
    return rows.select("source", "target_share", "max_repeats", "tokens", "mix_tokens", "most_uses", share.alias("reached_share"))
