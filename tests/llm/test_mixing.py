import math
import random

import pytest

from lexmill.llm import mixing
from lexmill.llm.mixing import Source


def test_exponents():
    tokens = {"a": 1000, "b": 100, "c": 10, "d": 0}
    shares = mixing.tempered(tokens, 0.5)
    assert sum(shares.values()) == pytest.approx(1)
    assert shares["d"] == 0
    alpha = mixing.exponent_for_entropy(tokens, 0.9)
    assert mixing.entropy(mixing.tempered(tokens, alpha)) == pytest.approx(0.9, abs=1e-6)
    assert mixing.exponent_for_entropy(tokens, math.log(3)) == pytest.approx(0, abs=1e-6)
    alpha = mixing.exponent_for_repeats(tokens, {"a": 2, "b": 2, "c": 2, "d": 2})
    shares = mixing.tempered(tokens, alpha)
    assert max(shares[s] * 1110 / n for s, n in tokens.items() if n) == pytest.approx(2, abs=1e-3)
    assert mixing.exponent_for_repeats(tokens, dict.fromkeys(tokens, 1e9)) == 0.0


def of(sources):
    return {w.source: w.share for w in mixing.weights(sources)}


def test_own_exponents_and_limits():
    sources = [Source("big", 900, 0.5, 2), Source("small", 100, 0.5, 2)]
    big, small = mixing.weights(sources)
    assert (big.share, small.share) == pytest.approx((0.8, 0.2))
    assert 0.9**big.exponent == pytest.approx(0.5) and 0.1**small.exponent == pytest.approx(0.5)
    assert 0.1**small.limit_exponent == pytest.approx(0.2)
    assert (big.short, small.short) == (False, True)
    assert of([Source("none", 0, 1.0, 3)]) == {"none": 0.0}
    assert mixing.budgets([Source("a", 100, 1.0, 3)], of([Source("a", 100, 1.0, 3)])) == [("a", 1, 0, 1)]


def test_short_is_what_whole_tokens_say():
    rng = random.Random(4)
    for _ in range(300):
        sources = [Source(str(n), rng.choice([0, rng.randrange(1, 50), rng.randrange(1, 10**9)]), rng.choice([0.0, 0.125, 0.25, rng.random()]), rng.randrange(0, 5)) for n in range(rng.randrange(1, 6))]
        total = sum(s.tokens for s in sources)
        assert [w.short for w in mixing.weights(sources)] == [s.tokens * s.max_repeats < s.target * total for s in sources]
    exact = [Source("edge", 250, 0.5, 2), Source("rest", 750, 0.5, 1)]
    assert [w.short for w in mixing.weights(exact)] == [False, False]


def test_tempered_mix(spark):
    sizes, targets = frames(spark)
    totals = mixing.source_totals(sizes, targets)
    exponent, shares = mixing.tempered_shares(mixing.read_sources(totals))
    got = {r.source: r.reached_share for r in mixing.reached(mixing.mix(sizes, targets, tempering=True), totals).collect()}
    assert 0 <= exponent <= 1
    for source, share in shares.items():
        assert got[source] == pytest.approx(share, abs=2e-3)


def frames(spark):
    sizes = [(i, "big", 1 + i % 7) for i in range(3000)] + [(5000 + i, "small", 10) for i in range(30)] + [(9000, "big", 0)]
    targets = [("big", 0.5, 2), ("small", 0.3, 3), ("absent", 0.2, 5)]
    return spark.createDataFrame(sizes, "doc_id long, source string, n_tokens long"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_mix(spark):
    sizes, targets = frames(spark)
    totals = mixing.source_totals(sizes, targets)
    assert {r.source: r.docs for r in totals.collect()} == {"big": 3001, "small": 30, "absent": 0}
    assert {r.source for r in mixing.short_sources(sizes, targets).collect()} == {"small", "absent"}
    rows = mixing.mix(sizes, targets).collect()
    assert {r.doc_id for r in rows if r.source == "small"} == set(range(5000, 5030))
    assert {r.uses for r in rows if r.source == "small"} == {3}
    assert {r.uses for r in rows if r.source == "big"} <= {1, 2}
    assert len(rows) == len({r.doc_id for r in rows})
    all_tokens = sum(r.tokens for r in totals.collect())
    assert sum(r.uses * r.n_tokens for r in rows) == pytest.approx(all_tokens, abs=4)
    shares = {r.source: r.reached_share for r in mixing.reached(mixing.mix(sizes, targets), totals).collect()}
    assert shares["small"] == pytest.approx(900 / all_tokens, abs=1e-3)
    assert shares["absent"] == 0


def test_partial_pass_is_a_prefix_of_a_permutation(spark):
    sizes, _ = frames(spark)
    plan = lambda rest: spark.createDataFrame([("big", 0, rest, 16)], "source string, passes long, rest long, blocks long")
    few = {r.doc_id for r in mixing.realise(sizes, plan(2000)).collect()}
    more = mixing.realise(sizes, plan(4000)).collect()
    assert few < {r.doc_id for r in more}
    assert abs(sum(r.n_tokens for r in more) - 4000) <= 4
    assert mixing.realise(sizes, plan(0)).count() == 0


def test_counts_and_empty_tables(spark):
    _, targets = frames(spark)
    docs = spark.createDataFrame([(1, "hello world", "big", 5), (2, None, "big", 5), (3, "x", None, 5), (4, "x", "other", 5)], "doc_id long, text string, source string, n_tokens int")
    assert sorted(tuple(r) for r in mixing.counted(docs, targets).select("doc_id", "n_tokens").collect()) == [(1, 2), (2, 0)]
    nothing = mixing.counted(docs.limit(0), targets)
    assert mixing.mix(nothing, targets).count() == 0
    assert [r.reached_share for r in mixing.reached(mixing.mix(nothing, targets), mixing.source_totals(nothing, targets)).collect()] == [None] * 3
    assert mixing.source_totals(nothing, targets.limit(0)).count() == 0
