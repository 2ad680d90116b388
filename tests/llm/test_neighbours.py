import numpy as np

from lexmill.llm.neighbours import K, balanced_partition, fit, graph, nearest, unit

SHAPE = "row_id long, embedding array<float>"


def clouds(n, dim=64, seed=0, spread=0.7):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    return (centres[rng.integers(12, size=n)] + spread * rng.standard_normal((n, dim))).astype(np.float32)


def brute(ids, vectors, k):
    u = unit(vectors)
    sims = np.round(u @ u.T, 6)
    out = {}
    for i, key in enumerate(ids):
        sims[i, i] = -9
        out[key] = [ids[j] for j in np.lexsort((ids, -sims[i]))[: min(k, len(ids) - 1)]]
    return out


def found(df, **options):
    got = {}
    for r in nearest(df, **options).collect():
        got.setdefault(r.id, set()).add(r.neighbour_id)
    return got


def test_one_partition_is_exact_with_ties_copies_and_bad_rows(spark):
    v = clouds(60)
    v[10:25] = v[3]
    v[30] = 2 * v[5]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    bad = [(100, None), (101, [0.0] * 64), (102, [1.0] * 63), (103, [1.0] * 63 + [None]), (104, [float("nan")] + [1.0] * 63), (105, [float("inf")] + [1.0] * 63)]
    df = spark.createDataFrame([(*r, "x") for r in rows + bad], SHAPE + ", vec string")
    want = brute(np.arange(60), v, K)
    assert found(df) == {k: set(ns) for k, ns in want.items()}
    assert found(df, block=7) == {k: set(ns) for k, ns in want.items()}


def test_few_vectors_and_none(spark):
    df = spark.createDataFrame([(1, [1.0] * 64), (2, [1.0] * 64), (3, [-1.0] * 64)], SHAPE)
    assert found(df) == {1: {2, 3}, 2: {1, 3}, 3: {1, 2}}
    assert found(df.limit(1)) == {}
    assert found(df.limit(0)) == {}


def test_a_third_of_equal_vectors(spark):
    v = clouds(900)
    v[::3] = v[0]
    got = found(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], SHAPE))
    assert got[0] == {3 * i for i in range(1, 11)}
    assert got[897] == {3 * i for i in range(10)}
    assert {len(x) for x in got.values()} == {10}


def test_recall_of_learned_partitions(spark):
    v = clouds(4000)
    got = found(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], SHAPE), fit_vectors=1500, partition_vectors=200, block=300)
    want = brute(np.arange(4000), v, K)
    assert np.mean([len(got[k] & set(ns)) / K for k, ns in want.items()]) >= 0.9


def test_partitions_are_balanced():
    points = unit(clouds(1000))
    near = graph(points, 10)
    labels = balanced_partition(points, near, 8, np.random.default_rng(0))
    assert np.bincount(labels, minlength=8).max() <= np.ceil(1.15 * 1000 / 8)
    assert (labels[near] == labels[:, None]).mean() > 0.5
    assert fit(clouds(1000), 8).probes <= 8
