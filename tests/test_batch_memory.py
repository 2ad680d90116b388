import tracemalloc

import numpy as np
import pyarrow as pa

from lexmill.operators.vectors import Best, batch_top_k, gathered


def test_best_is_exact_with_ties_however_scores_arrive():
    rng = np.random.default_rng(3)
    scores = rng.integers(-8, 9, (20, 300)) / 8
    ids = rng.permutation(300) * 7 - 900
    for step in (1, 37, 300):
        best = Best(20, 9)
        for start in range(0, 300, step):
            best.meet(np.arange(20), scores[:, start : start + step], ids[start : start + step])
        best.settle()
        want = [sorted(zip(-np.rint(s * 1e6), ids, strict=True))[:9] for s in scores]
        assert list(zip(best.score, best.id, strict=True)) == [x for w in want for x in w]


def test_memory_of_a_task_depends_on_neither_side():
    rng = np.random.default_rng(4)
    members = rng.standard_normal((8_192, 64))
    best = Best(2_048, 76)
    tracemalloc.start()
    for _ in range(3):
        for start in range(0, 2_048, 256):
            best.meet(np.arange(start, start + 256), members[start : start + 256] @ members.T, np.arange(8_192))
    best.settle()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    assert len(best.id) == 2_048 * 76


def test_no_block_of_vectors_is_shuffled(spark):
    v = np.random.default_rng(6).standard_normal((500, 8))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "key long, vec array<double>")
    got = batch_top_k(rows.filter("key % 7 = 0"), rows, 5, 8, block_rows=10)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "collect_list" not in plan
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 6)
    np.fill_diagonal(sims, -2)
    want = [(i, int(j), round(float(sims[i, j]), 6), n + 1) for i in range(0, 500, 7) for n, j in enumerate(np.lexsort((np.arange(500), -sims[i]))[:5])]
    assert sorted((r.query_id, r.key, round(r.score, 6), r["rank"]) for r in got.collect()) == sorted(want)


def test_rows_are_gathered_by_number():
    batches = [pa.RecordBatch.from_pydict({"x": list(range(n))}) for n in (3, 0, 8, 1)]
    assert [t.num_rows for t in gathered(iter(batches), 5)] == [5, 5, 2]
    assert [t.num_rows for t in gathered(iter([]), 5)] == []
