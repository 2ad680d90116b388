import numpy as np

from lexmill.llm.neighbours import K, distinct_vectors, fit, placed, search, usable
from lexmill.session import written_files, written_table
from tests.llm.test_neighbours import SHAPE, clouds


def test_vectors_travel_to_no_partition_and_copies_are_found(spark):
    v = clouds(600)
    v[100:140] = v[7]  # more copies than are listed
    rows = usable(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], SHAPE), "row_id", "embedding", 64)
    router = fit(v, 6, target=1.0)
    members = written_table(placed(distinct_vectors(rows, K).select("rid", "ids", "ka", "kb", "vec"), router).repartition(3).sortWithinPartitions("part"), "members")
    found = search(members, written_files(members), router, K, block=50, members=64)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    got = {r.ids[0]: r for r in found.collect()}
    assert len(got) == 560 and got[7].ids == [7, *range(100, 110)]
    assert got[7].found == got[7].ids
    for r in got.values():
        assert len(r.found) == K + 1 == len(set(r.found)) and r.ids[0] in r.found
    if router.probes == 6:
        unit = v / np.linalg.norm(v, axis=1, keepdims=True)
        sims = np.round(unit.astype(np.float64) @ unit.T.astype(np.float64), 5)
        assert all(min(sims[i, j] for j in r.found) >= np.sort(sims[i])[-K - 1] - 1e-4 for i, r in got.items())
