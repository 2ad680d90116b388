import pytest

import __spark_entry__


@pytest.mark.parametrize("name", ["search_many", "recall_at_k"])
def test_no_list_of_vectors_or_candidates_is_built(spark, name):
    plan = __spark_entry__.queries()[name](spark, __spark_entry__.SMOKE_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan
