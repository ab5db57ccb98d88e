"""Every registered query against its SQL on the smallest data, and the shape of its plan."""

import pytest

from tabulon.checks import load
from verify import compare

QUERIES, ORACLES = load()
FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, name):
    seen = []

    def run(session, folder):
        seen.append(QUERIES[name](session, folder))
        return seen[0]

    note, ok = compare(spark, FOLDER, run, ORACLES.get(name))
    assert ok, note
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
