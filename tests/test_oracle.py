"""Every registered query against DuckDB, with several tasks per shuffle, and its plans."""

import os
import re
import sys

import pytest

from blobtide.scratch import drop_scratch, materialize
from verification import catalog
from verification.compare import connect, differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
FORBIDDEN = re.compile(r"EvalPython|InPandas|InArrow|CartesianProduct|BroadcastNestedLoopJoin")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def check_plan(plan):
    assert not FORBIDDEN.search(plan)
    lines = plan.splitlines()
    for line, below in zip(lines, lines[1:], strict=False):
        if "Exchange SinglePartition" in line:
            # only totals (one row per piece, or a single row) may meet in one task
            assert re.search(r"Aggregate\(keys?=\[(_piece#\d+L?)?\]", below), below


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("key", catalog.CHECKS)
def test_query_equals_sql(spark, many_partitions, monkeypatch, duck, key):
    def checked(df, label="table"):
        check_plan(plan_of(df))
        return materialize(df, label)

    for name, module in list(sys.modules.items()):
        if name.split(".")[0] in ("blobtide", "verification") and name != "blobtide.scratch":
            monkeypatch.setattr(module, "materialize", checked, raising=False)
    # keep the partition setting of this test
    monkeypatch.setattr(catalog, "configure", lambda session: session)
    check = catalog.CHECKS[key]
    df = check.run(spark, SF_DIR)
    check_plan(plan_of(df))
    found = differences(df, duck, check.statement())
    drop_scratch(spark)
    if found == ["both results are empty"] and SF_DIR.endswith("sf0.001"):
        pytest.skip("no rows at this scale factor")
    assert not found
