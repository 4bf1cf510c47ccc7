"""Every registered query beside its SQL on the smallest tables, and the shape of its plan."""

from __future__ import annotations

import os
import re

import duckdb
import pytest

import __spark_entry__ as contract
from tests.compare import TABLES, difference
from tidemill.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES
# queries whose building itself runs training or streaming jobs
EAGER = {
    "stream_ingest", "stream_daily", "lookback_forecast", "lag_regression_pooled", "lag_regression_forecast", "outlier_isolation",
    "cv_models", "cv_cutoff_scores", "holdout_scores", "ensemble_forecast", "compare_models",
}


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


def test_contract(spark):
    assert set(ORACLES) <= set(QUERIES) <= set(contract.queries())
    assert set(ORACLES) <= set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        assert difference(got, con.execute(ORACLES[name]).df()) is None
    else:
        assert len(got) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_plan(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan  # no row-at-a-time Python
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan):
        assert len(schema.split(",")) < 8  # columns are pruned to those used
