"""Plan checks: no Python UDFs, pruned scans, windows above aggregates,
no job while a query is built; entry/queries/oracle contract."""

import pytest

import __spark_entry__ as E
from feira.plans.catalog import QUERIES


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark, sf_small):
    return {name: _plan(fn(spark, sf_small)) for name, fn in QUERIES.items()}


def test_no_python_udf_anywhere(plans):
    for name, plan in plans.items():
        for marker in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas"):
            assert marker not in plan, (name, marker)


def test_windows_only_above_aggregates(spark, sf_small):
    for name in ("daily_trend_7", "geo_orders", "geo_revenue"):
        df = E.queries()[name](spark, sf_small)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        lines = plan.split("\n")
        win = next(i for i, line in enumerate(lines) if "Window" in line)
        assert any("Aggregate" in line for line in lines[win + 1:]), name


def test_scan_is_pruned(spark, sf_small):
    df = E.queries()["top_categories_feed"](spark, sf_small)
    plan = _plan(df)
    # lineitem: only the columns the feed needs; part: key and brand only
    assert "l_quantity" not in plan and "l_shipdate" not in plan and "p_name" not in plan
    assert "TakeOrderedAndProject" in plan


def test_building_a_join_runs_no_job(spark, sf_small):
    spark.sparkContext.setJobGroup("build", "build only")
    E.queries()["category_revenue_all"](spark, sf_small)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("build")
    spark.sparkContext.setJobGroup("other", "")
    assert not list(jobs)


def test_contract(spark):
    assert set(QUERIES) <= set(E.oracle_sql()) <= set(E.queries())
    df = E.entry(spark)
    assert df.columns == ["product_category_name", "Total", "label", "hover_label"]
    assert df.count() == 15
