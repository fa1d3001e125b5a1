"""C6 geo feed, C7 daily trend, sf0.001 anchors."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from feira.functions.delay import normalize_delay
from feira.operators.geo import geo_feed
from feira.operators.trend import daily_orders, daily_trend
from feira.sources import fixtures

GEO = "order_id long, customer_state string, Net_State string, Delay string, TOTAL double"


def test_bubble_scaling_and_labels(spark):
    rows = [(1, "SP", "Delivered", "-1 days", 10.0), (2, "SP", "Delivered", "1 days", 5.5),
            (3, "RJ", "Delivered", "1 days", 1000.0), (4, "XX", "Delivered", "1 days", 1.0),
            (5, "MG", "Delivered", "1 days", 2.0), (5, "MG", "Delivered", "1 days", 2.0)]
    orders = normalize_delay(spark.createDataFrame(rows, GEO))
    g = {r.state: r for r in geo_feed(orders, "orders", bubble_size_multiplier=2.0).collect()}
    assert set(g) == {"SP", "RJ", "MG"}                 # XX has no coordinates
    assert g["SP"].value == 2 and g["MG"].value == 1   # distinct order ids
    assert g["SP"].bubble_size == 80.0 and g["MG"].bubble_size == 20.0
    assert g["SP"].state_name == "São Paulo" and g["SP"].label == "SP<br>2"
    rev = {r.state: r for r in geo_feed(orders, "revenue").collect()}
    assert rev["RJ"].value == 1000.0 and rev["RJ"].label == "RJ<br>1,000.0"
    assert rev["SP"].label == "SP<br>15.5"
    late = geo_feed(orders, "delayed").collect()
    assert [(r.state, r.value, r.bubble_size) for r in late] == [("SP", 1, 20.0)]


def test_geo_fallback_without_total(spark):
    rows = [(1, "SP", "Delivered", "1 days", 0.0), (2, "SP", "Delivered", "1 days", 0.0)]
    orders = normalize_delay(spark.createDataFrame(rows, GEO)).drop("TOTAL")
    assert geo_feed(orders, "revenue").first().value == 2


def test_geo_status_filter_and_empty(spark):
    rows = [(1, "SP", "Delivered", "-1 days", 1.0), (2, "RJ", "Not_Delivered", "-1 days", 1.0)]
    orders = normalize_delay(spark.createDataFrame(rows, GEO))
    assert [r.state for r in geo_feed(orders, status="Not_Delivered", delayed_only=True).collect()] == ["RJ"]
    assert geo_feed(orders, status="Nope").count() == 0


def test_rolling_mean_over_rows(spark):
    days = [dt.date(2020, 1, 1), dt.date(2020, 1, 2), dt.date(2020, 1, 5), dt.date(2020, 1, 9)]
    rows = []
    oid = 0
    for d, n in zip(days, [1, 2, 3, 10]):
        for _ in range(n):
            oid += 1
            rows.append((oid, dt.datetime.combine(d, dt.time(12))))
    rows.append((1, dt.datetime(2020, 1, 1, 13)))  # same order again: counted once
    df = spark.createDataFrame(rows + [(99, None)], "order_id long, order_purchase_timestamp timestamp")
    out = daily_trend(df, window=3).collect()
    assert [r.date for r in out] == days                      # gap days not filled
    assert [r.orders_roll for r in out] == [1.0, 1.5, 2.0, 5.0]
    assert daily_trend(df, metric="revenue").columns == ["date", "orders", "revenue_roll"]
    with pytest.raises(ValueError):
        daily_trend(df, window=0)


def test_golden_geo_and_trend_sf0001(spark, sf_small):
    orders = normalize_delay(fixtures.orders_with_delay(spark, sf_small))
    g = geo_feed(orders, "orders")
    agg = g.agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).first()
    assert (agg.n, agg.lo, agg.hi) == (24, 26, 126)
    rev = geo_feed(orders, "revenue").agg(F.sum("value")).first()[0]
    assert rev == pytest.approx(361162585.92, abs=0.005)
    trend = daily_trend(fixtures.seller_orders(spark, sf_small)).collect()
    assert len(trend) == 1094
    assert sum(r.orders_roll for r in trend) == pytest.approx(1499.0)
    assert trend[3].orders_roll == 1.0
    assert daily_orders(fixtures.seller_orders(spark, sf_small)).count() == 1094


def test_unique_orders_shortcut_agrees(spark, sf_small):
    so = fixtures.seller_orders(spark, sf_small)  # one row per order
    a = daily_trend(so).collect()
    b = daily_trend(so, orders_unique=True).collect()
    assert a == b
    orders = normalize_delay(fixtures.orders_with_delay(spark, sf_small))
    assert geo_feed(orders).collect() == geo_feed(orders, orders_unique=True).collect()
    plan = daily_orders(so, orders_unique=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
