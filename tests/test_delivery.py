"""B1–B4 heat map, C5/A8–A10/A18 delivery KPIs, F3–F7 and sf0.001 anchors."""

import pytest
from pyspark.sql import functions as F

from feira.functions.bins import PCT_EDGES, edges_from_ranges, pct_labels, range_labels, right_closed_bin
from feira.functions.delay import normalize_delay
from feira.operators import delivery as D
from feira.operators import feeds as FD
from feira.operators.heatmap import heatmap_cell_text, heatmap_grid, heatmap_long
from feira.plans.orders_analyzer import OrdersAnalyzer, analyze_orders_data
from feira.sources import fixtures


def _bins(spark, values, edges):
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)],
                               "i int, v double")
    return [r.b for r in df.orderBy("i").select(right_closed_bin(F.col("v"), edges).alias("b")).collect()]


def test_delay_bins_right_closed_first_inclusive(spark):
    edges = edges_from_ranges([(-30, -20), (-20, -10), (-10, -5), (-5, -2), (-2, 0)])
    assert _bins(spark, [-31, -30, -20, -10, -5, -2, 0, 0.5, None, float("nan")], edges) == [
        None, 0, 0, 1, 2, 3, 4, None, None, None]


def test_pct_bins(spark):
    assert _bins(spark, [0, 10, 10.0001, 100, 101, -1], PCT_EDGES) == [0, 0, 1, 9, None, None]
    assert pct_labels()[0] == "0–10 %" and pct_labels()[-1] == "90–100 %"


def test_custom_ranges_validation():
    assert edges_from_ranges([(-10, -5), (-4, 0)]) == [-10, -5, 0]  # later starts only shape labels
    assert range_labels([(-10, -5), (-4, 0)]) == ["-10–-5", "-4–0"]
    with pytest.raises(ValueError):
        edges_from_ranges([(-5, -10), (-10, 0)])
    with pytest.raises(ValueError):
        range_labels([(-2, 0), (-2, 0)])


def _delayed(spark, rows):
    df = spark.createDataFrame(rows, "order_id long, Net_State string, delay_days double, Site_Real_PCT double")
    return df


def test_heatmap_dense_grid_and_null_row(spark):
    late = _delayed(spark, [(1, "Delivered", -1.0, 5.0), (2, "Delivered", -1.5, 95.0),
                            (3, "Delivered", -25.0, 50.0), (4, "Delivered", -40.0, 150.0)])
    grid = heatmap_grid(late).collect()
    assert [r.delay_bin for r in grid] == ["-2–0", "-5–-2", "-10–-5", "-20–-10", "-30–-20", None]
    first = grid[0].asDict()
    assert first["0–10 %"] == 1 and first["90–100 %"] == 1 and sum(v for k, v in first.items() if k != "delay_bin") == 2
    assert all(v == 0 for k, v in grid[-1].asDict().items() if k != "delay_bin")  # null row of zeros
    assert len(grid[0]) == 11  # no null percentage column
    long = heatmap_long(late)
    assert long.count() == 60 and long.agg(F.sum("orders")).first()[0] == 3
    text = heatmap_cell_text(heatmap_grid(late)).first()
    assert text["0–10 %"] == "1" and text["10–20 %"] == ""


def test_heatmap_without_null_row_and_empty_input(spark):
    late = _delayed(spark, [(1, "Delivered", -3.0, None)])
    grid = heatmap_grid(late).collect()
    assert len(grid) == 5 and all(v == 0 for r in grid for k, v in r.asDict().items() if k != "delay_bin")
    assert heatmap_grid(_delayed(spark, [])).count() == 5


def test_heatmap_requires_delay_information(spark):
    df = spark.createDataFrame([(1, 5.0)], "order_id long, Site_Real_PCT double")
    with pytest.raises(ValueError, match="none of the columns"):
        heatmap_grid(df)


ORDERS = "order_id long, Net_State string, Delay string, Site_Real_PCT double, customer_state string"


def _orders(spark, rows):
    return spark.createDataFrame(rows, ORDERS)


def test_delivery_buckets_and_rates(spark):
    rows = [(1, "Delivered", "-1 days +00:00:00", 1.0, "SP"), (2, "Delivered", "1 days", 1.0, "SP"),
            (3, "Delivered", "0 days", 1.0, "SP"), (4, "Not_Delivered", "-02:00:00", 1.0, "SP"),
            (5, "Not_Delivered", "02:00:00", 1.0, "SP"), (6, None, "-1 days", 1.0, "SP"),
            (7, "Delivered", None, 1.0, "SP"), (8, "Other", "1 days", 1.0, "SP")]
    an = OrdersAnalyzer(_orders(spark, rows))
    perf = an.get_delivery_performance()
    k = perf["kpis"].first()
    assert (k.total_orders, k.delivered_orders, k.not_delivered_orders) == (7, 3, 2)
    assert (k.delay_delivered, k.delay_not_delivered, k.no_delay_delivered, k.no_delay_not_delivered) == (1, 1, 1, 1)
    assert k.delivery_rate == 3 / 7 * 100 and k.on_time_rate == 1 / 3 * 100
    assert sorted(r.order_id for r in perf["buckets"].collect()) == [1, 2, 4, 5]
    assert [r.order_id for r in perf["no_delay_delivered"].collect()] == [2]
    chart = {r.category: (r.orders, r.pct) for r in D.delivery_chart(perf["kpis"], "delivered").collect()}
    assert chart == {"No Delay": (1, 50.0), "With Delay": (1, 50.0)}
    disp = FD.delivery_metrics_display(perf["kpis"]).first()
    assert disp.delivered_orders == "3 (42.9%)" and disp.on_time_rate == "33.3%"


def test_delayed_orders_by_stage(spark):
    rows = [(1, "Delivered", "-1 days +00:00:00", 1.0, "SP"), (2, "Not_Delivered", "-02:00:00", 1.0, "SP"),
            (3, None, "-1 days", 1.0, "SP"), (4, "Delivered", "1 days", 1.0, "SP")]
    an = OrdersAnalyzer(_orders(spark, rows))
    assert [r.order_id for r in an.get_delayed_orders_by_stage().collect()] == [1]
    assert sorted(r.order_id for r in an.get_delayed_orders_by_stage("All").collect()) == [1, 2, 3]
    d = an.get_delayed_orders_by_stage("Not_Delivered", pct_col="ignored").first()
    assert d.delay_days == -2 / 24
    empty = an.get_delayed_orders_by_stage("Nope")
    assert empty.count() == 0 and "delay_days" in empty.columns


def test_existing_delay_days_is_kept(spark):
    df = spark.createDataFrame([(1, "Delivered", "-1 days", 42.0)],
                               "order_id long, Net_State string, Delay string, delay_days double")
    out = D.delayed_orders(normalize_delay(df), "All").first()
    assert out.delay_days == 42.0


def test_zero_denominators(spark):
    an = OrdersAnalyzer(_orders(spark, [(1, "Other", "1 days", 1.0, "SP")]))
    k = an.get_delivery_performance()["kpis"].first()
    assert (k.delivery_rate, k.on_time_rate) == (0.0, 0.0)
    chart = D.delivery_chart(an.get_delivery_performance()["kpis"], "not_delivered").collect()
    assert [r.pct for r in chart] == [0.0, 0.0]


def test_golden_delivery_sf0001(spark, sf_small):
    res = analyze_orders_data(fixtures.orders_with_delay(spark, sf_small, "text"))
    k = res["performance"]["kpis"].first()
    assert (k.total_orders, k.delivered_orders, k.not_delivered_orders) == (1484, 928, 512)
    assert (k.delay_delivered, k.delay_not_delivered, k.no_delay_delivered, k.no_delay_not_delivered) == (
        476, 258, 441, 247)
    assert isinstance(res["orders_data"].schema["Delay"].dataType.simpleString(), str)


def test_golden_heatmap_sf001(spark):
    orders = normalize_delay(fixtures.orders_with_delay(spark, "/root/testdata/sf0.01"))
    grid = heatmap_grid(D.delayed_orders(orders, "All")).collect()
    got = [[r[c] for c in pct_labels()] for r in grid]
    assert got == [
        [31, 49, 49, 30, 32, 31, 36, 57, 37, 31],
        [66, 44, 51, 59, 62, 63, 58, 41, 58, 62],
        [97, 100, 102, 96, 92, 96, 95, 111, 97, 91],
        [191, 210, 196, 192, 187, 185, 203, 202, 193, 192],
        [218, 195, 188, 190, 199, 203, 209, 191, 188, 193],
        [100, 96, 96, 93, 88, 103, 94, 92, 93, 90]]
    assert grid[-1].delay_bin is None


def test_interval_and_text_inputs_agree(spark, sf_small):
    a = D.delivery_performance(normalize_delay(fixtures.orders_with_delay(spark, sf_small, "interval"))).first()
    b = D.delivery_performance(normalize_delay(fixtures.orders_with_delay(spark, sf_small, "text"))).first()
    assert a == b


def test_bundle_has_every_figure_by_key_and_reads_days(spark):
    from feira.plans.orders_analyzer import KPI_KEYS, analyze_orders_data

    orders = spark.createDataFrame(
        [(1, "Delivered", -2.0, "SP", 1.0), (2, "Delivered", 1.5, "RJ", 2.0), (3, "Not_Delivered", -1.0, "SP", 3.0)],
        "order_id long, Net_State string, Delay double, customer_state string, TOTAL double")
    perf = analyze_orders_data(orders, unit="D")["performance"]
    assert [perf[key].first()[0] for key in KPI_KEYS] == [3, 2, 1, 2 / 3 * 100, 50.0]
    assert perf["delay_delivered"].count() == 1
