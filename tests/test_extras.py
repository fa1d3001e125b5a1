"""D1–D9 checked against brute force (pandas / numpy) on small inputs."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from feira.functions.delay import normalize_delay
from feira.operators import extras as X
from feira.operators import revenue as R
from feira.operators.ranking import with_global_position

ITEMS = "order_id string, product_id string, seller_id string, price double, freight_value double"
PRODUCTS = ("product_id string, product_category_name string, product_weight_g double, "
            "product_length_cm double, product_height_cm double, product_width_cm double")


def test_global_position_matches_sorting_with_ties(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([0, 0, 0, 1, 2, 3, 5, 8])) for i in range(3000)]  # heavy tie on 0
    df = spark.createDataFrame(rows, "k long, v long").repartition(7)
    got = with_global_position(df, [F.desc("v"), F.asc("k")], "v").toPandas().sort_values("position")
    want = pd.DataFrame(rows, columns=["k", "v"]).sort_values(["v", "k"], ascending=[False, True])
    assert list(got["k"]) == list(want["k"])
    assert list(got["position"]) == list(range(1, 3001))
    assert list(got["running_value"]) == list(want["v"].cumsum())
    assert set(got["n_rows"]) == {3000} and set(got["total_value"]) == {want["v"].sum()}


def _detailed(spark, seller_prices):
    rows = [(f"o{i}", "p", s, float(x), 0.0) for i, (s, x) in enumerate(seller_prices)]
    items = spark.createDataFrame(rows, ITEMS)
    prods = spark.createDataFrame([("p", "c", 1.0, 1.0, 1.0, 1.0)], PRODUCTS)
    return R.prepare_data(items, prods)


def test_segments_are_equal_count_and_ordered(spark):
    det = _detailed(spark, [(f"s{i:02d}", i) for i in range(25)])
    seg = X.vendor_segments(det, 5).toPandas().sort_values("position")
    assert list(seg["segment"]) == [1] * 5 + [2] * 5 + [3] * 5 + [4] * 5 + [5] * 5
    assert seg.iloc[0]["seller_id"] == "s24"


def test_gini_and_top_share(spark):
    equal = X.vendor_concentration_summary(_detailed(spark, [(f"s{i}", 10) for i in range(10)])).first()
    assert abs(equal.gini) < 1e-12 and equal.top_share == pytest.approx(0.1)
    one = X.vendor_concentration_summary(
        _detailed(spark, [("s0", 100)] + [(f"s{i}", 0) for i in range(1, 10)])).first()
    assert one.gini == pytest.approx(0.9) and one.top_share == 1.0
    x = np.array([3.0, 1.0, 7.0, 7.0, 2.0])
    mad = np.abs(x[:, None] - x[None, :]).sum() / (2 * len(x) ** 2 * x.mean())  # brute-force Gini
    got = X.vendor_concentration_summary(_detailed(spark, [(f"s{i}", v) for i, v in enumerate(x)])).first()
    assert got.gini == pytest.approx(mad)
    curve = X.vendor_concentration(_detailed(spark, [(f"s{i}", v) for i, v in enumerate(x)])).toPandas()
    assert curve.sort_values("position")["cum_revenue_share"].iloc[-1] == pytest.approx(1.0)


def test_category_share_rank(spark):
    items = spark.createDataFrame([("o", "a", "s", 30.0, 0.0), ("o", "b", "s", 10.0, 0.0),
                                   ("o", "z", "s", 60.0, 0.0)], ITEMS)
    prods = spark.createDataFrame([("a", "A", 1.0, 1.0, 1.0, 1.0), ("b", "B", 1.0, 1.0, 1.0, 1.0)], PRODUCTS)
    out = {r.product_category_name: (r.share, r.rank) for r in
           X.category_share_rank(R.prepare_data(items, prods)).collect()}
    assert out == {"Others": (0.6, 1), "A": (0.3, 2), "B": (0.1, 3)}


def test_correlation_and_freight_efficiency(spark):
    rng = np.random.default_rng(3)
    price = np.round(rng.uniform(1, 100, 200), 2)            # money: cents
    freight = np.round(price * 0.1 + rng.normal(0, 1, 200), 2)
    rows = [(f"o{i}", "p", "s", float(a), float(b)) for i, (a, b) in enumerate(zip(price, freight))]
    det = R.prepare_data(spark.createDataFrame(rows, ITEMS),
                         spark.createDataFrame([("p", "c", 500.0, 10.0, 10.0, 10.0)], PRODUCTS))
    vol = R.volume_analysis_data(det)
    r = X.price_freight_correlation(vol).first()
    assert r.n == 200 and r.pearson_r == pytest.approx(np.corrcoef(price, freight)[0, 1], abs=1e-9)
    eff = X.freight_efficiency(vol).first()
    assert eff.freight_per_kg == pytest.approx(freight.sum() / (200 * 0.5), rel=1e-9)
    assert eff.freight_per_litre == pytest.approx(freight.sum() / (200 * 1.0), rel=1e-9)


def test_duration_quantiles_nearest_rank(spark):
    rng = np.random.default_rng(5)
    days = rng.integers(0, 40, 501)
    base = dt.datetime(2020, 1, 1)
    items = spark.createDataFrame([(f"o{i}", base + dt.timedelta(days=int(d))) for i, d in enumerate(days)],
                                  "order_id string, shipping_limit_date timestamp")
    orders = spark.createDataFrame([(f"o{i}", base) for i in range(len(days))],
                                   "order_id string, order_purchase_timestamp timestamp")
    s = X.duration_summary(X.stage_durations(items, orders)).first()
    srt = np.sort(days)
    for q, col in ((0.5, "p50_days"), (0.9, "p90_days"), (0.99, "p99_days")):
        assert s[col] == srt[int(np.ceil(q * len(srt))) - 1]
    assert s.n == 501 and s.mean_days == pytest.approx(days.mean())
    dist = X.duration_distribution(X.stage_durations(items, orders)).toPandas()
    assert dist["items"].sum() == 501 and dist["cum_share"].max() == pytest.approx(1.0)


def test_success_rates_and_severity(spark):
    rows = [(1, "SP", "Delivered", "1 days", dt.datetime(2020, 1, 5)),
            (2, "SP", "Delivered", "-3 days", dt.datetime(2020, 1, 6)),
            (3, "RJ", "Not_Delivered", "-45 days", dt.datetime(2020, 2, 1)),
            (4, "RJ", "Delivered", None, dt.datetime(2020, 2, 1))]
    orders = normalize_delay(spark.createDataFrame(
        rows, "order_id long, customer_state string, Net_State string, Delay string, order_purchase_timestamp timestamp"))
    st = {r.state: (r.orders, r.delivered, r.on_time_delivered, r.delivery_rate, r.on_time_rate)
          for r in X.success_rates(orders, "state").collect()}
    assert st == {"RJ": (1, 0, 0, 0.0, 0.0), "SP": (2, 2, 1, 100.0, 50.0)}
    assert [r.month for r in X.success_rates(orders, "month").collect()] == ["2020-01", "2020-02"]
    sev = [(r.delay_bin, r.orders) for r in X.delay_severity(orders.filter("delay_ns < 0")).collect()]
    assert sev == [("-5–-2", 1), (None, 1)]


def test_argument_validation(spark):
    det = _detailed(spark, [("s1", 1.0)])
    with pytest.raises(ValueError):
        X.vendor_segments(det, 0)
    no_stage = spark.createDataFrame([(1, -1.0)], "order_id long, delay_days double")
    with pytest.raises(ValueError, match="_PCT"):
        X.stage_heatmaps(no_stage)
    with pytest.raises(ValueError):
        X.success_rates(normalize_delay(spark.createDataFrame([(1, "SP", "Delivered", "1 days")],
                        "order_id long, customer_state string, Net_State string, Delay string")), by="week")


def test_rankings_on_empty_input(spark):
    det = R.prepare_data(spark.createDataFrame([], ITEMS), spark.createDataFrame([], PRODUCTS))
    assert X.vendor_segments(det).count() == 0
    assert X.vendor_concentration(det).count() == 0
    assert X.category_share_rank(det).count() == 0
    s = X.vendor_concentration_summary(det).first()
    assert s.n_vendors == 0 and s.gini is None and s.top_share is None
