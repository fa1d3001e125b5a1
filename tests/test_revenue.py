"""C1, A1–A7, A11, F2, P3, T1–T5 and the sf0.001 golden anchors."""

import pytest
from pyspark.sql import functions as F

from feira.operators import feeds as FD
from feira.operators import revenue as R
from feira.plans.revenue_analyzer import RevenueAnalyzer, analyze_revenue_data
from feira.sources import fixtures

ITEMS = "order_id string, product_id string, seller_id string, price double, freight_value double"
PRODUCTS = ("product_id string, product_category_name string, product_weight_g double, "
            "product_length_cm double, product_height_cm double, product_width_cm double")


def _items(spark, rows):
    return spark.createDataFrame(rows, ITEMS)


def _products(spark, rows):
    return spark.createDataFrame(rows, PRODUCTS)


def test_null_safe_join_fans_out_and_fills_others(spark):
    items = _items(spark, [("o1", "a", "s", 1.0, 1.0), ("o1", None, "s", 1.0, 1.0),
                           ("o2", "z", "s", 1.0, 1.0), ("o3", "a", "s", 1.0, 1.0)])
    prods = _products(spark, [("a", "c", 1.0, 1.0, 1.0, 1.0), (None, None, 1.0, 1.0, 1.0, 1.0),
                              ("a", "d", 1.0, 1.0, 1.0, 1.0)])
    for prods in (prods, prods.hint("broadcast"), prods.hint("merge")):
        det = R.prepare_data(items, prods)
        cats = sorted(((r.product_id or "", r.product_category_name) for r in det.collect()))
        assert cats == [("", "Others"), ("a", "c"), ("a", "c"), ("a", "d"), ("a", "d"), ("z", "Others")]


def test_overlapping_columns_rejected(spark):
    items = _items(spark, [("o", "a", "s", 1.0, 1.0)]).withColumn("product_weight_g", F.lit(1.0))
    prods = _products(spark, [("a", "c", 1.0, 1.0, 1.0, 1.0)])
    with pytest.raises(ValueError, match="both sides"):
        R.prepare_data(items, prods)


def test_all_null_group_sums_to_zero_and_null_keys_drop(spark):
    items = _items(spark, [("o", "x", "x", None, None), ("o", "x", "x", None, None),
                           ("o", "y", "y", 1.0, 0.0), ("o", "n", None, 5.0, 0.0)])
    det = R.prepare_data(items, _products(spark, [("q", "c", 1.0, 1.0, 1.0, 1.0)]))
    got = {r.seller_id: r.Total for r in R.vendor_revenue(det, "price").collect()}
    assert got == {"x": 0.0, "y": 1.0}


def test_nan_behaves_as_null(spark):
    items = _items(spark, [("o1", "a", "s", float("nan"), 1.0), ("o2", "a", "s", 2.0, 1.0)])
    det = R.prepare_data(items, _products(spark, [("a", "c", float("nan"), 1.0, 1.0, 1.0)]))
    k = R.revenue_kpis(det).first()
    assert k.total_revenue == 3.0 and k.total_orders == 2 and k.average_order_value == 1.5
    assert R.volume_analysis_data(det).count() == 0
    miss = {r.column_name: r.missing_count for r in R.missing_dimensional_data(det).collect()}
    assert miss["product_weight_g"] == 2


def test_kpis_and_items_per_order(spark):
    items = _items(spark, [("o1", "a", "s", 10.0, 1.0), ("o1", "a", "s", 20.0, 2.0),
                           ("o2", "a", "s", None, None), (None, "a", "s", 100.0, 0.0)])
    det = R.prepare_data(items, _products(spark, [("a", "c", 1.0, 2.0, 3.0, 4.0)]))
    k = R.revenue_kpis(det).first()
    assert k.total_revenue == 133.0          # null order id still counts in revenue
    assert k.total_orders == 2               # ... but not as an order
    assert k.average_order_value == 16.5     # (33 + 0) / 2: all-null order contributes 0
    assert k.total_products == 4
    assert k.avg_items_per_order == 2.0
    vol = R.volume_analysis_data(det).select("Volume_cm").first()
    assert vol.Volume_cm == 4.0 * 3.0 * 2.0


def test_empty_inputs_keep_schema(spark):
    det = R.prepare_data(_items(spark, []), _products(spark, []))
    k = R.revenue_kpis(det).first()
    assert (k.total_revenue, k.total_orders, k.total_products) == (0.0, 0, 0)
    assert k.average_order_value is None and k.avg_items_per_order is None
    assert R.top_row(R.category_revenue(det), "product_category_name").count() == 0
    assert FD.top_feed(R.category_revenue(det), "product_category_name").columns == [
        "product_category_name", "Total", "label", "hover_label"]


def test_top_feed_labels_and_negative_n(spark):
    items = _items(spark, [("o", "a", "s1", 1234.5, 0.0), ("o", "a", "s2", 2.675, 0.0)])
    det = R.prepare_data(items, _products(spark, [("a", "c", 1.0, 1.0, 1.0, 1.0)]))
    rows = FD.top_feed(R.vendor_revenue(det), "seller_id", 1).collect()
    assert [(r.seller_id, r.label, r.hover_label) for r in rows] == [("s1", "R$1,234", "R$1,234.50")]
    with pytest.raises(ValueError):
        FD.top_feed(R.vendor_revenue(det), "seller_id", -1)


@pytest.fixture(scope="module")
def small(spark, sf_small):
    an = RevenueAnalyzer(fixtures.order_items(spark, sf_small), fixtures.products(spark, sf_small), persist=True)
    res = an.run_comprehensive_analysis()
    yield res
    an.release()


def test_golden_kpis_sf0001(small):
    k = small["kpis"].first()
    assert k.total_revenue == pytest.approx(278734223.39, abs=0.005)
    assert k.average_order_value == pytest.approx(188930.926351, abs=1e-6)
    assert (k.total_orders, k.total_products) == (1465, 6000)
    assert k.avg_items_per_order == pytest.approx(4.09556314, abs=1e-8)


def test_golden_rankings_sf0001(small):
    cats = small["category_revenue_all"].collect()
    assert len(cats) == 26
    assert [(r.product_category_name, round(r.Total, 2)) for r in cats[:3]] == [
        ("Others", 23094989.77), ("Brand#13", 15808785.88), ("Brand#25", 14753514.22)]
    assert round(small["category_revenue_freight"].first().Total, 2) == 885990.80
    assert round(small["category_revenue_price"].first().Total, 2) == 26530695.97
    vend = small["vendor_revenue_all"].collect()
    assert len(vend) == 9 and (vend[0].seller_id, round(vend[0].Total, 2)) == (1, 29215302.16)
    f = small["vendor_revenue_freight"].first()
    assert (f.seller_id, round(f.Total, 2)) == (3, 1162367.72)
    p = small["vendor_revenue_price"].first()
    assert (p.seller_id, round(p.Total, 2)) == (1, 33871174.08)
    assert small["top_category"].first().product_category_name == "Others"
    assert small["top_vendor"].first().seller_id == 1


def test_golden_dimensions_sf0001(small):
    miss = {r.column_name: r.missing_count for r in small["missing_dimensional_data"].collect()}
    assert miss == {"product_weight_g": 336, "product_length_cm": 284,
                    "product_height_cm": 191, "product_width_cm": 324}
    vol = small["volume_analysis_data"].agg(F.count("*").alias("n"), F.sum("Volume_cm").alias("v")).first()
    assert (vol.n, vol.v) == (5438, 24235363.0)


def test_convenience_wrapper_keys(spark, sf_small):
    res = analyze_revenue_data(fixtures.order_items(spark, sf_small), fixtures.products(spark, sf_small))
    for key in ["total_revenue", "average_order_value", "total_orders", "total_products",
                "avg_items_per_order", "category_revenue_all", "category_revenue_freight",
                "category_revenue_price", "vendor_revenue_all", "vendor_revenue_freight",
                "vendor_revenue_price", "volume_analysis_data", "missing_dimensional_data",
                "top_category", "top_vendor", "order_items_detailed"]:
        assert key in res


def test_revenue_display_row(small):
    row = FD.revenue_metrics_display(small["kpis"]).first()
    assert row.total_revenue == "R$278,734,223.39"
    assert row.total_orders == "1,465" and row.total_products == "6,000"
    assert row.avg_items_per_order == "4.10"


def test_top_feed_bounds_like_head(spark):
    items = _items(spark, [("o", "a", "s1", 3.0, 0.0), ("o", "a", "s2", 2.0, 0.0)])
    det = R.prepare_data(items, _products(spark, [("a", "c", 1.0, 1.0, 1.0, 1.0)]))
    assert FD.top_feed(R.vendor_revenue(det), "seller_id", 0).count() == 0
    assert [r.seller_id for r in FD.top_feed(R.vendor_revenue(det), "seller_id", 15).collect()] == ["s1", "s2"]
