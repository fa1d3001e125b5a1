"""FIXTURES §3 golden anchors at sf0.01 (computed independently with pandas
and Spark before this code existed)."""

import pytest
from pyspark.sql import functions as F

from feira.functions.delay import normalize_delay
from feira.operators import delivery as D
from feira.operators import revenue as R
from feira.operators.geo import geo_feed
from feira.operators.trend import daily_trend
from feira.sources import fixtures

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def detailed(spark):
    return R.prepare_data(fixtures.order_items(spark, SF), fixtures.products(spark, SF))


def test_revenue_anchors(detailed):
    k = R.revenue_kpis(detailed).first()
    assert k.total_revenue == pytest.approx(2834204410.47, abs=0.005)
    assert k.average_order_value == pytest.approx(192152.684573, abs=1e-6)
    assert (k.total_orders, k.total_products) == (14673, 60000)
    assert k.avg_items_per_order == pytest.approx(4.089143324, abs=1e-9)
    cats = R.category_revenue(detailed).collect()
    assert len(cats) == 26
    assert [(r.product_category_name, round(r.Total, 2)) for r in cats[:3]] == [
        ("Others", 221670771.54), ("Brand#4", 129987822.21), ("Brand#19", 128352718.77)]
    assert round(R.category_revenue(detailed, "freight_value").first().Total, 2) == 8497388.38
    assert round(R.category_revenue(detailed, "price").first().Total, 2) == 248060585.05
    vend = R.vendor_revenue(detailed).collect()
    assert len(vend) == 98 and (vend[0].seller_id, round(vend[0].Total, 2)) == (98, 31181399.42)
    f, p = R.vendor_revenue(detailed, "freight_value").first(), R.vendor_revenue(detailed, "price").first()
    assert (f.seller_id, round(f.Total, 2), p.seller_id, round(p.Total, 2)) == (98, 1229327.74, 79, 35051113.24)


def test_dimension_anchors(detailed):
    miss = {r.column_name: r.missing_count for r in R.missing_dimensional_data(detailed).collect()}
    assert miss == {"product_weight_g": 3256, "product_length_cm": 3023,
                    "product_height_cm": 1602, "product_width_cm": 3028}
    vol = R.volume_analysis_data(detailed).agg(F.count("*").alias("n"), F.sum("Volume_cm").alias("v")).first()
    assert (vol.n, vol.v) == (54006, 251689099.0)


def test_delivery_geo_trend_anchors(spark):
    orders = normalize_delay(fixtures.orders_with_delay(spark, SF))
    k = D.delivery_performance(orders).first()
    assert (k.total_orders, k.delivered_orders, k.not_delivered_orders) == (14845, 9405, 4924)
    assert (k.delay_delivered, k.delay_not_delivered, k.no_delay_delivered, k.no_delay_not_delivered) == (
        4738, 2535, 4539, 2331)
    g = geo_feed(orders).agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).first()
    assert (g.n, g.lo, g.hi) == (24, 401, 752)
    assert geo_feed(orders, "revenue").agg(F.sum("value")).first()[0] == pytest.approx(3596816909.29, abs=0.005)
    trend = daily_trend(fixtures.seller_orders(spark, SF)).collect()
    assert len(trend) == 2399 and trend[3].orders_roll == 4.0
    assert sum(r.orders_roll for r in trend) == pytest.approx(14992.233333, abs=1e-6)
