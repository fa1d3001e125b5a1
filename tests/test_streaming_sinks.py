"""Streaming refresh of the delivery KPIs and the CSV sink."""

import datetime as dt
import os

from feira.functions.delay import normalize_delay
from feira.operators.delivery import delivery_performance
from feira.sources.sinks import export_csv
from feira.streaming.delivery_stream import ORDERS_STREAM_SCHEMA, start_delivery_kpis

T0 = dt.datetime(2020, 1, 1)


def _batch(spark, rows, path):
    spark.createDataFrame(rows, ORDERS_STREAM_SCHEMA).write.mode("append").parquet(path)


def test_stream_matches_batch(spark, tmp_path):
    src, ckpt = str(tmp_path / "in"), str(tmp_path / "ckpt")
    first = [(1, "SP", "Delivered", "-1 days +00:00:00", 10.0, 1.0, T0),
             (2, "SP", "Delivered", "2 days", 10.0, 1.0, T0)]
    second = [(3, "RJ", "Not_Delivered", "-02:00:00", 10.0, 1.0, T0),
              (4, "RJ", "Delivered", "garbage", 10.0, 1.0, T0)]
    _batch(spark, first, src)
    q = start_delivery_kpis(spark, src, ckpt, query_name="kpis_a", available_now=True)
    q.awaitTermination(120)
    assert spark.table("kpis_a").first().total_orders == 2
    _batch(spark, second, src)
    q = start_delivery_kpis(spark, src, ckpt, query_name="kpis_b", available_now=True)  # resumes from checkpoint
    q.awaitTermination(120)
    streamed = spark.table("kpis_b").first()
    batch = delivery_performance(normalize_delay(
        spark.createDataFrame(first + second, ORDERS_STREAM_SCHEMA), on_error="null")).first()
    assert streamed == batch and streamed.total_orders == 3


def test_csv_export(spark, tmp_path):
    out = str(tmp_path / "csv")
    export_csv(spark.createDataFrame([(1, "a")], "x int, y string"), out)
    back = spark.read.option("header", True).csv(out)
    assert back.columns == ["x", "y"] and back.count() == 1
    assert any(f.endswith(".csv") for f in os.listdir(out))


def test_csv_inputs_round_trip(spark, tmp_path):
    from feira.operators import revenue as R
    from feira.plans.orders_analyzer import OrdersAnalyzer
    from feira.sources.readers import read_order_items, read_orders, read_products

    items = spark.createDataFrame(
        [("o1", "1", "p1", "s1", "2020-01-01 10:00:00", "10.5", "1.25"),
         ("o1", "2", "p9", "s1", "2020-01-01 10:00:00", "4.5", "")],
        "order_id string, order_item_id string, product_id string, seller_id string, "
        "shipping_limit_date string, price string, freight_value string")
    prods = spark.createDataFrame([("12", "p1", "toys", "100", "10", "10")],
                                  "product_width_cm string, product_id string, product_category_name string, "
                                  "product_weight_g string, product_length_cm string, product_height_cm string")
    orders = spark.createDataFrame([("o1", "SP", "Delivered", "-1 days +20:00:00", "55.5", "12.0", "2020-01-01")],
                                   "order_id string, customer_state string, Net_State string, Delay string, "
                                   "Site_Real_PCT string, TOTAL string, order_purchase_timestamp string")
    for df, name in ((items, "items"), (prods, "products"), (orders, "orders")):
        export_csv(df, str(tmp_path / name))
    oi = read_order_items(spark, str(tmp_path / "items"))
    pr = read_products(spark, str(tmp_path / "products"))
    assert dict(oi.dtypes)["price"] == "double" and dict(pr.dtypes)["product_width_cm"] == "double"
    k = R.revenue_kpis(R.prepare_data(oi, pr)).first()
    assert (k.total_revenue, k.total_orders, k.total_products) == (11.75, 1, 2)
    od = read_orders(spark, str(tmp_path / "orders"))
    assert dict(od.dtypes)["Site_Real_PCT"] == "double"
    perf = OrdersAnalyzer(od).get_delivery_performance()["kpis"].first()
    assert (perf.total_orders, perf.delay_delivered) == (1, 1)


def test_daily_orders_stream_matches_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from feira.operators.trend import daily_orders
    from feira.streaming.daily_stream import latest_daily_orders, start_daily_orders
    from feira.streaming.delivery_stream import orders_stream

    src, ckpt, out = str(tmp_path / "in"), str(tmp_path / "ckpt"), str(tmp_path / "out")
    day = lambda d, h=12: dt.datetime(2020, 1, d, h)
    first = [(1, "SP", "Delivered", "1 days", 1.0, 1.0, day(1)), (2, "SP", "Delivered", "1 days", 1.0, 1.0, day(1)),
             (3, "SP", "Delivered", "1 days", 1.0, 1.0, day(2))]
    # a duplicate of order 2, a late order for Jan 1 (within the 2-day watermark), a new day
    second = [(2, "SP", "Delivered", "1 days", 1.0, 1.0, day(1)), (4, "SP", "Delivered", "1 days", 1.0, 1.0, day(1, 20)),
              (5, "SP", "Delivered", "1 days", 1.0, 1.0, day(3)),
              (1, "SP", "Delivered", "1 days", 1.0, 1.0, day(2))]  # order 1 on a second day counts there too
    _batch(spark, first, src)
    start_daily_orders(orders_stream(spark, src), ckpt, out, available_now=True).awaitTermination(120)
    _batch(spark, second, src)
    # restarted query: resumes from the checkpoint (offsets, watermark, dedup state)
    start_daily_orders(orders_stream(spark, src), ckpt, out, available_now=True).awaitTermination(120)
    streamed = {r.date: r.orders for r in latest_daily_orders(spark, out).collect()}
    batch = {r.date: r.orders for r in daily_orders(
        spark.createDataFrame(first + second, ORDERS_STREAM_SCHEMA).withColumn("x", F.lit(1))).collect()}
    assert streamed == batch == {dt.date(2020, 1, 1): 3, dt.date(2020, 1, 2): 2, dt.date(2020, 1, 3): 1}
