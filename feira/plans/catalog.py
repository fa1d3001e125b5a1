"""Named queries: each takes (spark, sf_dir) and returns a lazy DataFrame.

These are the analyses of the dashboard run over the whole derived inputs
(``feira.sources.fixtures``); ``feira.plans.oracle`` holds the equivalent
SQL for the independent check.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feira.functions.delay import delay_days, normalize_delay
from feira.operators import delivery as D
from feira.functions.numeric import exact
from feira.operators import extras as X
from feira.operators import feeds as FD
from feira.operators import order_bitmaps as OB
from feira.operators import revenue as R
from feira.operators import stages as ST
from feira.operators.exact_totals import exact_totals
from feira.operators.geo import geo_feed
from feira.operators.heatmap import heatmap_cell_text, heatmap_grid, heatmap_long
from feira.operators.trend import daily_orders, daily_trend
from feira.session import ensure_checkpoint_dir
from feira.sources import fixtures
from feira.sources.bucketed import left_join_bucketed, save_bucketed
from feira.sources.partials import FilePartials
from feira.sources.tables import table_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
# Parameter of the bucketed tables.
BUCKETS = 16


def query(name: str):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return register


# ---------------------------------------------------------------- revenue

def detailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.prepare_data(fixtures.order_items(spark, sf_dir), fixtures.products(spark, sf_dir))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``detailed``, without the product columns."""
    return R.items_as_joined(fixtures.order_items(spark, sf_dir), fixtures.products(spark, sf_dir))


@query("order_items_detailed")
def q_order_items_detailed(spark, sf_dir):
    return detailed(spark, sf_dir).select(
        "order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value",
        "product_category_name", "Total")


@query("order_totals")
def q_order_totals(spark, sf_dir):
    return R.order_totals(items(spark, sf_dir))


@query("revenue_kpis")
def q_revenue_kpis(spark, sf_dir):
    return R.revenue_kpis(items(spark, sf_dir))


def _by(kind: str, metric: str) -> Query:
    def run(spark, sf_dir):
        if kind == "category":
            return R.category_revenue(detailed(spark, sf_dir), metric)
        return R.vendor_revenue(items(spark, sf_dir), metric)
    return run


for _kind, _prefix in (("category", "category_revenue"), ("vendor", "vendor_revenue")):
    for _metric, _suffix in (("Total", "all"), ("freight_value", "freight"), ("price", "price")):
        QUERIES[f"{_prefix}_{_suffix}"] = _by(_kind, _metric)


@query("missing_dimensional_data")
def q_missing(spark, sf_dir):
    return R.missing_dimensional_data(detailed(spark, sf_dir))


def volume(spark, sf_dir):
    return R.volume_analysis_data(detailed(spark, sf_dir))


@query("volume_analysis_data")
def q_volume(spark, sf_dir):
    return volume(spark, sf_dir).select(
        "order_id", "order_item_id", "product_id", "price", "freight_value", "product_weight_g", "Volume_cm")


@query("top_category")
def q_top_category(spark, sf_dir):
    return R.top_row(R.category_revenue(detailed(spark, sf_dir), sort=False), "product_category_name")


@query("top_vendor")
def q_top_vendor(spark, sf_dir):
    return R.top_row(R.vendor_revenue(items(spark, sf_dir), sort=False), "seller_id")


@query("top_categories_feed")
def q_top_categories_feed(spark, sf_dir):
    return FD.top_feed(R.category_revenue(detailed(spark, sf_dir), sort=False), "product_category_name", 15)


@query("top_vendors_feed")
def q_top_vendors_feed(spark, sf_dir):
    return FD.top_feed(R.vendor_revenue(items(spark, sf_dir), sort=False), "seller_id", 15)


@query("freight_weight_feed")
def q_freight_weight(spark, sf_dir):
    return FD.freight_weight_feed(volume(spark, sf_dir))


@query("freight_volume_feed")
def q_freight_volume(spark, sf_dir):
    return FD.freight_volume_feed(volume(spark, sf_dir))


@query("freight_price_feed")
def q_freight_price(spark, sf_dir):
    return FD.freight_price_feed(volume(spark, sf_dir))


@query("price_weight_volume_feed")
def q_price_weight_volume(spark, sf_dir):
    return FD.price_weight_volume_feed(volume(spark, sf_dir))


@query("small_value_totals")
def q_small_values(spark, sf_dir):
    """Sums of values with six decimals per vendor (nothing is rounded before it is summed)."""
    items = fixtures.order_items(spark, sf_dir).withColumn("small", (F.col("order_id") % 1000003).cast("double") / 1000000.0)
    return R.vendor_revenue(items, "small", sort=False)


@query("vendor_totals_any_size")
def q_vendor_totals_any_size(spark, sf_dir):
    """Totals per vendor, rounded once, of values from 1e-24 to 1e29 (binary multiples of the amounts)."""
    sized = items(spark, sf_dir).filter("seller_id IS NOT NULL").select(
        "seller_id", "Total", (F.col("price") * 2.0 ** -80).alias("price_tiny"), (F.col("freight_value") * 2.0 ** 80).alias("freight_huge"))
    return exact_totals(sized, ["seller_id"], ["Total", "price_tiny", "freight_huge"])


@query("revenue_metrics_display")
def q_revenue_display(spark, sf_dir):
    return FD.revenue_metrics_display(R.revenue_kpis(items(spark, sf_dir)))


# --------------------------------------------------------------- delivery

def orders(spark: SparkSession, sf_dir: str, delay_format: str = "interval", on_error: str = "fail", state: bool = False) -> DataFrame:
    return normalize_delay(fixtures.orders_with_delay(spark, sf_dir, delay_format, state), on_error=on_error)


@query("delay_normalized")
def q_delay_normalized(spark, sf_dir):
    # Delay arrives as pandas text ("-8 days +07:32:10") and is parsed back.
    return orders(spark, sf_dir, "text").select("order_id", delay_days(F.col("delay_ns")).alias("delay_days"))


@query("delivery_performance")
def q_delivery_performance(spark, sf_dir):
    return D.delivery_performance(orders(spark, sf_dir))


@query("delivery_buckets")
def q_delivery_buckets(spark, sf_dir):
    return D.delivery_buckets(orders(spark, sf_dir, "text")).select("order_id", "Net_State", "delay_days", "bucket")


def _delayed(status: str) -> Query:
    def run(spark, sf_dir):
        return D.delayed_orders(orders(spark, sf_dir), status).select(
            "order_id", "Net_State", "delay_days", "Site_Real_PCT")
    return run


QUERIES["delayed_orders_delivered"] = _delayed("Delivered")
QUERIES["delayed_orders_not_delivered"] = _delayed("Not_Delivered")
QUERIES["delayed_orders_all"] = _delayed("All")


@query("delay_heatmap")
def q_delay_heatmap(spark, sf_dir):
    return heatmap_grid(D.delayed_orders(orders(spark, sf_dir), "All"), "Site_Real_PCT")


@query("delay_heatmap_delivered")
def q_delay_heatmap_delivered(spark, sf_dir):
    # the dashboard's default view: late orders of the default status 'Delivered'
    return heatmap_grid(D.delayed_orders(orders(spark, sf_dir)), "Site_Real_PCT")


@query("delay_heatmap_long")
def q_delay_heatmap_long(spark, sf_dir):
    return heatmap_long(D.delayed_orders(orders(spark, sf_dir), "All"), "Site_Real_PCT")


@query("delay_heatmap_text")
def q_delay_heatmap_text(spark, sf_dir):
    return heatmap_cell_text(heatmap_grid(D.delayed_orders(orders(spark, sf_dir), "All"), "Site_Real_PCT"))


@query("delivery_chart_delivered")
def q_chart_delivered(spark, sf_dir):
    return D.delivery_chart(D.delivery_performance(orders(spark, sf_dir)), "delivered")


@query("delivery_chart_not_delivered")
def q_chart_not_delivered(spark, sf_dir):
    return D.delivery_chart(D.delivery_performance(orders(spark, sf_dir)), "not_delivered")


@query("delivery_metrics_display")
def q_delivery_display(spark, sf_dir):
    return FD.delivery_metrics_display(D.delivery_performance(orders(spark, sf_dir)))


@query("geo_orders")
def q_geo_orders(spark, sf_dir):
    return geo_feed(orders(spark, sf_dir, state=True), metric="orders")


@query("geo_delayed")
def q_geo_delayed(spark, sf_dir):
    return geo_feed(orders(spark, sf_dir, on_error="null", state=True), metric="delayed")


@query("geo_revenue")
def q_geo_revenue(spark, sf_dir):
    return geo_feed(orders(spark, sf_dir, state=True), metric="revenue")


@query("geo_delivered_delayed_only")
def q_geo_delivered_delayed(spark, sf_dir):
    return geo_feed(orders(spark, sf_dir, on_error="null", state=True), metric="orders", status="Delivered",
                    delayed_only=True)


@query("daily_orders")
def q_daily_orders(spark, sf_dir):
    return daily_orders(fixtures.seller_orders(spark, sf_dir, state=False))


@query("daily_trend_7")
def q_daily_trend(spark, sf_dir):
    return daily_trend(fixtures.seller_orders(spark, sf_dir, state=False), "orders", window=7)


@query("daily_trend_revenue_7")
def q_daily_trend_revenue(spark, sf_dir):
    # metric='revenue' still rolls the daily order count, as the reference does
    return daily_trend(fixtures.seller_orders(spark, sf_dir, state=False), "revenue", window=7)


# ------------------------------------------- readme-only (definitions ours)

@query("vendor_segments")
def q_vendor_segments(spark, sf_dir):
    return X.vendor_segments(items(spark, sf_dir), 10)


@query("vendor_concentration")
def q_vendor_concentration(spark, sf_dir):
    return X.vendor_concentration(items(spark, sf_dir))


@query("vendor_concentration_summary")
def q_vendor_concentration_summary(spark, sf_dir):
    return X.vendor_concentration_summary(items(spark, sf_dir), 10)


@query("category_share_rank")
def q_category_share_rank(spark, sf_dir):
    return X.category_share_rank(detailed(spark, sf_dir))


@query("state_order_share")
def q_state_order_share(spark, sf_dir):
    return X.state_order_share(fixtures.seller_orders(spark, sf_dir))


@query("price_freight_correlation")
def q_price_freight_correlation(spark, sf_dir):
    return X.price_freight_correlation(volume(spark, sf_dir))


@query("freight_efficiency")
def q_freight_efficiency(spark, sf_dir):
    return X.freight_efficiency(volume(spark, sf_dir))


def durations(spark, sf_dir):
    return X.stage_durations(fixtures.order_items(spark, sf_dir), fixtures.seller_orders(spark, sf_dir, state=False))


@query("stage_duration_distribution")
def q_stage_duration_distribution(spark, sf_dir):
    return X.duration_distribution(durations(spark, sf_dir))


@query("stage_duration_summary")
def q_stage_duration_summary(spark, sf_dir):
    return X.duration_summary(durations(spark, sf_dir))


@query("delay_severity")
def q_delay_severity(spark, sf_dir):
    return X.delay_severity(D.delayed_orders(orders(spark, sf_dir), "All"))


@query("stage_heatmaps")
def q_stage_heatmaps(spark, sf_dir):
    return X.stage_heatmaps(D.delayed_orders(orders(spark, sf_dir), "All"))


@query("state_success_rates")
def q_state_success_rates(spark, sf_dir):
    return X.success_rates(orders(spark, sf_dir, state=True), "state")


@query("monthly_success_rates")
def q_monthly_success_rates(spark, sf_dir):
    return X.success_rates(orders(spark, sf_dir), "month")


# ------------------------------------------- other data, other forms

@query("delay_text_forms")
def q_delay_text_forms(spark, sf_dir):
    # eleven kinds of Delay text; what is no duration becomes null
    return orders(spark, sf_dir, "forms", on_error="null").select("order_id", "delay_ns")


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.order_stages(spark, sf_dir)
    return normalize_delay(rows.withColumn("Delay", F.col("delay_seconds") * F.expr("INTERVAL '1' SECOND")))


# Parameters of the stage queries: name, start and end of each stage.
STAGES = [("approval", "purchased_at", "approved_at"), ("handling", "approved_at", "carrier_at"),
          ("delivery", "carrier_at", "delivered_at")]


@query("stage_seconds_quantiles")
def q_stage_seconds_quantiles(spark, sf_dir):
    return ST.stage_quantiles(ST.stage_seconds(fixtures.order_stages(spark, sf_dir), STAGES))


@query("stage_heatmaps_all")
def q_stage_heatmaps_all(spark, sf_dir):
    return ST.stage_heatmaps(D.delayed_orders(staged(spark, sf_dir), "All"))


@query("delay_bins_by_range_set")
def q_delay_bins_by_range_set(spark, sf_dir):
    # each delivery status has ranges of its own
    ranges = spark.createDataFrame(
        [("Delivered", *r) for r in ((-30.0, -20.0), (-20.0, -10.0), (-10.0, -5.0), (-5.0, -2.0), (-2.0, 0.0))]
        + [("Not_Delivered", *r) for r in ((-35.0, -28.0), (-28.0, -7.5), (-7.5, -1.0))], "range_set string, low double, high double")
    return ST.delay_bins_by_set(D.delayed_orders(orders(spark, sf_dir), "All"), ranges, "Net_State")


@query("success_rate_levels")
def q_success_rate_levels(spark, sf_dir):
    return ST.success_rate_levels(orders(spark, sf_dir, state=True))


def repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.prepare_data(fixtures.order_items(spark, sf_dir), fixtures.products_with_repeats(spark, sf_dir))


@query("order_items_fan_out")
def q_order_items_fan_out(spark, sf_dir):
    # products with repeated and null ids: items fan out, null ids match null ids
    return repeated(spark, sf_dir).select("order_id", "order_item_id", "product_id", "product_category_name",
                                          "product_weight_g", "Total")


@query("vendor_revenue_fan_out")
def q_vendor_revenue_fan_out(spark, sf_dir):
    return R.vendor_revenue(R.items_as_joined(fixtures.order_items(spark, sf_dir), fixtures.products_with_repeats(spark, sf_dir)))


def repeated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.seller_orders(spark, sf_dir, repeats=True)
    return normalize_delay(rows.withColumn("Delay", F.col("delay_seconds") * F.expr("INTERVAL '1' SECOND")))


@query("geo_orders_repeated")
def q_geo_orders_repeated(spark, sf_dir):
    return geo_feed(repeated_orders(spark, sf_dir), metric="orders")


@query("geo_delayed_repeated")
def q_geo_delayed_repeated(spark, sf_dir):
    return geo_feed(repeated_orders(spark, sf_dir), metric="delayed")


@query("daily_trend_repeated")
def q_daily_trend_repeated(spark, sf_dir):
    return daily_trend(fixtures.seller_orders(spark, sf_dir, state=False, repeats=True), "orders", window=7)


@query("orders_by_state_bitmaps")
def q_orders_by_state_bitmaps(spark, sf_dir):
    # two parts, as if a second file had come later; orders repeat in and across them
    rows = repeated_orders(spark, sf_dir)
    keys = [F.col("customer_state").alias("state"), F.col("Net_State"), (F.col("delay_ns") < 0).alias("late")]
    day = F.col("order_purchase_timestamp") < F.expr("TIMESTAMP_NTZ '1995-01-01'")
    table = OB.united(OB.order_bitmaps(rows.filter(day), keys), OB.order_bitmaps(rows.filter(~day | day.isNull()), keys))
    states = table.filter(F.col("state").isNotNull())
    out = OB.distinct_orders(states, ["state"])
    for name, where in (("delayed", F.col("late")), ("delivered", F.col("Net_State") == "Delivered")):
        out = out.join(OB.distinct_orders(states, ["state"], name, where), "state", "left")
    return out.na.fill(0)


@query("daily_orders_bitmaps")
def q_daily_orders_bitmaps(spark, sf_dir):
    rows = fixtures.seller_orders(spark, sf_dir, state=False, repeats=True).filter(F.col("order_purchase_timestamp").isNotNull())
    return OB.distinct_orders(OB.order_bitmaps(rows, [F.to_date("order_purchase_timestamp").alias("date")]), ["date"])


@query("order_items_co_located")
def q_order_items_co_located(spark, sf_dir):
    # both sides as bucketed tables in the session's shared folder; the rows with a product id meet without a shuffle
    root, name = f"{ensure_checkpoint_dir(spark).rstrip('/')}/bucketed-{uuid.uuid4().hex}", f"feira_{uuid.uuid4().hex}"
    left = save_bucketed(fixtures.order_items(spark, sf_dir), f"{name}_items", "product_id", BUCKETS, f"{root}/items")
    right = save_bucketed(fixtures.products_with_repeats(spark, sf_dir), f"{name}_products", "product_id", BUCKETS, f"{root}/products")
    joined = left_join_bucketed(left, right, "product_id")
    return joined.select("order_id", "order_item_id", "product_id",
                         F.coalesce("product_category_name", F.lit(R.OTHERS)).alias("product_category_name"),
                         "product_weight_g", (F.col("price") + F.col("freight_value")).alias("Total"))


@query("vendor_totals_from_parts")
def q_vendor_totals_from_parts(spark, sf_dir):
    # partial sums per file are stored; the second refresh finds no new file
    path = table_path(sf_dir, "lineitem")

    def partial(rows: DataFrame, file_col: str) -> DataFrame:
        return rows.groupBy(file_col, F.col("l_suppkey").alias("seller_id")).agg(
            F.count(F.lit(1)).alias("items"), F.sum(exact("l_extendedprice")).alias("price"))

    store = FilePartials(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/partials-{uuid.uuid4().hex}",
                         lambda paths: spark.read.parquet(*paths), partial)
    store.refresh(path)
    store.refresh(path)
    return store.rows(path).groupBy("seller_id").agg(F.sum("items").alias("items"), F.sum("price").cast("double").alias("price"))


@query("vendor_revenue_ranked")
def q_vendor_revenue_ranked(spark, sf_dir):
    # the order of the ranking as a column
    return X.exact_ranking(items(spark, sf_dir), "seller_id")


@query("daily_trend_ranked")
def q_daily_trend_ranked(spark, sf_dir):
    # one row per day: an un-keyed window is bounded by the calendar
    trend = daily_trend(fixtures.seller_orders(spark, sf_dir, state=False), "orders", window=7)
    return trend.withColumn("place", F.row_number().over(Window.orderBy("date")).cast("long"))
