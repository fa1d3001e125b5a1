"""Delivery KPIs over cleaned orders.

Inputs must have gone through ``feira.functions.delay.normalize_delay``
(``delay_ns`` present). Lateness: ``delay_ns < 0`` is late, ``> 0`` early;
zero falls in no bucket but counts in the totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feira.functions.delay import delay_days
from feira.functions.formatting import fixed
from feira.functions.numeric import safe_ratio

DELIVERED, NOT_DELIVERED = "Delivered", "Not_Delivered"
# Bucket names (the reference's result keys) and chart labels.
BUCKETS = ["delay_delivered", "delay_not_delivered", "no_delay_delivered", "no_delay_not_delivered"]
CHART_LABELS = ["No Delay", "With Delay"]


def _require_normalized(orders: DataFrame) -> None:
    if "delay_ns" not in orders.columns:
        raise ValueError("orders need a Delay column normalised with normalize_delay()")


def bucket_of() -> F.Column:
    late, early = F.col("delay_ns") < 0, F.col("delay_ns") > 0
    delivered, not_delivered = F.col("Net_State") == DELIVERED, F.col("Net_State") == NOT_DELIVERED
    return (F.when(late & delivered, F.lit(BUCKETS[0]))
            .when(late & not_delivered, F.lit(BUCKETS[1]))
            .when(early & delivered, F.lit(BUCKETS[2]))
            .when(early & not_delivered, F.lit(BUCKETS[3])))


def delivery_performance(orders: DataFrame) -> DataFrame:
    """A8–A10 in one pass: totals over rows with a delay, the four bucket
    sizes, delivery_rate and on_time_rate (0 when the denominator is 0)."""
    _require_normalized(orders)
    rows = orders.select("Net_State", "delay_ns").filter(F.col("delay_ns").isNotNull())
    late, early = F.col("delay_ns") < 0, F.col("delay_ns") > 0
    delivered, not_delivered = F.col("Net_State") == DELIVERED, F.col("Net_State") == NOT_DELIVERED
    counts = rows.agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.count_if(delivered).alias("delivered_orders"),
        F.count_if(not_delivered).alias("not_delivered_orders"),
        F.count_if(late & delivered).alias(BUCKETS[0]),
        F.count_if(late & not_delivered).alias(BUCKETS[1]),
        F.count_if(early & delivered).alias(BUCKETS[2]),
        F.count_if(early & not_delivered).alias(BUCKETS[3]))
    return counts.select(
        "total_orders", "delivered_orders", "not_delivered_orders",
        safe_ratio(F.col("delivered_orders"), F.col("total_orders"), 100.0, F.lit(0.0)).alias("delivery_rate"),
        safe_ratio(F.col(BUCKETS[2]), F.col("delivered_orders"), 100.0, F.lit(0.0)).alias("on_time_rate"),
        *BUCKETS)


def delivery_buckets(orders: DataFrame) -> DataFrame:
    """F3–F6 as one frame: every row that falls in a bucket, labelled."""
    _require_normalized(orders)
    out = orders.withColumn("bucket", bucket_of()).filter(F.col("bucket").isNotNull())
    return out if "delay_days" in out.columns else out.withColumn("delay_days", delay_days(F.col("delay_ns")))


def delayed_orders(orders: DataFrame, delivery_status: str = DELIVERED,
                   pct_col: str = "Site_Real_PCT") -> DataFrame:
    """late rows (``Delay < 0``), of one status unless ``'All'``, with
    ``delay_days`` added unless already present. ``pct_col`` is accepted and
    not used, as in the reference."""
    _require_normalized(orders)
    out = orders.filter(F.col("delay_ns") < 0)
    if delivery_status != "All":
        out = out.filter(F.col("Net_State") == delivery_status)
    if "delay_days" not in out.columns:
        out = out.withColumn("delay_days", delay_days(F.col("delay_ns")))
    return out


def delivery_chart(performance: DataFrame, chart_type: str = "delivered") -> DataFrame:
    """A18: 'No Delay' / 'With Delay' counts of delivered (``'delivered'``) or
    not-delivered (anything else) orders, their share of the two, and the
    bar label ``1,234<br>(50.0%)``."""
    if chart_type == "delivered":
        no_delay, with_delay = F.col(BUCKETS[2]), F.col(BUCKETS[0])
    else:
        no_delay, with_delay = F.col(BUCKETS[3]), F.col(BUCKETS[1])
    two = performance.select(
        F.inline(F.array(
            F.struct(F.lit(CHART_LABELS[0]).alias("category"), no_delay.alias("orders")),
            F.struct(F.lit(CHART_LABELS[1]).alias("category"), with_delay.alias("orders")))),
        (no_delay + with_delay).alias("_total"))
    pct = safe_ratio(F.col("orders"), F.col("_total"), 100.0, F.lit(0.0))
    return two.select("category", "orders", pct.alias("pct"),
                      F.concat(F.format_number(F.col("orders"), 0), F.lit("<br>("), fixed(pct, 1), F.lit("%)"))
                      .alias("label"))
