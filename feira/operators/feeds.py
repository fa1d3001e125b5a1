"""Chart feeds and display rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feira.functions.formatting import currency, fixed, thousands


def top_feed(revenue: DataFrame, key: str, top_n: int = 15) -> DataFrame:
    """First ``top_n`` keys by Total with bar labels ``R$1,234`` and hover
    labels ``R$1,234.56``; the key is shown as text. Plans as
    TakeOrderedAndProject (per-task top-n, no full sort)."""
    if top_n < 0:
        raise ValueError("top_n must be >= 0")
    return (revenue.orderBy(F.desc("Total"), F.asc(key)).limit(top_n)
            .select(F.col(key).cast("string").alias(key), "Total",
                    currency(F.col("Total"), 0).alias("label"),
                    currency(F.col("Total"), 2).alias("hover_label")))


def freight_weight_feed(volume: DataFrame) -> DataFrame:
    return volume.select("product_weight_g", "freight_value")


def freight_volume_feed(volume: DataFrame) -> DataFrame:
    return volume.select("Volume_cm", "freight_value")


def freight_price_feed(volume: DataFrame) -> DataFrame:
    return volume.select("price", "freight_value")


def price_weight_volume_feed(volume: DataFrame) -> DataFrame:
    return volume.select("product_weight_g", "price", "Volume_cm",
                         (F.col("Volume_cm") / F.lit(100)).alias("bubble_size"))


def revenue_metrics_display(kpis: DataFrame) -> DataFrame:
    """The five revenue KPIs as display strings."""
    return kpis.select(
        currency(F.col("total_revenue"), 2).alias("total_revenue"),
        currency(F.col("average_order_value"), 2).alias("average_order_value"),
        thousands(F.col("total_orders"), 0).alias("total_orders"),
        thousands(F.col("total_products"), 0).alias("total_products"),
        fixed(F.col("avg_items_per_order"), 2).alias("avg_items_per_order"))


def delivery_metrics_display(performance: DataFrame) -> DataFrame:
    """Delivery KPIs as display strings (rates with one decimal)."""
    return performance.select(
        thousands(F.col("total_orders"), 0).alias("total_orders"),
        F.concat(thousands(F.col("delivered_orders"), 0), F.lit(" ("),
                 fixed(F.col("delivery_rate"), 1), F.lit("%)")).alias("delivered_orders"),
        F.concat(fixed(F.col("on_time_rate"), 1), F.lit("%")).alias("on_time_rate"),
        thousands(F.col("delay_delivered"), 0).alias("delay_delivered"),
        thousands(F.col("delay_not_delivered"), 0).alias("delay_not_delivered"))
