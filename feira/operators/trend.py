"""Daily order trend with a rolling mean (C7: P12, A16, T6, W1, W2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily_orders(orders: DataFrame, date_col: str = "order_purchase_timestamp",
                 orders_unique: bool = False) -> DataFrame:
    """(date, orders): distinct order ids per calendar day; null dates drop
    out. ``orders_unique=True`` (one row per order asserted by the caller)
    counts rows instead: one aggregation level less."""
    count = F.count("order_id") if orders_unique else F.count_distinct("order_id")
    return (orders.select(F.to_date(F.col(date_col)).alias("date"), "order_id")
            .filter(F.col("date").isNotNull())
            .groupBy("date").agg(count.alias("orders")))


def daily_trend(orders: DataFrame, metric: str = "orders", date_col: str = "order_purchase_timestamp",
                window: int = 7, orders_unique: bool = False) -> DataFrame:
    """(date, orders, ``{metric}_roll``): mean over the current and the
    ``window - 1`` previous *rows* (days without orders are not filled). The
    rolled value is always the order count, whatever ``metric`` says.

    The window has no partition key, so it runs in one task — over the
    aggregated days (one row per calendar day), never over raw orders.
    """
    if window < 1:
        raise ValueError("window must be >= 1")
    rows = Window.orderBy("date").rowsBetween(-(window - 1), Window.currentRow)
    return (daily_orders(orders, date_col, orders_unique)
            .withColumn(f"{metric}_roll", F.avg("orders").over(rows))
            .orderBy("date"))
