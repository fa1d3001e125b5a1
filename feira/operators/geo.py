"""Per-state geo feed (C6: F8, F9, A12–A15, P13, P15, P16, F10, W3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feira.functions.formatting import plain_number
from feira.functions.numeric import exact_sum
from feira.sources.states import states_df


def state_values(orders: DataFrame, metric: str = "orders", status: str = "All",
                 delayed_only: bool = False, orders_unique: bool = False) -> DataFrame:
    """(customer_state, value) before the state lookup.

    ``'orders'`` and ``'delayed'`` count distinct order ids, anything else sums
    ``TOTAL`` (or counts distinct orders when there is no ``TOTAL``). The
    distinct count plans as a two-level aggregate keyed by (state, order_id)
    first, so a state holding most orders does not land in one task. When
    the caller asserts one row per order (``orders_unique=True``) a plain
    count is used: one aggregation level and one shuffle less.
    """
    df = orders
    if status != "All":
        df = df.filter(F.col("Net_State") == status)
    if delayed_only or metric == "delayed":
        if "delay_ns" not in df.columns:
            raise ValueError("delayed filtering needs a Delay column normalised with normalize_delay()")
        df = df.filter(F.col("delay_ns") < 0)
    df = df.filter(F.col("customer_state").isNotNull())
    if metric in ("orders", "delayed") or "TOTAL" not in df.columns:
        value = F.count("order_id") if orders_unique else F.count_distinct("order_id")
    else:
        value = exact_sum("TOTAL")
    return df.groupBy("customer_state").agg(value.alias("value"))


def geo_feed(orders: DataFrame, metric: str = "orders", status: str = "All",
             delayed_only: bool = False, bubble_size_multiplier: float = 1.0,
             orders_unique: bool = False) -> DataFrame:
    """Rows (state, state_name, lat, lon, value, bubble_size, label) for the
    states that have coordinates, ordered by state.

    The aggregate has one row per state; the inner join with the 27-row
    state dimension (broadcast, fixed size) drops states without
    coordinates; min/max for the bubble scale run over those ≤ 27 rows.
    """
    values = (state_values(orders, metric, status, delayed_only, orders_unique)
              .withColumnRenamed("customer_state", "state"))
    located = values.join(states_df(orders.sparkSession), "state", "inner")
    everything = Window.partitionBy()
    lo, hi = F.min("value").over(everything), F.max("value").over(everything)
    scaled = F.when(hi > lo, F.lit(10) + F.lit(30) * (F.col("value") - lo) / (hi - lo)).otherwise(F.lit(20.0))
    integral = metric in ("orders", "delayed") or "TOTAL" not in orders.columns
    return (located
            .withColumn("bubble_size", scaled.cast("double") * F.lit(float(bubble_size_multiplier)))
            .withColumn("label", F.concat(F.col("state"), F.lit("<br>"), plain_number(F.col("value"), integral)))
            .select("state", "state_name", "lat", "lon", "value", "bubble_size", "label")
            .orderBy("state"))
