"""Capabilities the dashboard's readme names without defining them.

Definitions here are ours (the reference has no code for them); each is a
plain distributed DataFrame job over the same inputs.

* D1 vendor segments: equal-count revenue segments by rank (deciles by default).
* D2 concentration: Lorenz-style cumulative shares per vendor; Gini and
  top-decile share; per-state share of orders (regional concentration).
* D3 Pearson correlation of price and freight over dimension-complete rows.
* D4 freight efficiency per category: freight per kg, per litre, per price.
* D5 purchase-to-shipping-limit stage duration: histogram in whole days with
  exact nearest-rank quantiles read from it.
* D6 delay severity: late orders per delay class (heat-map delay bins).
* D7 stage-wise delay patterns: the heat map of every ``*_PCT`` column, in
  one pass (``feira.operators.stages``, as are D5 in seconds and D8 by levels).
* D8 delivery success / on-time rates per state and per purchase month.
* D9 category revenue share and rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feira.functions.bins import DEFAULT_DELAY_RANGES, edges_from_ranges, label_of, range_labels, right_closed_bin
from feira.functions.numeric import EXACT, exact, safe_ratio
from feira.operators.delivery import DELIVERED, NOT_DELIVERED
from feira.operators.heatmap import with_delay_days
from feira.operators.ranking import ranked_by
from feira.operators.stages import stage_heatmaps  # noqa: F401  (D7)


def exact_revenue_by(detailed: DataFrame, key: str, metric: str = "Total") -> DataFrame:
    """(key, Total double, _exact): Σ metric per non-null key, ``_exact`` in
    as an exact decimal."""
    return (detailed.filter(F.col(key).isNotNull()).groupBy(key)
            .agg(F.coalesce(F.sum(exact(metric)), F.lit(0).cast(EXACT)).alias("_exact"))
            .withColumn("Total", F.col("_exact").cast("double")))


def _money_ratio(num: str, den: str):
    return safe_ratio(F.col(num).cast("double"), F.col(den).cast("double"))


def _ranked(detailed: DataFrame, key: str) -> DataFrame:
    return ranked_by(exact_revenue_by(detailed, key), "_exact", key)


def exact_ranking(detailed: DataFrame, key: str) -> DataFrame:
    """T1 with the order as a column: (key, Total, position), Total descending, key ascending."""
    return _ranked(detailed, key).select(key, "Total", "position")


def vendor_segments(detailed: DataFrame, segments: int = 10) -> DataFrame:
    """(seller_id, Total, position, segment); segment 1 = top revenue.
    ``segment = (position - 1) * segments // n + 1``: equal-count groups."""
    if segments < 1:
        raise ValueError("segments must be >= 1")
    r = _ranked(detailed, "seller_id")
    seg = F.floor((F.col("position") - 1) * F.lit(segments) / F.col("n_rows")).cast("long") + 1
    return r.select("seller_id", "Total", "position", seg.alias("segment"))


def vendor_concentration(detailed: DataFrame) -> DataFrame:
    """Lorenz-style curve, vendors by revenue descending:
    (seller_id, Total, position, cum_vendor_share, cum_revenue_share)."""
    r = _ranked(detailed, "seller_id")
    return r.select(
        "seller_id", "Total", "position",
        safe_ratio(F.col("position"), F.col("n_rows")).alias("cum_vendor_share"),
        _money_ratio("running_value", "total_value").alias("cum_revenue_share"))


def vendor_concentration_summary(detailed: DataFrame, top_percent: int = 10) -> DataFrame:
    """D2 summary: n_vendors, gini, top_share (revenue share of the first
    ``ceil(top_percent * n / 100)`` vendors).

    Gini over ascending order i = n + 1 - position:
    ``G = 2 Σ i·x / (n Σ x) - (n + 1) / n``, rounded to 10 decimals.
    """
    r = _ranked(detailed, "seller_id")
    weight = (F.col("n_rows") + 1 - F.col("position")).cast("double")
    top_k = F.ceil(F.col("n_rows") * F.lit(int(top_percent)) / F.lit(100))
    agg = r.agg(
        F.count(F.lit(1)).alias("n_vendors"),
        F.sum(weight * F.col("_exact").cast("double")).alias("_weighted"),
        F.sum("_exact").alias("_total"),
        F.sum(F.when(F.col("position") <= top_k, F.col("_exact"))).alias("_top"))
    n = F.col("n_vendors").cast("double")
    total = F.col("_total").cast("double")
    gini = F.when((F.col("n_vendors") > 0) & (F.col("_total") != 0),
                  F.round(F.lit(2.0) * F.col("_weighted") / (n * total) - (n + F.lit(1.0)) / n, 10))
    top = F.coalesce(F.col("_top"), F.lit(0)).cast("double")
    return agg.select("n_vendors", gini.alias("gini"), safe_ratio(top, total).alias("top_share"))


def category_share_rank(detailed: DataFrame) -> DataFrame:
    """(product_category_name, Total, share, rank, cum_share)."""
    r = _ranked(detailed, "product_category_name")
    return r.select("product_category_name", "Total",
                    _money_ratio("_exact", "total_value").alias("share"),
                    F.col("position").alias("rank"),
                    _money_ratio("running_value", "total_value").alias("cum_share"))


def state_order_share(orders: DataFrame) -> DataFrame:
    """D2 regional: distinct orders per state and their share of all orders
    counted per state."""
    per_state = (orders.filter(F.col("customer_state").isNotNull()).groupBy("customer_state")
                 .agg(F.count_distinct("order_id").alias("orders")))
    r = ranked_by(per_state, "orders", "customer_state")
    return r.select(F.col("customer_state").alias("state"), "orders", F.col("position").alias("rank"),
                    safe_ratio(F.col("orders"), F.col("total_value")).alias("share"))


def price_freight_correlation(volume: DataFrame, digits: int = 10) -> DataFrame:
    """D3: Pearson r of price and freight over the dimension-complete rows
    (pairs with a null dropped), rounded to ``digits`` decimals."""
    pairs = volume.select("price", "freight_value").na.drop()
    return pairs.agg(F.count(F.lit(1)).alias("n"),
                     F.round(F.corr("price", "freight_value"), digits).alias("pearson_r"))


def freight_efficiency(volume: DataFrame) -> DataFrame:
    """D4 per category over dimension-complete rows: freight per kg, per
    litre (1000 cm³) and per unit of price (null when the divisor is 0)."""
    rows = volume.filter(F.col("freight_value").isNotNull())
    agg = rows.groupBy("product_category_name").agg(
        F.count(F.lit(1)).alias("items"),
        F.sum(exact("freight_value")).alias("_freight"),
        F.sum(exact("product_weight_g")).alias("_grams"),
        F.sum(exact("Volume_cm")).alias("_cm3"),
        F.sum(exact("price")).alias("_price"))
    freight = F.col("_freight").cast("double")
    return agg.select(
        "product_category_name", "items", freight.alias("freight"),
        safe_ratio(freight * F.lit(1000.0), F.col("_grams").cast("double")).alias("freight_per_kg"),
        safe_ratio(freight * F.lit(1000.0), F.col("_cm3").cast("double")).alias("freight_per_litre"),
        safe_ratio(freight, F.col("_price").cast("double")).alias("freight_to_price"))


def stage_durations(order_items: DataFrame, orders: DataFrame,
                    start_col: str = "order_purchase_timestamp",
                    end_col: str = "shipping_limit_date") -> DataFrame:
    """Per order item: whole days from purchase to the shipping limit.
    Joins items to orders on order_id (both large: a shuffle join on the key;
    null ids never match)."""
    items = order_items.filter(F.col("order_id").isNotNull()).select("order_id", end_col)
    heads = orders.filter(F.col("order_id").isNotNull()).select("order_id", start_col)
    return (items.join(heads, "order_id")
            .select("order_id", F.datediff(F.to_date(end_col), F.to_date(start_col)).cast("long")
                    .alias("duration_days"))
            .filter(F.col("duration_days").isNotNull()))


def duration_distribution(durations: DataFrame) -> DataFrame:
    """(duration_days, items, cum_share) — exact histogram (one row per
    distinct whole-day duration, so the ordered window runs over a handful
    of rows, never over items)."""
    hist = durations.groupBy("duration_days").agg(F.count(F.lit(1)).alias("items"))
    upto = Window.orderBy("duration_days").rowsBetween(Window.unboundedPreceding, 0)
    return hist.select("duration_days", "items",
                       safe_ratio(F.sum("items").over(upto), F.sum("items").over(Window.partitionBy()))
                       .alias("cum_share"))


def duration_summary(durations: DataFrame, quantiles: Sequence[float] = (0.5, 0.9, 0.99)) -> DataFrame:
    """N, mean_days and nearest-rank quantiles (smallest duration whose
    cumulative count reaches ceil(q·n)), read from the exact histogram."""
    hist = durations.groupBy("duration_days").agg(F.count(F.lit(1)).alias("items"))
    upto = Window.orderBy("duration_days").rowsBetween(Window.unboundedPreceding, 0)
    cum = hist.select("duration_days", "items", F.sum("items").over(upto).alias("cum"),
                      F.sum("items").over(Window.partitionBy()).alias("n"))
    cols = [F.max("n").alias("n"),
            safe_ratio(F.sum(F.col("duration_days") * F.col("items")), F.max("n")).alias("mean_days")]
    for q in quantiles:
        need = F.ceil(F.col("n") * F.lit(q))
        cols.append(F.min(F.when(F.col("cum") >= need, F.col("duration_days"))).alias(f"p{round(q * 100):d}_days"))
    return cum.agg(*cols)


def delay_severity(delayed: DataFrame, delay_day_ranges: Sequence[tuple] | None = None) -> DataFrame:
    """Late orders per severity class (delay bin label; null = outside
    every class), most severe first."""
    ranges = list(delay_day_ranges or DEFAULT_DELAY_RANGES)
    edges, labels = edges_from_ranges(ranges), range_labels(ranges)
    binned = with_delay_days(delayed).select(right_closed_bin(F.col("delay_days"), edges).alias("d_idx"))
    return (binned.groupBy("d_idx").agg(F.count(F.lit(1)).alias("orders"))
            .orderBy(F.asc_nulls_last("d_idx"))
            .select(label_of(F.col("d_idx"), labels).alias("delay_bin"), "orders"))


def success_rates(orders: DataFrame, by: str = "state") -> DataFrame:
    """Per state (``by='state'``) or purchase month (``by='month'``):
    rows with a delay, delivered, on-time delivered, delivery_rate and
    on_time_rate (percent, 0 when the denominator is 0)."""
    if by == "state":
        key = F.col("customer_state").alias("state")
    elif by == "month":
        key = F.date_format(F.col("order_purchase_timestamp"), "yyyy-MM").alias("month")
    else:
        raise ValueError("by must be 'state' or 'month'")
    rows = orders.filter(F.col("delay_ns").isNotNull()).select(key, "Net_State", "delay_ns")
    name = rows.columns[0]
    delivered = F.col("Net_State") == DELIVERED
    agg = rows.filter(F.col(name).isNotNull()).groupBy(name).agg(
        F.count(F.lit(1)).alias("orders"),
        F.count_if(delivered).alias("delivered"),
        F.count_if(F.col("Net_State") == NOT_DELIVERED).alias("not_delivered"),
        F.count_if(delivered & (F.col("delay_ns") > 0)).alias("on_time_delivered"))
    return agg.select(name, "orders", "delivered", "not_delivered", "on_time_delivered",
                      safe_ratio(F.col("delivered"), F.col("orders"), 100.0, F.lit(0.0)).alias("delivery_rate"),
                      safe_ratio(F.col("on_time_delivered"), F.col("delivered"), 100.0, F.lit(0.0))
                      .alias("on_time_rate")).orderBy(name)
