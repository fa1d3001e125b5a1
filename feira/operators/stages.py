"""Order stages: durations with exact quantiles (D5), heat maps of all stages
in one pass (D7), delay ranges that come as a table (B3), success rates on
several levels at once (D8)."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feira.functions.bins import (DEFAULT_DELAY_RANGES, PCT_EDGES, edges_from_ranges, label_of, pct_labels, range_labels,
                                  right_closed_bin)
from feira.functions.numeric import safe_ratio
from feira.operators.delivery import DELIVERED, NOT_DELIVERED
from feira.operators.heatmap import N_PCT, with_delay_days

#: Buckets per doubling of the duration histogram, as a power of two.
BITS = 6


def stage_seconds(orders: DataFrame, stages: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(stage, seconds), one row per order and stage that has both times;
    ``stages``: (name, start column, end column). One scan for all stages."""
    if not stages:
        raise ValueError("at least one stage is required")
    each = [F.struct(F.lit(name).alias("stage"), F.timestamp_diff("SECOND", F.col(start), F.col(end)).cast("long").alias("seconds"))
            for name, start, end in stages]
    return orders.select(F.inline(F.array(*each))).filter(F.col("seconds").isNotNull())


def duration_bucket(seconds: Column) -> Column:
    """A whole number that never decreases with the duration: exact below
    2^BITS, then 2^BITS buckets per doubling. All longs fall in fewer than
    2^(BITS + 7) buckets."""
    a = F.abs(seconds)
    octave = F.length(F.bin(a)) - 1 - BITS
    above = octave.cast("long") * (1 << BITS) + F.call_function("shiftright", a, octave)
    bucket = F.when(a < (1 << BITS), a).otherwise(above)
    return F.when(seconds < 0, -bucket).otherwise(bucket)


def stage_quantiles(durations: DataFrame, quantiles: Sequence[float] = (0.5, 0.9, 0.99)) -> DataFrame:
    """(stage, n, mean_seconds, p50_seconds, ...) of (stage, seconds): exact
    nearest-rank quantiles (the smallest duration whose cumulative count
    reaches ceil(q * n)).

    First pass: a histogram per stage, of a size that does not depend on the
    data, which partial aggregates merge. It names the bucket that holds each
    quantile. Second pass: only durations in those buckets (stages x quantiles
    of them) are counted one by one, so no rows are sorted.
    """
    place = durations.withColumn("bucket", duration_bucket(F.col("seconds")))
    hist = place.groupBy("stage", "bucket").agg(F.count(F.lit(1)).alias("items"),
                                                F.sum(F.col("seconds").cast("decimal(38,0)")).alias("total"))
    upto = Window.partitionBy("stage").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("stage")
    cum = hist.select("stage", "bucket", "items", F.sum("items").over(upto).alias("cum"),
                      F.sum("items").over(whole).alias("n"), F.sum("total").over(whole).alias("total"))
    wanted = [F.struct(F.lit(i).alias("q"), F.ceil(F.col("n") * F.lit(Decimal(str(q)))).alias("rank"))
              for i, q in enumerate(quantiles)]
    found = (cum.select("stage", "bucket", "items", "cum", "n", "total", F.inline(F.array(*wanted)))
             .filter((F.col("cum") >= F.col("rank")) & (F.col("cum") - F.col("items") < F.col("rank")))
             .select("stage", "bucket", "n", "total", "q", "rank", (F.col("cum") - F.col("items")).alias("before")))
    inside = (place.join(F.broadcast(found), ["stage", "bucket"])  # stages x quantiles rows
              .groupBy("stage", "n", "total", "q", "rank", "before", "seconds").agg(F.count(F.lit(1)).alias("items")))
    run = Window.partitionBy("stage", "q").orderBy("seconds").rowsBetween(Window.unboundedPreceding, 0)
    reached = inside.withColumn("cum", F.col("before") + F.sum("items").over(run)).filter("cum >= rank")
    return (reached.groupBy("stage")
            .agg(F.max("n").alias("n"), safe_ratio(F.max("total"), F.max("n")).alias("mean_seconds"),
                 *[F.min(F.when(F.col("q") == i, F.col("seconds"))).alias(f"p{round(q * 100):d}_seconds")
                   for i, q in enumerate(quantiles)])
            .orderBy("stage"))


def stage_heatmaps(delayed: DataFrame, delay_day_ranges: Sequence[tuple] | None = None) -> DataFrame:
    """(stage, delay_bin, pct_bin, orders), the dense heat map of every
    ``*_PCT`` column. Stages become rows inside the scan, so there is one scan
    and one aggregate of at most (bins + 1) rows per stage and task."""
    stages = [c for c in delayed.columns if c.endswith("_PCT")]
    if not stages:
        raise ValueError("no *_PCT stage columns")
    ranges = list(delay_day_ranges or DEFAULT_DELAY_RANGES)
    edges, labels, p_labels = edges_from_ranges(ranges), range_labels(ranges), pct_labels()
    rows = with_delay_days(delayed).select(
        right_closed_bin(F.col("delay_days"), edges).alias("d_idx"),
        F.inline(F.array(*[F.struct(F.lit(c).alias("stage"), right_closed_bin(F.col(c), PCT_EDGES).alias("p_idx"))
                           for c in stages])))
    skeleton = delayed.sparkSession.range(len(ranges) * len(stages)).select(
        (F.col("id") % len(ranges)).cast("int").alias("d_idx"),
        F.element_at(F.array(*[F.lit(c) for c in stages]), (F.floor(F.col("id") / len(ranges)) + 1).cast("int")).alias("stage"),
        F.lit(None).cast("int").alias("p_idx"))
    grid = rows.unionByName(skeleton).groupBy("stage", "d_idx").agg(
        *[F.count_if(F.col("p_idx") == i).alias(p_labels[i]) for i in range(N_PCT)])
    return (grid.orderBy("stage", F.desc_nulls_last("d_idx"))
            .select("stage", label_of(F.col("d_idx"), labels).alias("delay_bin"), *[F.col(f"`{c}`") for c in p_labels])
            .unpivot(["stage", "delay_bin"], p_labels, "pct_bin", "orders"))


def range_sets(ranges: DataFrame) -> DataFrame:
    """(range_set, edges, labels) of a table of ranges (range_set, low, high),
    each set ordered by its ends: the edges are the first start and every end.
    A set whose ends do not increase from its first start, or with a repeated
    label, is an error."""
    number = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    text = F.concat(number(F.col("low")), F.lit("\u2013"), number(F.col("high")))
    one = ranges.groupBy("range_set").agg(F.sort_array(F.collect_list(F.struct("high", "low", text.alias("label")))).alias("r"))
    edges = F.concat(F.array(F.col("r")[0]["low"]), F.col("r.high"))
    rising = F.forall(F.zip_with(F.slice(edges, 1, F.size(edges) - 1), F.slice(edges, 2, F.size(edges) - 1), lambda a, b: a < b),
                      lambda ok: ok)
    good = rising & (F.size(F.array_distinct(F.col("r.label"))) == F.size("r"))
    checked = F.when(good, edges).otherwise(F.raise_error(F.concat(
        F.lit("ranges of a set must end later and later, with different labels: "), F.col("range_set"))).cast("array<double>"))
    return one.select("range_set", checked.alias("edges"), F.col("r.label").alias("labels"))


def delay_bins_by_set(delayed: DataFrame, ranges: DataFrame, set_col: str) -> DataFrame:
    """B3 with ranges as data: (range_set, delay_bin, orders), late orders per
    bin of the range set that their ``set_col`` names; every bin appears, and
    a null bin counts the delays outside a set's range.

    The sets are joined, one row each, so any number of tenants runs in one
    pass; the place in the sorted edges is right-closed, the first edge
    included. Rows whose set is not in the table drop out.
    """
    sets = range_sets(ranges)
    d = F.col("delay_days")
    below = F.size(F.filter("edges", lambda e: e < d))
    inside = (d >= F.col("edges")[0]) & (d <= F.element_at("edges", -1))
    rows = with_delay_days(delayed).select(F.col(set_col).alias("range_set"), "delay_days").join(sets, "range_set")
    placed = rows.select("range_set", F.when(inside, F.greatest(below, F.lit(1))).alias("place"), F.lit(1).alias("one"))
    skeleton = sets.select("range_set", F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("place"), F.lit(0).alias("one"))
    counted = placed.unionByName(skeleton).groupBy("range_set", "place").agg(F.sum("one").alias("orders"))
    return (counted.join(sets, "range_set").orderBy("range_set", F.desc_nulls_last("place"))
            .select("range_set", F.try_element_at("labels", "place").alias("delay_bin"), "orders"))


def success_rate_levels(orders: DataFrame) -> DataFrame:
    """D8 on four levels in one pass: (level, state, month, orders,
    delivered, not_delivered, on_time_delivered, delivery_rate, on_time_rate)
    with level ``all``, ``state``, ``month`` or ``state_month``. A null state
    or month of the data is a group of its own; the level tells it from a total."""
    rows = orders.filter(F.col("delay_ns").isNotNull()).select(
        F.col("customer_state").alias("state"), F.date_format("order_purchase_timestamp", "yyyy-MM").alias("month"),
        "Net_State", "delay_ns")
    delivered = F.col("Net_State") == DELIVERED
    sets = [[F.col("state"), F.col("month")], [F.col("state")], [F.col("month")], []]
    level = (F.when(F.grouping("state") + F.grouping("month") == 0, "state_month")
             .when(F.grouping("state") == 0, "state").when(F.grouping("month") == 0, "month").otherwise("all"))
    agg = rows.groupingSets(sets, F.col("state"), F.col("month")).agg(
        level.alias("level"), F.count(F.lit(1)).alias("orders"), F.count_if(delivered).alias("delivered"),
        F.count_if(F.col("Net_State") == NOT_DELIVERED).alias("not_delivered"),
        F.count_if(delivered & (F.col("delay_ns") > 0)).alias("on_time_delivered"))
    return agg.select(
        "level", "state", "month", "orders", "delivered", "not_delivered", "on_time_delivered",
        safe_ratio(F.col("delivered"), F.col("orders"), 100.0, F.lit(0.0)).alias("delivery_rate"),
        safe_ratio(F.col("on_time_delivered"), F.col("delivered"), 100.0, F.lit(0.0)).alias("on_time_rate"))
