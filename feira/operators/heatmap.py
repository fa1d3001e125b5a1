"""Delayed-orders heat map (B1–B4): delay-bin × percentage-bin counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feira.functions.bins import (DEFAULT_DELAY_RANGES, PCT_EDGES, edges_from_ranges, label_of,
                                  pct_labels, range_labels, right_closed_bin)
from feira.functions.delay import delay_days, normalize_delay

N_PCT = len(PCT_EDGES) - 1


def with_delay_days(delayed: DataFrame) -> DataFrame:
    if "delay_days" in delayed.columns:
        return delayed
    if "delay_ns" in delayed.columns:
        return delayed.withColumn("delay_days", delay_days(F.col("delay_ns")))
    if "Delay" in delayed.columns:
        norm = normalize_delay(delayed, on_error="null")
        return norm.withColumn("delay_days", delay_days(F.col("delay_ns")))
    raise ValueError("the frame has none of the columns delay_days, delay_ns and Delay")


def heatmap_grid(delayed: DataFrame, pct_col: str = "Site_Real_PCT",
                 delay_day_ranges: Sequence[tuple] | None = None) -> DataFrame:
    """B4, wide: one row per delay bin (descending), a trailing null-bin row
    when some delay falls outside every bin, and one count column per
    percentage bin (``0–10 %`` … ``90–100 %``), zero filled.

    Plan: per-row bin indexes → one conditional count per percentage bin,
    grouped by delay bin (partial aggregation, so one shuffle of ≤ 6 rows per
    task), plus a zero skeleton row per delay bin so every bin appears.
    """
    ranges = list(delay_day_ranges or DEFAULT_DELAY_RANGES)
    edges, labels, p_labels = edges_from_ranges(ranges), range_labels(ranges), pct_labels()
    rows = with_delay_days(delayed).select(
        right_closed_bin(F.col("delay_days"), edges).alias("d_idx"),
        right_closed_bin(F.col(pct_col), PCT_EDGES).alias("p_idx"))
    skeleton = delayed.sparkSession.range(len(ranges)).select(
        F.col("id").cast("int").alias("d_idx"), F.lit(None).cast("int").alias("p_idx"))
    grid = rows.unionByName(skeleton).groupBy("d_idx").agg(
        *[F.count_if(F.col("p_idx") == i).alias(p_labels[i]) for i in range(N_PCT)])
    return (grid.orderBy(F.desc_nulls_last("d_idx"))
            .select(label_of(F.col("d_idx"), labels).alias("delay_bin"), *[F.col(f"`{c}`") for c in p_labels]))


def heatmap_long(delayed: DataFrame, pct_col: str = "Site_Real_PCT",
                 delay_day_ranges: Sequence[tuple] | None = None) -> DataFrame:
    """B4, long form of the same dense grid: (delay_bin, pct_bin, orders)."""
    grid = heatmap_grid(delayed, pct_col, delay_day_ranges)
    return grid.unpivot(["delay_bin"], pct_labels(), "pct_bin", "orders")


def heatmap_cell_text(grid: DataFrame) -> DataFrame:
    """P14: '' for zero cells, else the integer, per percentage column."""
    from feira.functions.formatting import cell_text
    return grid.select("delay_bin", *[cell_text(F.col(c)).alias(c) for c in pct_labels()])
