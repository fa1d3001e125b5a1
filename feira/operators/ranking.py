"""Exact global positions and running sums without a one-partition window.

``Window.orderBy(...)`` with no partition key moves every row into one task.
For entity-level results that can be large (one row per vendor), positions
and running sums come from a histogram with fixed split points instead:

1. a row's bucket is a monotone function of its value (STEPS buckets per
   doubling, so at most a few hundred thousand whatever the data), and rows of
   one value that is known to fill its bucket alone (0, or a small whole
   number) are split further by the first letters or the size of the key;
2. counts and sums per bucket, and their prefix sums, give every bucket its
   offset; the un-keyed window runs over buckets, never over rows;
3. inside a bucket one window keyed by the bucket numbers the rows.

Everything is one lazy plan: no job runs while it is built, nothing has to be
frozen, and a lost task is recomputed to the same rows. The per-key aggregate
that feeds both sides is shuffled once (the exchange is reused).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feira.session import ensure_checkpoint_dir

STEPS = 1024
_SHIFT = 1 << 21  # more than STEPS * 1100, so every step of a double is positive


def value_bucket(value: Column) -> Column:
    """A whole number that never increases with the value (larger values first)."""
    d = value.cast("double")
    step = F.floor(F.log2(F.abs(d)) * STEPS).cast("long") + _SHIFT
    return F.when(d > 0, -step).when(d < 0, step).otherwise(F.lit(0).cast("long"))


def _key_part(key: Column, dtype: T.DataType) -> Column:
    """A whole number that never decreases with the key."""
    if isinstance(dtype, T.StringType):
        return F.ascii(key).cast("long")
    if isinstance(dtype, T.NumericType):
        size = F.floor(F.log2(F.abs(key.cast("double")) + 1) * 16).cast("long")
        return F.when(key < 0, -size).otherwise(size)
    return F.lit(0).cast("long")


def ranked_by(df: DataFrame, value: str, key: str) -> DataFrame:
    """Add ``position`` (1-based, by ``value`` descending, then ``key``
    ascending), ``n_rows``, ``running_value`` (sum of ``value`` up to and
    including the row) and ``total_value``. ``key`` is unique and not null."""
    v = F.col(value)
    alone = v == 0
    if isinstance(df.schema[value].dataType, T.IntegralType):
        alone = alone | (F.abs(v) <= STEPS)
    placed = df.withColumns({
        "_bucket": value_bucket(v),
        "_part": F.when(alone, _key_part(F.col(key), df.schema[key].dataType)).otherwise(F.lit(0).cast("long"))})
    buckets = placed.groupBy("_bucket", "_part").agg(F.count(F.lit(1)).alias("_rows"), F.sum(value).alias("_sum"))
    before = Window.orderBy("_bucket", "_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    offsets = buckets.select(
        "_bucket", "_part",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_row_offset"),
        F.sum("_rows").over(everything).alias("n_rows"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_sum_offset"),
        F.sum("_sum").over(everything).alias("total_value"))
    within = Window.partitionBy("_bucket", "_part").orderBy(F.desc(value), F.asc(key))
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    return (placed.join(offsets, ["_bucket", "_part"])
            .withColumn("position", F.col("_row_offset") + F.row_number().over(within))
            .withColumn("running_value", F.col("_sum_offset") + F.sum(value).over(upto))
            .drop("_bucket", "_part", "_row_offset", "_sum_offset"))


def with_global_position(df: DataFrame, order: list[Column], value: str | None = None) -> DataFrame:
    """Add ``position`` (1-based, in ``order``), ``n_rows`` and, when
    ``value`` is given, ``running_value`` (Σ value up to and including the
    row) and ``total_value``. ``order`` must be a total order (end it with a
    unique key) for positions to be deterministic.

    For any order; it sorts once, freezes the sorted rows with an eager
    checkpoint and numbers them by partition. ``ranked_by`` needs neither and
    is what the rankings by a value use."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    ordered = (df.orderBy(*order)
               .withColumn("_pid", F.spark_partition_id())
               .withColumn("_mid", F.monotonically_increasing_id())
               .checkpoint(eager=True))
    aggs = [F.count(F.lit(1)).alias("_cnt")]
    if value is not None:
        aggs.append(F.sum(value).alias("_sum"))
    parts = ordered.groupBy("_pid").agg(*aggs)
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    # one row per partition: bounded by the shuffle partition count, so the
    # un-keyed windows and the broadcast below are safe at any data size
    offsets = parts.select(
        "_pid",
        F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_row_offset"),
        F.sum("_cnt").over(everything).alias("n_rows"),
        *([F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_sum_offset"),
           F.sum("_sum").over(everything).alias("total_value")] if value is not None else []))
    # inside a partition the increasing id keeps the sorted order; one window
    # keyed by partition gives both the row number and the running sum
    within = Window.partitionBy("_pid").orderBy("_mid")
    out = (ordered.join(F.broadcast(offsets), "_pid")
           .withColumn("position", F.col("_row_offset") + F.row_number().over(within)))
    if value is not None:
        upto = within.rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("running_value", F.col("_sum_offset") + F.sum(value).over(upto))
    return out.drop("_pid", "_mid", "_row_offset", "_sum_offset")
