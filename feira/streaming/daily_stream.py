"""Daily distinct orders (A16) maintained over a stream of orders.

Event-time version of ``feira.operators.trend.daily_orders``: a watermark
bounds how late an order may arrive, (order, day) pairs are de-duplicated
within that watermark (state is evicted once it passes, so it does not grow
with the stream; a repeat further apart than the lateness counts again), and
orders are counted per one-day event-time window. The rolling
mean (W1) stays a batch step over the emitted daily rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def daily_orders_stream(orders: DataFrame, date_col: str = "order_purchase_timestamp",
                        lateness: str = "2 days") -> DataFrame:
    """(date, orders) over a streaming frame of orders. Orders later than
    ``lateness`` behind the latest event time seen are dropped."""
    events = (orders.select("order_id", F.col(date_col).cast("timestamp").alias("event_time"),
                            F.to_date(date_col).alias("day"))
              .filter(F.col("event_time").isNotNull() & F.col("order_id").isNotNull()))
    deduped = events.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark(["order_id", "day"])
    return (deduped.groupBy(F.window("event_time", "1 day").alias("w"))
            .agg(F.count(F.lit(1)).alias("orders"))
            .select(F.to_date(F.col("w.start")).alias("date"), "orders"))


def start_daily_orders(orders: DataFrame, checkpoint: str, sink_path: str, query_name: str = "daily_orders",
                       available_now: bool = False, processing_time: str = "10 minutes") -> StreamingQuery:
    """Run ``daily_orders_stream`` in ``update`` mode: each micro-batch holds
    the days whose count changed, appended to ``sink_path`` (parquet) with its
    batch id; ``latest_daily_orders`` reads the current count per day. A
    micro-batch replayed after a failure rewrites identical rows, so the
    reader's answer does not change. ``checkpoint`` must be a shared, reliable
    folder holding offsets, watermark and state."""

    def write_batch(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("batch_id", F.lit(epoch).cast("long")).write.mode("append").parquet(sink_path)

    writer = (daily_orders_stream(orders).writeStream.outputMode("update")
              .option("checkpointLocation", checkpoint).queryName(query_name).foreachBatch(write_batch))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time)
    return writer.start()


def latest_daily_orders(spark, sink_path: str) -> DataFrame:
    """Current (date, orders): the value from the latest batch for each day."""
    return (spark.read.parquet(sink_path).groupBy("date")
            .agg(F.max_by("orders", "batch_id").alias("orders")))
