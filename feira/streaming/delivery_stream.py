"""Delivery KPIs maintained over a stream of cleaned-order files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from feira.functions.delay import normalize_delay
from feira.operators.delivery import delivery_performance

ORDERS_STREAM_SCHEMA = T.StructType([
    T.StructField("order_id", T.LongType()),
    T.StructField("customer_state", T.StringType()),
    T.StructField("Net_State", T.StringType()),
    T.StructField("Delay", T.StringType()),
    T.StructField("Site_Real_PCT", T.DoubleType()),
    T.StructField("TOTAL", T.DoubleType()),
    T.StructField("order_purchase_timestamp", T.TimestampNTZType()),
])


def orders_stream(spark: SparkSession, path: str, schema: T.StructType = ORDERS_STREAM_SCHEMA,
                  max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def delivery_kpis_stream(orders: DataFrame, on_error: str = "null") -> DataFrame:
    """Streaming form of ``delivery_performance``: a global aggregate whose
    state is a handful of counters, so it is updated in ``complete`` mode.
    Malformed delays become null by default, so one bad record cannot stop
    the stream."""
    return delivery_performance(normalize_delay(orders, on_error=on_error))


def start_delivery_kpis(spark: SparkSession, source: str, checkpoint: str, sink_table: str | None = None,
                        query_name: str = "delivery_kpis", available_now: bool = False,
                        processing_time: str = "1 hour") -> StreamingQuery:
    """Start the refresh. ``checkpoint`` must be a shared, reliable folder;
    it holds the offsets and aggregate state so a restarted or failed-over
    query resumes exactly where it stopped. Results go to ``sink_table`` via
    ``foreachBatch`` (overwritten each trigger) or to an in-memory table
    named ``query_name`` when no table is given."""
    kpis = delivery_kpis_stream(orders_stream(spark, source))
    writer = kpis.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).queryName(query_name)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time)
    if sink_table is None:
        return writer.format("memory").start()

    def write_batch(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").saveAsTable(sink_table)

    return writer.foreachBatch(write_batch).start()
