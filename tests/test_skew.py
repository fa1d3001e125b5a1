"""J1 above the broadcast bound: a hot product_id (a third of the rows) and
a null-key group are split by AQE's skew join, and the result stays exact."""

from pyspark.sql import functions as F

from feira.operators import revenue as R

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


def test_hot_key_is_split_and_exact(spark):
    saved = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    try:
        for k, v in SKEW_CONF.items():
            spark.conf.set(k, v)
        n = 30000
        ids = F.col("id")
        items = spark.range(n).repartition(8).select(
            ids.cast("string").alias("order_id"),
            F.when(ids % 3 == 0, F.lit(7)).when(ids % 101 == 0, F.lit(None)).otherwise(ids % 500)
            .cast("long").alias("product_id"),
            (ids % 13).cast("string").alias("seller_id"),
            # varying prices: identical rows would compress to nothing in the shuffle
            ((ids * 7919) % 100003 / 100.0).alias("price"), F.lit(0.5).alias("freight_value"))
        products = spark.range(500).select(
            F.col("id").alias("product_id"), F.concat(F.lit("c"), (F.col("id") % 5).cast("string"))
            .alias("product_category_name"),
            *[F.lit(1.0).alias(c) for c in R.DIMENSION_COLUMNS])
        detailed = R.prepare_data(items, products.hint("merge"))  # force the shuffle join
        out = R.category_revenue(detailed, "price")
        rows = {r.product_category_name: r.Total for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "skew=true" in plan
        price = lambda i: (i * 7919) % 100003 / 100.0
        assert abs(sum(rows.values()) - sum(price(i) for i in range(n))) < 1e-6  # every item once
        hot = sum(price(i) for i in range(n) if i % 3 == 0)
        assert rows["c2"] >= hot - 1e-6                      # the hot product 7 -> category c2
        assert abs(rows["Others"] - sum(price(i) for i in range(n) if i % 3 != 0 and i % 101 == 0)) < 1e-6
    finally:
        for k, v in saved.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
