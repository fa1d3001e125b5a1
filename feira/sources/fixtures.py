"""The three analysis inputs, derived from the base tables.

The analyses expect marketplace tables (order items, products, cleaned
orders). They are derived here from the star-schema tables with plain column
expressions, so they scale with the base tables. The derivation deliberately
plants the edge cases the analyses must handle: null keys, unmatched
products, null dimensions, null or zero delays, delays on exact bin edges and
percentages outside 0-100. The same derivation is written as SQL in
``feira.plans.oracle`` for the independent DuckDB check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feira.functions.delay import format_seconds_as_text
from feira.sources.tables import read_table

# Nation key -> two-letter customer state (nation keys 0-23;
# any other key becomes 'XX', a state without coordinates).
NATION_STATE = [
    "SP", "RJ", "MG", "RS", "PR", "SC", "BA", "DF", "ES", "GO", "PE", "CE",
    "PA", "MT", "MA", "MS", "PB", "PI", "RN", "AL", "SE", "TO", "RO", "AM",
]


def _null_when(cond: Column, value: Column) -> Column:
    return F.when(cond, F.lit(None)).otherwise(value)


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    freight = (F.col("l_extendedprice").cast("decimal(12,2)")
               * F.col("l_tax").cast("decimal(4,2)")).cast("double")
    return li.select(
        _null_when(F.col("l_orderkey") % 211 == 0, F.col("l_orderkey")).alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        # ids below zero are in no catalogue: the left join's unmatched side
        _null_when(F.col("l_partkey") % 173 == 0,
                   F.when(F.col("l_partkey") % 50 == 7, -F.col("l_partkey")).otherwise(F.col("l_partkey"))).alias("product_id"),
        _null_when(F.col("l_suppkey") % 61 == 0, F.col("l_suppkey")).alias("seller_id"),
        F.col("l_extendedprice").alias("price"),
        _null_when(F.col("l_linenumber") == 7, freight).alias("freight_value"),
        F.col("l_shipdate").alias("shipping_limit_date"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return part.select(
        k.alias("product_id"),
        _null_when(k % 20 == 3, F.col("p_brand")).alias("product_category_name"),
        _null_when(k % 37 == 0, (F.col("p_size") * 250).cast("double")).alias("product_weight_g"),
        _null_when(k % 41 == 0, (10 + k % 23).cast("double")).alias("product_length_cm"),
        (5 + k % 17).cast("double").alias("product_height_cm"),
        _null_when(k % 43 == 0, (8 + k % 19).cast("double")).alias("product_width_cm"),
    )


def products_with_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``products`` and more rows: every 29th product has a second row of
    another category and no weight, and two rows have no product id."""
    base = products(spark, sf_dir)
    k = F.col("product_id")
    second = base.filter(k % 29 == 0).withColumns({
        "product_category_name": F.lit("Second"), "product_weight_g": F.lit(None).cast("double")})
    no_id = base.filter(k <= 2).withColumns({
        "product_id": F.lit(None).cast("long"),
        "product_category_name": F.concat(F.lit("No id "), k.cast("string"))})
    return base.unionByName(second).unionByName(no_id)


def seller_orders(spark: SparkSession, sf_dir: str, state: bool = True, repeats: bool = False) -> DataFrame:
    """Cleaned orders with ``delay_seconds`` (negative = late); without
    ``state`` there is no ``customer_state`` and no join. With ``repeats``
    every 53rd order has a second row, one half of them a day later."""
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    if repeats:
        again = orders.filter(F.col("o_orderkey") % 53 == 0).withColumn("o_orderdate", F.when(
            F.col("o_orderkey") % 106 == 0, F.col("o_orderdate")).otherwise(F.col("o_orderdate") + F.expr("INTERVAL '1' DAY")))
        orders = orders.unionByName(again)
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    code = F.try_element_at(F.array(*[F.lit(s) for s in NATION_STATE]), F.col("c_nationkey") + 1)
    in_range = (F.col("c_nationkey") >= 0) & (F.col("c_nationkey") < len(NATION_STATE))
    k = F.col("o_orderkey")
    net_state = (F.when(F.col("o_orderstatus") == "O", "Not_Delivered")
                 .when((F.col("o_orderstatus") == "P") & (k % 10 == 0), F.lit(None))
                 .otherwise("Delivered"))
    delay = (F.when(k % 97 == 0, F.lit(None))
             .when(k % 89 == 0, F.lit(0).cast("long"))
             .when(k % 83 == 0, (k % 7) * (-432000))
             .otherwise((k * 7919) % 6048000 - 3024000))
    pct = F.when(k % 101 == 0, F.lit(None)).otherwise(((k * 31) % 1101 - 50).cast("double") / 10.0)
    # customer is a dimension of orders (|customer| = |orders| / 10); Spark
    # broadcasts it below the broadcast threshold and sort-merges above it.
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey, "left") if state else orders
    return joined.select(
        k.alias("order_id"),
        *([F.when(in_range, code).otherwise("XX").alias("customer_state")] if state else []),
        net_state.alias("Net_State"),
        delay.alias("delay_seconds"),
        pct.alias("Site_Real_PCT"),
        F.col("o_totalprice").alias("TOTAL"),
        F.col("o_orderdate").alias("order_purchase_timestamp"),
    )


def order_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the times of four events (``purchased_at``, ``approved_at``,
    ``carrier_at``, ``delivered_at``; some missing, some out of order),
    ``delay_seconds`` and one percentage per stage (``*_PCT``)."""
    orders = seller_orders(spark, sf_dir, state=False)
    k = F.col("order_id")
    later = lambda start, seconds: start + seconds * F.expr("INTERVAL '1' SECOND")
    bought = F.col("order_purchase_timestamp")
    approved = later(bought, (k * 7919) % 200003 + 17)
    carrier = later(bought, (k * 104729) % 900001 - 5000)
    delivered = later(bought, (k * 15485863) % 4000037 + 86400)
    return orders.select(
        "order_id", "Net_State", "delay_seconds", "Site_Real_PCT",
        _null_when(k % 103 == 0, ((k * 17) % 1301 - 100).cast("double") / 10.0).alias("Carrier_Real_PCT"),
        (((k * 43) % 1001).cast("double") / 10.0).alias("Client_Real_PCT"),
        bought.alias("purchased_at"),
        _null_when(k % 71 == 0, approved).alias("approved_at"),
        _null_when(k % 67 == 0, carrier).alias("carrier_at"),
        _null_when(F.col("Net_State").isNull() | (F.col("Net_State") == "Not_Delivered"), delivered).alias("delivered_at"))


def delay_in_many_forms(order_id: Column, seconds: Column) -> Column:
    """The same delay as eleven kinds of text, by order id; two of them are no durations."""
    a = F.abs(seconds)
    sign = F.when(seconds < 0, "-").otherwise("")
    plus = F.when(seconds < 0, "- ").otherwise("+")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    whole = lambda x, n: F.floor(x / n)
    day, hour, minute, second = whole(a, 86400), whole(a % 86400, 3600), whole(a % 3600, 60), a % 60
    rest = F.pmod(seconds, F.lit(86400))
    forms = [
        format_seconds_as_text(seconds),
        text(sign, whole(a, 3600), ":", minute, ":", second),
        text(sign, second, "s", minute, "min", hour, "hours", day, "d"),
        text(sign, day, " days, ", hour, " hr ", minute, " minutes ", second, " sec"),
        text(whole(seconds, 86400), "d ", whole(rest, 3600), ":", whole(rest % 3600, 60), ":", rest % 60),
        text(sign, "P", day, "DT", hour, "H", minute, "M", second, "S"),
        text(seconds * 1_000_000_000),
        text(plus, a, ".0000000004s"),
        text(a, " secs"),
        F.lit("None"),
        text(sign, a * 1000, " L"),
    ]
    out = F.when(seconds.isNull(), F.lit(None).cast("string"))
    for i, form in enumerate(forms):
        out = out.when(order_id % len(forms) == i, form)
    return out


def orders_with_delay(spark: SparkSession, sf_dir: str, delay_format: str = "interval",
                      state: bool = True) -> DataFrame:
    """``seller_orders`` with a ``Delay`` column as the analyses receive it.

    ``interval``: a day-time interval (pandas ``timedelta64``);
    ``text``: pandas' text form such as ``-8 days +07:32:10``;
    ``forms``: many kinds of text.
    """
    so = seller_orders(spark, sf_dir, state)
    if delay_format == "interval":
        delay = F.col("delay_seconds") * F.expr("INTERVAL '1' SECOND")
    elif delay_format == "text":
        delay = format_seconds_as_text(F.col("delay_seconds"))
    elif delay_format == "forms":
        delay = delay_in_many_forms(F.col("order_id"), F.col("delay_seconds"))
    else:
        raise ValueError(f"unknown delay_format {delay_format!r}")
    return so.withColumn("Delay", delay).drop("delay_seconds")


def register_views(spark: SparkSession, sf_dir: str) -> None:
    order_items(spark, sf_dir).createOrReplaceTempView("order_items")
    products(spark, sf_dir).createOrReplaceTempView("products")
    seller_orders(spark, sf_dir).createOrReplaceTempView("seller_orders")
