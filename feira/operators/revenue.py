"""Revenue analysis over ``order_items ⟕ products``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feira.functions.numeric import exact, exact_sum, nan_to_null, safe_ratio
from feira.operators.joins import left_join_null_safe
from feira.sources.schemas import ORDER_ITEMS_REQUIRED, PRODUCTS_REQUIRED, require_columns

DIMENSION_COLUMNS = ["product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm"]
METRICS = ("Total", "freight_value", "price")
OTHERS = "Others"


def prepare_data(order_items: DataFrame, products: DataFrame) -> DataFrame:
    """Left join on product_id, missing category -> 'Others',
    ``Total = price + freight_value`` (null if either is null)."""
    require_columns(order_items, ORDER_ITEMS_REQUIRED, "order_items")
    require_columns(products, PRODUCTS_REQUIRED, "products")
    joined = left_join_null_safe(nan_to_null(order_items), nan_to_null(products), "product_id")
    return (joined
            .withColumn("product_category_name", F.coalesce(F.col("product_category_name"), F.lit(OTHERS)))
            .withColumn("Total", F.col("price") + F.col("freight_value")))


def items_as_joined(order_items: DataFrame, products: DataFrame) -> DataFrame:
    """The rows of ``prepare_data`` without its product columns, for totals
    that use none of them.

    An item has as many rows as its product id has in ``products`` (one if it
    has none), so only ids that repeat matter: they are counted first and
    joined, and the join is an empty one where product ids are unique. Items
    are not shuffled by product.
    """
    require_columns(order_items, ORDER_ITEMS_REQUIRED, "order_items")
    require_columns(products, PRODUCTS_REQUIRED, "products")
    repeated = products.groupBy("product_id").agg(F.count(F.lit(1)).alias("_copies")).filter("_copies > 1")
    items = left_join_null_safe(nan_to_null(order_items), repeated, "product_id")
    return (items.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("_copies", F.lit(1).cast("long")))))
            .drop("_copies", "col").withColumn("Total", F.col("price") + F.col("freight_value")))


def order_totals(detailed: DataFrame) -> DataFrame:
    """A2: Σ Total per order (null order ids dropped, all-null order -> 0.0)."""
    return (detailed.filter(F.col("order_id").isNotNull())
            .groupBy("order_id").agg(exact_sum("Total").alias("Total")))


def revenue_kpis(detailed: DataFrame) -> DataFrame:
    """A1–A6 as one row: total_revenue, average_order_value, total_orders,
    total_products, avg_items_per_order.

    One shuffle on order_id (partial aggregation first), then a global
    aggregate over the per-order rows. The null-order group carries the rows
    without an order id: they count in revenue and products, not in orders.
    """
    per_order = detailed.groupBy("order_id").agg(
        F.sum(exact("Total")).alias("order_sum"),
        F.count(F.lit(1)).alias("n_items"))
    has_order = F.col("order_id").isNotNull()
    totals = per_order.agg(
        F.coalesce(F.sum("order_sum").cast("double"), F.lit(0.0)).alias("total_revenue"),
        F.coalesce(F.sum(F.when(has_order, F.col("order_sum"))).cast("double"), F.lit(0.0)).alias("_order_revenue"),
        F.count_if(has_order).alias("total_orders"),
        F.coalesce(F.sum("n_items"), F.lit(0)).cast("long").alias("total_products"))
    return totals.select(
        "total_revenue",
        safe_ratio(F.col("_order_revenue"), F.col("total_orders")).alias("average_order_value"),
        "total_orders",
        "total_products",
        safe_ratio(F.col("total_products"), F.col("total_orders")).alias("avg_items_per_order"))


def revenue_by_metrics(detailed: DataFrame, key: str, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Σ of several metrics per non-null key in one aggregation pass (one
    scan, one shuffle); each ranking is then a projection of it. Catalyst
    drops the sums a consumer does not select."""
    return (detailed.filter(F.col(key).isNotNull())
            .groupBy(key).agg(*[exact_sum(m).alias(m) for m in metrics]))


def ranking_of(per_key: DataFrame, key: str, metric: str, sort: bool = True) -> DataFrame:
    """One metric of ``revenue_by_metrics`` as (key, Total), Total descending."""
    out = per_key.select(key, F.col(metric).alias("Total"))
    return out.orderBy(F.desc("Total"), F.asc(key)) if sort else out


def revenue_by(detailed: DataFrame, key: str, metric: str = "Total", sort: bool = True) -> DataFrame:
    """Σ metric per key as column ``Total``, null keys dropped, sorted by
    Total descending (key ascending breaks ties deterministically)."""
    if metric not in detailed.columns:
        raise KeyError(f"unknown metric column {metric!r}")
    out = (detailed.filter(F.col(key).isNotNull())
           .groupBy(key).agg(exact_sum(metric).alias("Total")))
    return out.orderBy(F.desc("Total"), F.asc(key)) if sort else out


def category_revenue(detailed: DataFrame, metric: str = "Total", sort: bool = True) -> DataFrame:
    return revenue_by(detailed, "product_category_name", metric, sort)


def vendor_revenue(detailed: DataFrame, metric: str = "Total", sort: bool = True) -> DataFrame:
    return revenue_by(detailed, "seller_id", metric, sort)


def top_row(ranked: DataFrame, key: str) -> DataFrame:
    """T4/T5: first row by Total (empty frame if there is none)."""
    return ranked.orderBy(F.desc("Total"), F.asc(key)).limit(1)


def missing_dimensional_data(detailed: DataFrame) -> DataFrame:
    """Nulls per dimension column over the joined rows, one pass."""
    counts = detailed.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in DIMENSION_COLUMNS])
    return counts.unpivot([], DIMENSION_COLUMNS, "column_name", "missing_count")


def volume_analysis_data(detailed: DataFrame) -> DataFrame:
    """F2 + P3: rows with all four dimensions, plus
    ``Volume_cm = width × height × length``."""
    return (detailed.na.drop("any", subset=DIMENSION_COLUMNS)
            .withColumn("Volume_cm", F.col("product_width_cm") * F.col("product_height_cm")
                        * F.col("product_length_cm")))
