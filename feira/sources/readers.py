"""Readers for the three analysis inputs as they are published.

CSV files are read with a header and no schema inference (every column as
text, resolved by header name, so column order does not matter); the
columns the analyses use are then cast to their types; dates are read as
written (``timestamp_ntz``), whatever the session's time zone. Parquet keeps
its own types and gets the same casts. ``Delay`` stays text here and is normalised by
``feira.functions.delay.normalize_delay``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Types of the input columns the analyses use.
ORDER_ITEMS_TYPES = {
    "order_id": "string", "order_item_id": "int", "product_id": "string", "seller_id": "string",
    "shipping_limit_date": "timestamp_ntz", "price": "double", "freight_value": "double",
}
PRODUCTS_TYPES = {
    "product_id": "string", "product_category_name": "string", "product_weight_g": "double",
    "product_length_cm": "double", "product_height_cm": "double", "product_width_cm": "double",
}
ORDERS_TYPES = {
    "order_id": "string", "customer_state": "string", "Net_State": "string", "Delay": "string",
    "delay_days": "double", "TOTAL": "double", "order_purchase_timestamp": "timestamp_ntz",
}


# Words a CSV field holds for a missing value.
NULL_WORDS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
              "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def _read(spark: SparkSession, path: str, fmt: str, null_words: tuple[str, ...] = NULL_WORDS) -> DataFrame:
    if fmt == "csv":
        raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
        return raw.select(*[F.when(~F.col(f"`{c}`").isin(*null_words), F.col(f"`{c}`")).alias(c) for c in raw.columns])
    if fmt == "parquet":
        return spark.read.parquet(path)
    raise ValueError("fmt must be 'csv' or 'parquet'")


def _cast(df: DataFrame, c: str, target: str, on_error: str):
    value = F.col(f"`{c}`")
    read = value.try_cast(target)
    if on_error == "null":
        return read.alias(c)
    bad = F.concat(F.lit(f"column {c}: not a {target}: "), value.cast("string"))
    return F.when(value.isNotNull() & read.isNull(), F.raise_error(bad).cast(target)).otherwise(read).alias(c)


def rejected(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """One row: per known column, how many values its type cannot hold."""
    return df.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(t).isNull()).alias(c)
                    for c, t in types.items() if c in df.columns])


def _typed(df: DataFrame, types: dict[str, str], pct_columns: bool = False, on_error: str = "fail") -> DataFrame:
    """Cast the known columns; other columns pass through unchanged. A value
    that its type cannot hold is an error naming column and value
    (``on_error="fail"``), or null (``"null"``; ``rejected`` counts them)."""
    if on_error not in ("fail", "null"):
        raise ValueError("on_error must be 'fail' or 'null'")
    out = []
    for c in df.columns:
        target = types.get(c) or ("double" if pct_columns and c.endswith("_PCT") else None)
        if target is None or target == "string" and df.schema[c].dataType.simpleString() == "string":
            out.append(F.col(f"`{c}`"))
        elif c == "Delay" and df.schema[c].dataType.simpleString() != "string":
            out.append(F.col("Delay"))  # already a duration or number: normalize_delay handles it
        else:
            out.append(_cast(df, c, target, on_error))
    return df.select(*out)


def read_order_items(spark: SparkSession, path: str, fmt: str = "csv", on_error: str = "fail",
               null_words: tuple[str, ...] = NULL_WORDS) -> DataFrame:
    return _typed(_read(spark, path, fmt, null_words), ORDER_ITEMS_TYPES, on_error=on_error)


def read_products(spark: SparkSession, path: str, fmt: str = "csv", on_error: str = "fail",
               null_words: tuple[str, ...] = NULL_WORDS) -> DataFrame:
    return _typed(_read(spark, path, fmt, null_words), PRODUCTS_TYPES, on_error=on_error)


def read_orders(spark: SparkSession, path: str, fmt: str = "csv", on_error: str = "fail",
               null_words: tuple[str, ...] = NULL_WORDS) -> DataFrame:
    """Cleaned orders; every ``*_PCT`` stage column is read as a double."""
    return _typed(_read(spark, path, fmt, null_words), ORDERS_TYPES, pct_columns=True, on_error=on_error)


TYPES = {"order_items": ORDER_ITEMS_TYPES, "products": PRODUCTS_TYPES, "orders": ORDERS_TYPES}


def read_marked(spark: SparkSession, path: str, kind: str, fmt: str = "csv",
                null_words: tuple[str, ...] = NULL_WORDS) -> DataFrame:
    """Every row of an input (``kind``: order_items, products or orders), with
    ``source_file`` and ``reject_reason``.

    ``reject_reason`` is null for a row that its types can hold. Else it names
    each column and value that cannot be read (those are null in the row), or
    says that a CSV line has more or fewer fields than the header.
    """
    types = TYPES[kind]
    if fmt == "csv":
        names = spark.read.option("header", True).option("inferSchema", False).csv(path).columns
        schema = ", ".join(f"`{c}` string" for c in names) + ", _line string"
        raw = (spark.read.schema(schema).option("header", True).option("columnNameOfCorruptRecord", "_line").csv(path)
               .select("*", F.col("_metadata.file_path").alias("source_file")))
        raw = raw.withColumns({c: F.when(~F.col(f"`{c}`").isin(*null_words), F.col(f"`{c}`")) for c in names})
        torn = F.when(F.col("_line").isNotNull(), F.concat(F.lit("not the header's number of fields: "), F.col("_line")))
    else:
        raw = _read(spark, path, fmt, null_words).select("*", F.col("_metadata.file_path").alias("source_file"))
        names, torn = [c for c in raw.columns if c != "source_file"], F.lit(None).cast("string")
    reasons, out = [torn], []
    for c in names:
        target = types.get(c) or ("double" if kind == "orders" and c.endswith("_PCT") else None)
        value = F.col(f"`{c}`")
        if target in (None, raw.schema[c].dataType.simpleString()) or (c == "Delay" and raw.schema[c].dataType.simpleString() != "string"):
            out.append(value)
            continue
        reasons.append(F.when(value.isNotNull() & value.try_cast(target).isNull(),
                              F.concat(F.lit(f"column {c}: not a {target}: "), value.cast("string"))))
        out.append(value.try_cast(target).alias(c))
    why = F.array_compact(F.array(*reasons))
    return raw.select(*out, "source_file", F.when(F.size(why) > 0, F.concat_ws("; ", why)).alias("reject_reason"))


def store_split(marked: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Write the rows of ``read_marked`` in one pass and return (typed rows,
    rejected rows): together they are all rows of the input."""
    marked.withColumn("rejected", F.col("reject_reason").isNotNull()).write.mode("overwrite").partitionBy("rejected").parquet(path)
    stored = marked.sparkSession.read.schema(marked.schema.add("rejected", "boolean")).parquet(path)
    return (stored.filter("NOT rejected").drop("rejected", "reject_reason", "source_file"),
            stored.filter("rejected").drop("rejected"))
