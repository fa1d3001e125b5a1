"""Required / optional input columns of each analysis input."""

from __future__ import annotations

from pyspark.sql import DataFrame

ORDER_ITEMS_REQUIRED = ["order_id", "product_id", "seller_id", "price", "freight_value"]
PRODUCTS_REQUIRED = ["product_id", "product_category_name", "product_weight_g",
                     "product_length_cm", "product_height_cm", "product_width_cm"]
# Delay, delay_days and TOTAL are optional; each analysis checks what it uses.
ORDERS_REQUIRED = ["order_id", "Net_State"]


def require_columns(df: DataFrame, columns: list[str], what: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"{what} is missing column(s) {missing}; has {df.columns}")
