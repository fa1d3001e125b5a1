"""Distinct orders per group as mergeable bitmaps (A12, A13, A16 in parts).

``order_bitmaps`` keeps, per group, which order ids occur, as Spark's own
bitmaps of 32,768 consecutive ids each. Such tables can be stored, united
with those of new files and rolled up to any coarser grouping, and the counts
stay exact where a sum of counts would count an order twice. Ids are whole
numbers; rows without an id count nowhere, as in a distinct count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def order_bitmaps(orders: DataFrame, keys: Sequence[Column], id_col: str = "order_id") -> DataFrame:
    """(keys..., id_range, ids): one row per group and range of ids that it
    has. Partial bitmaps are built before the shuffle, and the range is part
    of the key, so a group with most orders is spread over its ranges."""
    rows = orders.filter(F.col(id_col).isNotNull()).select(
        *keys, F.bitmap_bucket_number(F.col(id_col)).alias("id_range"), F.bitmap_bit_position(F.col(id_col)).alias("at"))
    names = rows.columns[:-1]
    return rows.groupBy(*names).agg(F.bitmap_construct_agg("at").alias("ids"))


def united(*tables: DataFrame) -> DataFrame:
    """The bitmaps of all tables, one row per group and range."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    keys = [c for c in out.columns if c != "ids"]
    return out.groupBy(*keys).agg(F.bitmap_or_agg("ids").alias("ids"))


def distinct_orders(bitmaps: DataFrame, by: Sequence[str], name: str = "orders", where: Column | None = None) -> DataFrame:
    """(by..., name): distinct orders of a grouping that may be coarser than
    the table's; ``where`` picks groups."""
    rows = bitmaps if where is None else bitmaps.filter(where)
    merged = rows.groupBy(*by, "id_range").agg(F.bitmap_or_agg("ids").alias("ids"))
    return merged.groupBy(*by).agg(F.sum(F.bitmap_count("ids")).cast("long").alias(name))
