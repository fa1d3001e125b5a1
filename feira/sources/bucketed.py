"""Bucketed copies of the inputs and the join that reads them without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """Write ``df`` as a table bucketed and sorted by ``key`` and read it back.
    Rows are dealt by key first, so every bucket is one file.

    Choose ``buckets`` so that one bucket of the larger table is some hundred MB.
    """
    writer = df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)


def left_join_bucketed(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """pandas ``merge(left, right, on=key, how='left')`` of two tables that are
    bucketed by ``key`` with the same number of buckets.

    A null-safe join key hides the bucketing, so the rows with a key meet by
    plain equality (no exchange on either side), and the rows without one are
    joined apart: they match the right side's rows without a key, which are few.
    """
    overlap = (set(left.columns) & set(right.columns)) - {key}
    if overlap:
        raise ValueError(f"columns on both sides of the join besides {key!r}: {sorted(overlap)}")
    columns = [*left.columns, *[c for c in right.columns if c != key]]
    keyed = left.filter(F.col(key).isNotNull()).join(right.filter(F.col(key).isNotNull()), key, "left").select(*columns)
    l, r = left.filter(F.col(key).isNull()).alias("_l"), right.filter(F.col(key).isNull()).alias("_r")
    apart = l.join(r, F.col(f"_l.{key}").eqNullSafe(F.col(f"_r.{key}")), "left").select(
        *[F.col(f"_l.{c}").alias(c) for c in left.columns], *[F.col(f"_r.{c}").alias(c) for c in right.columns if c != key])
    return keyed.unionByName(apart)
