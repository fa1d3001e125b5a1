"""Joins: the order-items/products left join.

No broadcast hint and no row count: Spark picks the join by the byte size of
the pruned side (``spark.sql.autoBroadcastJoinThreshold``), and AQE re-plans at
run time and splits skewed partitions. Building the join runs no job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_join_null_safe(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """pandas ``merge(left, right, on=key, how='left')``.

    * null keys match null keys (``<=>``), as in pandas;
    * duplicate keys on the right fan out (no de-duplication);
    * columns other than the key present on both sides are rejected instead
      of being suffixed ``_x`` / ``_y``.
    Output: every left column, then the right columns except the key.
    """
    overlap = (set(left.columns) & set(right.columns)) - {key}
    if overlap:
        raise ValueError(f"columns on both sides of the join besides {key!r}: {sorted(overlap)}")
    l, r = left.alias("_l"), right.alias("_r")
    joined = l.join(r, F.col(f"_l.{key}").eqNullSafe(F.col(f"_r.{key}")), "left")
    return joined.select(*[F.col(f"_l.{c}").alias(c) for c in left.columns],
                         *[F.col(f"_r.{c}").alias(c) for c in right.columns if c != key])
