"""Null/NaN handling and exact sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Values are summed exactly, so totals do not depend on the order in which
# partitions are combined. A decimal keeps its own scale; a double goes in by
# its shortest decimal form with EXACT_SCALE digits after the point, which
# keeps every digit of a double of 0.1 or more and leaves out less than 1e-16
# of a smaller one. Nothing is rounded to cents, and a value or a sum beyond
# 1e22 is an ANSI overflow error.
EXACT_SCALE = 16
EXACT = T.DecimalType(38, EXACT_SCALE)


def nan_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Treat floating NaN as null, as pandas does (sum skips it, dropna drops it)."""
    targets = {f.name for f in df.schema.fields
               if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if columns is not None:
        targets &= set(columns)
    if not targets:
        return df
    return df.select(*[
        F.nanvl(F.col(c), F.lit(None).cast(df.schema[c].dataType)).alias(c) if c in targets else F.col(c)
        for c in df.columns
    ])


def exact(c: Column | str) -> Column:
    """The value as an exactly summable decimal (null for null/NaN)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.nanvl(col.cast("double"), F.lit(None).cast("double")).cast(EXACT)


def exact_sum(c: Column | str) -> Column:
    """Σ of a column as a double: nulls skipped, all-null or empty group -> 0.0."""
    return F.coalesce(F.sum(exact(c)).cast("double"), F.lit(0.0))


def safe_ratio(num: Column, den: Column, scale: float = 1.0, otherwise: Column | None = None) -> Column:
    """num / den * scale in double, ``otherwise`` (default null) when den is 0."""
    value = num.cast("double") / den.cast("double")
    if scale != 1.0:
        value = value * F.lit(scale)
    return F.when(den != 0, value).otherwise(otherwise if otherwise is not None else F.lit(None))
