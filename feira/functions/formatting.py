"""Display strings: currency labels, thousands separators, heat-map cell text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def thousands(c: Column, decimals: int) -> Column:
    """Python's ``f"{x:,.{decimals}f}"`` (round-half-even on the binary value)."""
    return F.format_number(c, decimals)


def fixed(c: Column, decimals: int) -> Column:
    """Python's ``f"{x:.{decimals}f}"`` (no separators)."""
    return F.regexp_replace(F.format_number(c, decimals), ",", "")


def currency(c: Column, decimals: int) -> Column:
    """``R$1,234`` / ``R$1,234.56``."""
    return F.concat(F.lit("R$"), F.format_number(c, decimals))


def plain_number(c: Column, integral: bool) -> Column:
    """Python's ``f"{x:,}"``: integers with separators; two-decimal money
    values as their shortest text (one trailing zero dropped: 1.50 -> 1.5,
    2.00 -> 2.0)."""
    if integral:
        return F.format_number(c, 0)
    return F.regexp_replace(F.format_number(c, 2), "0$", "")


def cell_text(n: Column) -> Column:
    """Heat-map cell text: empty for 0, else the integer."""
    return F.when(n == 0, F.lit("")).otherwise(n.cast("long").cast("string"))
