"""Right-closed binning with pandas ``cut(..., include_lowest=True)`` semantics.

Intervals are ``[e0, e1], (e1, e2], ..., (e_{n-1}, e_n]``; values outside, null
and NaN fall in no bin (null index). Spark's ``Bucketizer`` and
``width_bucket`` are left-closed, so the bin index is a ``when`` chain on the
edges instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default delay ranges in days and the percentage bin edges.
DEFAULT_DELAY_RANGES = [(-30, -20), (-20, -10), (-10, -5), (-5, -2), (-2, 0)]
PCT_EDGES = [0.0, 10.0, 20.0, 30.0, 40.0, 50.0, 60.0, 70.0, 80.0, 90.0, 100.0]


def _label(low, high, unit: str = "") -> str:
    return "".join((str(low), "–", str(high), unit))


def edges_from_ranges(ranges: Sequence[tuple]) -> list:
    """The bin edges: each range closes a bin at its end, and only the first
    range's start opens one (later starts only shape the labels)."""
    edges: list = []
    for low, high in ranges:
        if not edges:
            edges.append(low)
        if high <= edges[-1]:
            raise ValueError(f"a bin must end after {edges[-1]}, not at {high}")
        edges.append(high)
    if not edges:
        raise ValueError("at least one range is required")
    return edges


def range_labels(ranges: Sequence[tuple]) -> list[str]:
    seen: dict[str, None] = {}
    for low, high in ranges:
        label = _label(low, high)
        if label in seen:
            raise ValueError(f"two ranges share the label {label!r}")
        seen[label] = None
    return list(seen)


def pct_labels() -> list[str]:
    step = round(PCT_EDGES[-1] / (len(PCT_EDGES) - 1))
    return [_label(low, low + step, " %") for low in range(0, round(PCT_EDGES[-1]), step)]


def right_closed_bin(c: Column, edges: Sequence[float]) -> Column:
    """0-based bin index of ``c`` over ``edges``; null outside the range."""
    expr = F.when(c.isNull() | F.isnan(c.cast("double")) | (c < F.lit(edges[0])) | (c > F.lit(edges[-1])),
                  F.lit(None).cast("int"))
    expr = expr.when(c == F.lit(edges[0]), F.lit(0))
    for i, hi in enumerate(edges[1:]):
        expr = expr.when(c <= F.lit(hi), F.lit(i))
    return expr


def label_of(index: Column, labels: Sequence[str]) -> Column:
    """Label for a 0-based bin index (null index -> null label)."""
    return F.try_element_at(F.array(*[F.lit(x) for x in labels]), index + 1)
