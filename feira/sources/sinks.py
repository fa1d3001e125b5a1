"""Sinks and reuse of derived frames."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a result as CSV with a header (one file per task; no coalesce to
    a single file, which would funnel the whole result through one task)."""
    df.write.mode(mode).option("header", True).csv(path)


def export_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


@contextmanager
def persisted(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
    """Keep a frame that several results are derived from; unpersist after.

    Memory-and-disk so executor loss or memory pressure recomputes or spills
    instead of failing.
    """
    df.persist(level)
    try:
        yield df
    finally:
        df.unpersist()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in ``spark.checkpoint.dir``."""
    return df.checkpoint(eager=True)
