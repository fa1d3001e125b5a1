"""Shared scratch space and lineage cuts.

A cluster names a shared folder in ``spark.checkpoint.dir``; everything that
outlives a stage is written there, so a lost executor never loses it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from feira.session import ensure_checkpoint_dir


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
