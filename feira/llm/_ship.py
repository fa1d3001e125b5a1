"""Running functions of this package inside tasks."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import feira

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the executors, once per application (as ``--py-files`` would)."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(feira.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="feira-py-"), "feira_tasks.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with the package on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
