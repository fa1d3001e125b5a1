"""Stored partial aggregates per input file (S6 without keeping frames in memory).

A dashboard asks for the same totals again and again while files are added.
``FilePartials`` keeps one small table of partial aggregates per input file;
``refresh`` reads only files that are not in it yet, and ``rows`` gives the
partials of exactly the files that are there now, to be added up. A file that
was rewritten counts as a new one (path, size and time are its name), and the
partials of files that are gone are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# the name under which a file's partials are kept
_FILE = "concat_ws('|', _metadata.file_path, _metadata.file_size, unix_micros(_metadata.file_modification_time))"


class FilePartials:
    """``FilePartials(spark, store, read, partial)``: ``store`` is a folder on
    shared storage, ``read(paths)`` reads input files, and ``partial(rows,
    "source_file")`` aggregates them by that column and the keys."""

    def __init__(self, spark: SparkSession, store: str, read: Callable[[list[str]], DataFrame],
                 partial: Callable[[DataFrame, str], DataFrame]):
        self.spark, self.store, self.read, self.partial = spark, store.rstrip("/"), read, partial

    def _listing(self, path: str) -> DataFrame:
        """(source_file, path) of the files under ``path``: names only, no data is read."""
        return (self.spark.read.format("binaryFile").load(path)
                .select(F.concat_ws("|", "path", "length", F.unix_micros("modificationTime")).alias("source_file"), "path"))

    def _stored(self) -> DataFrame | None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(self.store)
        there = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
        return self.spark.read.parquet(self.store) if there else None

    def refresh(self, path: str) -> int:
        """Add the partials of files that are not stored yet; returns their number.
        One append per refresh, so a refresh that fails leaves nothing behind."""
        listed, stored = self._listing(path), self._stored()
        new = listed if stored is None else listed.join(stored.select("source_file").distinct(), "source_file", "left_anti")
        paths = [r.path for r in new.select("path").collect()]  # file names
        if paths:
            rows = self.read(paths).withColumn("source_file", F.expr(_FILE))
            self.partial(rows, "source_file").write.mode("append").parquet(self.store)
        return len(paths)

    def rows(self, path: str) -> DataFrame:
        """The stored partials of the files that are under ``path`` now."""
        stored = self._stored()
        if stored is None:
            raise ValueError("nothing stored yet: call refresh first")
        return stored.join(self._listing(path).select("source_file"), "source_file", "left_semi")
