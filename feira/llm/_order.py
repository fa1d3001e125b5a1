"""Positions in a sorted order, per group, without a window over a whole group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feira.llm._ship import map_arrow
from feira.llm._store import cut


def positions(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``rows`` with ``pos``: 0, 1, ... in ``order`` inside each value of the
    string column ``group`` (never null), and checkpointed.

    The rows are range-sorted by (group, order) and, for rows that are equal
    in all of these, by a row-wise key, so no group and no value has to fit in
    one task. Each sorted partition counts its groups; only the first group of
    a partition can have begun in an earlier one, so one offset a partition is
    broadcast.
    """
    named = rows.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
    by = [F.col(group), *order, F.col("_tie")]
    ordered = cut(named.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
                  .withColumn("_part", F.spark_partition_id()))
    counts = ordered.groupBy("_part", group).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begun = (counts.withColumn("before", F.sum("n").over(earlier)).filter("before > 0")
             .select("_part", "before").collect())  # at most one row a partition
    before = {r["_part"]: r["before"] for r in begun}

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, upcoming = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(group)
            codes = keys.dictionary_encode().indices.to_numpy()
            start = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            within = np.arange(len(codes)) - np.repeat(start, np.diff(np.append(start, len(codes))))
            first = keys[0].as_py()
            if last is None:  # the group that an earlier partition may have begun
                upcoming = before.get(batch.column("_part")[0].as_py(), 0)
            elif first != last:
                upcoming = 0
            head = start[1] if len(start) > 1 else len(codes)
            within[:head] += upcoming
            last, upcoming = keys[-1].as_py(), int(within[-1]) + 1
            kept = [c for c in batch.schema.names if c != "_part"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(within, pa.int64())], [*kept, "pos"])

    kept = ordered.drop("_part").schema
    return map_arrow(ordered, number, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", pos long")
