"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feira.llm._store import cut


def _settled(e: DataFrame) -> bool:
    """Whether every node of the edges (u, v) either has one v and is none, or is a v only."""
    ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("up")),
                                      F.struct(F.col("v").alias("node"), F.lit(None).cast("long").alias("up")))).alias("end")).select("end.*")
    seen = ends.groupBy("node").agg(F.min("up").alias("lo"), F.max("up").alias("hi"), F.count_if(F.col("up").isNull()).alias("below"))
    return seen.agg(F.count_if((F.col("lo") < F.col("hi")) | (F.col("lo").isNotNull() & (F.col("below") > 0)))).first()[0] == 0


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b; longs).

    ``component`` is the smallest node of the component. Each round points
    every node at the smallest node it can see (large star, then small star),
    until all are stars around their smallest node; the number of rounds grows
    with the logarithm of the longest chain. Edges stay in tables; only a count
    reaches the driver. A round reads the edges as few times as it can: the
    driver keeps a record of every task, and a shuffle has many.
    """
    e = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(max_rounds):
        ends = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("end"))
        low = ends.select("end.*").groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (e.select(F.col("v").alias("u"), F.col("u").alias("above")).join(low, "u")
                 .select(F.col("above").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        both = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))
        e = cut(large.join(least, "u").select(F.explode(both).alias("end")).select("end.*").filter("u <> v").distinct())
        if _settled(e):
            break
    else:
        raise RuntimeError("components did not settle")
    return (e.select(F.explode(F.array("u", "v")).alias("node"), F.col("v").alias("component")).distinct())
