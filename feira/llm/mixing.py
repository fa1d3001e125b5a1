"""Mixing sources to target weights, in DataFrame operations only.

Every row gets a hash-random key (md5 of seed and id). Rows are range-sorted
by the key within their source: the first RADIX hexadecimal digits of the key
are the range, sizes are summed per (source, range), running sums over the
ranges give each range its offset, and a window inside a (source, range) adds
the rows before it. So no task ever holds a whole source, a source may hold
any share of all rows, and the result does not depend on the partitioning.

A source's budget is cut exactly: with e = whole epochs in the budget and r
the rest, a row is taken e times, and once more up to the rest r (the row in
which the budget ends is taken in part).

Budgets: sources in code point order (null last) weigh 1, 2, 3, 1, 2, 3, ...
and share the total size by weight; a source stops at MAX_EPOCHS times its
size and the excess goes to the others by weight, until none is above. That
is: cap the sources in the order of cap / weight as long as the share per
weight of what remains exceeds it.

Rows without an id all have one key. They are ordered by size, so their part
of the order is cut further, by size and, among equal sizes, by text.

Defined cases: null text has size 0; a null id sorts as the empty text; rows
with the same key are ordered by id, then size, and equal rows are alike; a
source without words has target 0; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_EPOCHS = 3
RADIX = 3
SPREAD = 64
PLACE = ["range", "part", "size_part", "text_part"]
WEIGHTS = (1, 2, 3)
WS = r"\x20\x09-\x0D"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(rf"[^{WS}]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(name, source, source_size, target) from (name, source, source_size).

    The windows run over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]),
                          ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    s = (sizes.withColumn("weight", weight)
         .withColumn("cap", (F.col("source_size") * MAX_EPOCHS).cast("double"))
         .withColumn("turn", F.row_number().over(Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()))))
    before = Window.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("turn").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = (s.withColumn("total", F.sum("source_size").over(whole).cast("double"))
         .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)))
    # sources up to the first one that is not capped share nothing; it sets the level of all others
    free = s.withColumn("free", F.col("level") <= F.col("cap") / F.col("weight"))
    free = free.withColumn("share", F.min(F.when(F.col("free"), F.struct("turn", "level"))).over(whole)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("share") * F.col("weight"), F.col("cap")))
    return free.select("name", "source", "source_size", target.alias("target"))


def ranged(rows: DataFrame, no_id: str) -> DataFrame:
    """``rows`` (doc_id, size, key, spread) with the columns of PLACE: the range
    of the key, and for rows without an id (key ``no_id``) a finer place in
    their order. Places ascend with (key, doc_id, size)."""
    none = F.col("doc_id").isNull()
    return (rows.withColumn("range", F.substring("key", 1, RADIX))
            .withColumn("part", F.when(none, 1).when(F.col("key") < no_id, 0).otherwise(2))
            .withColumn("size_part", F.when(none, F.col("size")).otherwise(F.lit(0).cast("long")))
            .withColumn("text_part", F.coalesce("spread", F.lit(0).cast("long"))))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        seed: str = "mix", rows: bool = False) -> DataFrame:
    """(doc_id, size, source_size, target, taken); ``taken`` is the number of
    words the mix takes of the row, repeats counted. With ``rows`` a column
    ``row`` carries the whole input row."""
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))))
    # a source's name as a key that is never null, so joins and windows share one partitioning
    name = F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`")), F.lit("null"))
    carried = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if rows else []
    at = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), name.alias("name"),
                     word_count(F.col(f"`{text_col}`")).alias("size"), key.alias("key"),
                     F.when(F.col(f"`{id_col}`").isNull(), F.pmod(F.xxhash64(F.col(f"`{text_col}`")), F.lit(SPREAD))).alias("spread"),
                     *carried)
    at = ranged(at, hashlib.md5(f"{seed}:".encode()).hexdigest())
    ranges = at.groupBy("name", *PLACE).agg(F.sum("size").alias("in_range"), F.first("source").alias("source"))
    upto = Window.partitionBy("name").orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, -1)
    offset = ranges.withColumn("offset", F.coalesce(F.sum("in_range").over(upto), F.lit(0).cast("long")))
    per = targets(ranges.groupBy("name").agg(F.sum("in_range").alias("source_size"), F.first("source").alias("source")))
    offset = (offset.join(per.drop("source"), "name")
              .select("name", *PLACE, "offset", "source_size", "target"))
    inside = (Window.partitionBy("name", *PLACE).orderBy("key", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    start = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long"))
    budget = F.floor(F.col("target") + F.lit(1e-6))
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    extra = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("start")))
    return (at.join(offset, ["name", *PLACE]).withColumn("start", start)
            .select("doc_id", "size", "source_size", "target", (epochs * F.col("size") + extra).cast("long").alias("taken"),
                    *(["row"] if rows else [])))


def mixed_rows(docs: DataFrame, **names: str) -> DataFrame:
    """Every row that the mix takes, once, with its columns as they came and
    mix_size, mix_target and mix_taken (with a ``_`` more where the input has such a column)."""
    out = mix(docs, rows=True, **names).filter("taken > 0")

    def free(name: str) -> str:
        while name.lower() in {c.lower() for c in docs.columns}:
            name += "_"
        return name

    return out.select("row.*", F.col("size").alias(free("mix_size")), F.col("target").alias(free("mix_target")),
                      F.col("taken").alias(free("mix_taken")))
