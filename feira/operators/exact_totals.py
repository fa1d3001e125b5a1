"""Totals of doubles of any size, rounded once.

``numeric.exact_sum`` sums decimals with 16 digits after the point, so values
under 1e-16 vanish and sums over 1e22 raise. ``exact_totals`` has no range: a
double is a whole number times a power of two, so it is cut into four
limbs of LIMB bits at fixed binary places, limbs of values of one magnitude
are summed as longs (partial aggregation first; money sits in one or two
magnitudes), and only the total of a key is put together, carried and rounded
to the nearest double, ties to even. The result is the one of ``math.fsum``
and doesn't depend on the order of rows, files or partitions.

A sum of limbs is exact up to 2^39 values per key and magnitude; beyond that
Spark raises an overflow error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMB = 24
MASK = (1 << LIMB) - 1
# magnitude m: values from 2^(LIMB * m) on; those of the smallest and largest double
_LEAST, _MOST = -1074 // LIMB, 1023 // LIMB
_LN = 16.635532333438686  # LIMB * ln 2


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _limb_rows(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, _which, _m, _a.._d, _special): summed limbs per key, column and magnitude."""
    values = F.array(*[F.struct(F.lit(i).alias("_which"), F.col(c).cast("double").alias("_x"))
                       for i, c in enumerate(columns)])
    rows = df.select(*keys, F.inline(values))
    x = F.nanvl("_x", F.lit(None).cast("double"))
    finite = F.when(F.abs(x) < F.lit(float("inf")), x)
    # a magnitude that is off by one next to a power of two loses no bit
    rows = rows.select(*keys, "_which", finite.alias("_f"), F.when(F.abs(x) == F.lit(float("inf")), x).alias("_special"),
                       F.coalesce(F.floor(F.log(F.abs(finite)) / _LN), F.lit(0)).cast("int").alias("_m"))
    # 2^(-LIMB * m) in two steps, as it can be beyond a double
    half = F.get(F.array(*[F.lit(2.0 ** (-LIMB // 2 * m)) for m in range(_LEAST, _MOST + 1)]), F.col("_m") - _LEAST)
    rows = rows.withColumn("_y", F.col("_f") * half * half * float(1 << LIMB))
    rows = rows.withColumn("_hi", F.col("_y").cast("long"))
    rows = rows.withColumn("_lo", ((F.col("_y") - F.col("_hi")) * float(1 << 2 * LIMB)).cast("long"))
    return rows.groupBy(*keys, "_which", "_m").agg(
        F.sum(F.shiftright("_hi", LIMB)).alias("_a"), F.sum(F.col("_hi").bitwiseAND(MASK)).alias("_b"),
        F.sum(F.shiftright("_lo", LIMB)).alias("_c"), F.sum(F.col("_lo").bitwiseAND(MASK)).alias("_d"),
        F.sum("_special").alias("_special"))


def _carried(limbs: Column) -> Column:
    """(carry, digits) of limbs, lowest first; a negative carry means a negative number."""
    empty = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<bigint>").alias("digits"))
    return F.aggregate(limbs, empty, lambda s, v: F.struct(
        F.shiftright(s["carry"] + v, LIMB).alias("carry"),
        F.concat(s["digits"], F.array((s["carry"] + v).bitwiseAND(MASK))).alias("digits")))


def _rounded(digits: Column, lowest: Column) -> Column:
    """The double nearest to digits at binary places LIMB * (lowest, lowest + 1, ...)."""

    def at_top(top: Column) -> Column:
        def digit(k: int) -> Column:
            return F.coalesce(F.when(top >= k, F.get(digits, F.greatest(top - k, F.lit(0)))), F.lit(0).cast("long"))

        def value(x: Column) -> Column:
            # 62 leading bits, the last of them set if anything follows: rounding that to 53 bits is exact
            bits, high, low = x["bits"], x["high"], x["low"]
            unit = F.call_function("shiftleft", F.lit(1).cast("long"), bits + 10)
            rest = (low.bitwiseAND(unit - 1) != 0) | F.exists(
                F.slice(digits, F.lit(1), F.greatest(top - 3, F.lit(0))), lambda v: v > 0)
            lead = (F.call_function("shiftleft", high, F.lit(38) - bits)
                    .bitwiseOR(F.call_function("shiftright", low, bits + 10))
                    .bitwiseOR(rest.cast("long")))
            return _let((lowest + top - 1) * LIMB - 38 + bits, lambda power: _let(
                F.floor(power / 2), lambda part: lead.cast("double") * F.pow(F.lit(2.0), part)
                * F.pow(F.lit(2.0), power - part)))

        parts = F.struct(F.length(F.bin(digit(0))).alias("bits"),
                         (digit(0) * (1 << LIMB) + digit(1)).alias("high"),
                         (digit(2) * (1 << LIMB) + digit(3)).alias("low"))
        return F.when(top < 0, F.lit(0.0)).otherwise(_let(parts, value))

    return _let(F.array_max(F.transform(digits, lambda v, i: F.when(v > 0, i).otherwise(-1))), at_top)


def _total(sums: Column) -> Column:
    """The rounded sum of (m, a, b, c, d) entries; 0.0 without any."""

    def over(ends: Column) -> Column:
        def limb(j: Column) -> Column:
            def of(s: Column) -> Column:
                return (F.when(s["m"] == j, s["a"]).when(s["m"] - 1 == j, s["b"])
                        .when(s["m"] - 2 == j, s["c"]).when(s["m"] - 3 == j, s["d"]).otherwise(F.lit(0).cast("long")))
            return F.aggregate(sums, F.lit(0).cast("long"), lambda t, s: t + of(s))

        def signed(limbs: Column) -> Column:
            return _let(_carried(limbs), lambda n: F.when(n["carry"] >= 0, _rounded(n["digits"], ends["low"])).otherwise(
                -_rounded(_carried(F.transform(limbs, lambda v: -v))["digits"], ends["low"])))

        return _let(F.transform(F.sequence(ends["low"], ends["high"]), limb), signed)

    places = F.transform(sums, lambda s: s["m"])
    return F.when(F.size(sums) == 0, F.lit(0.0)).otherwise(_let(
        F.struct((F.array_min(places) - 3).alias("low"), (F.array_max(places) + 3).alias("high")), over))


def exact_totals(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per distinct ``keys`` (a null key is a key) with the exactly
    rounded Σ of each of ``columns`` as a double.

    Null and NaN are skipped, a group without a value has 0.0, and infinities
    give what adding them gives (both signs: NaN). Without keys there is one
    row, for an empty table too. One total beyond the largest double is an infinity.
    """
    def own(i: int, c: Column) -> Column:
        return F.when(F.col("_which") == i, c)

    entry = F.struct(F.col("_m").alias("m"), *[F.col(f"_{n}").alias(n) for n in "abcd"])
    lists = _limb_rows(df, keys, columns).groupBy(*keys).agg(*[x for i in range(len(columns)) for x in (
        F.collect_list(own(i, F.when(F.col("_a").isNotNull(), entry))).alias(f"_sums{i}"),
        F.sum(own(i, F.col("_special"))).alias(f"_special{i}"))])
    return lists.select(*keys, *[F.coalesce(F.col(f"_special{i}"), _total(F.col(f"_sums{i}"))).alias(c)
                                 for i, c in enumerate(columns)])
