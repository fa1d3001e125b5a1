"""Totals without a range against ``math.fsum``."""

import math
import random
import struct

import pytest

from feira.operators.exact_totals import exact_totals


def any_double(rng):
    while True:
        x = struct.unpack("<d", rng.randbytes(8))[0]
        if math.isfinite(x) and abs(x) < 1e300:
            return x


def groups():
    rng = random.Random(5)
    out = {f"any{n}": [any_double(rng) for _ in range(n)] for n in (1, 2, 3, 10, 200)}
    out |= {f"money{k}": [round(rng.uniform(-1e5, 1e5), 2) for _ in range(300)] for k in range(20)}
    out |= {f"spread{k}": [rng.uniform(-1, 1) * 2.0 ** rng.randint(-k, k) for _ in range(100)] for k in (1, 5, 30, 60, 200)}
    for k in range(40):  # what is left after nearly everything cancels
        xs = [any_double(rng) for _ in range(20)]
        out[f"cancel{k}"] = xs + [-x for x in xs] + [rng.uniform(-1, 1) * 2.0 ** rng.randint(-1060, 60) for _ in range(2)]
    out |= {"tiny": [3e-17, 3e-17], "huge": [1e22, 1e22, 1e300], "tie": [1.0, 2.0 ** -53], "tie_up": [1.0, 2.0 ** -53, 5e-324],
            "tie_even": [1.0 + 2.0 ** -52, 2.0 ** -53], "least": [5e-324, 5e-324, -5e-324], "zeros": [0.0, -0.0],
            "negative": [-1e-300, -1e300, 7.0], "largest": [1.7976931348623157e308, -1.0], "none": [],
            **{f"power{e}": [s * 2.0 ** e * (1 + d) for s in (1, 1, -1) for d in (-2.0 ** -53, 0.0, 2.0 ** -52)]
               for e in range(-1008, 1009, 144)}}
    return out


def test_equals_fsum(spark):
    data = groups()
    rows = [(k, x, -x if x is not None else None) for k, xs in data.items() for x in [*xs, None]]
    df = spark.createDataFrame(rows, "k string, x double, minus double").repartition(7)
    got = {r.k: (r.x, r.minus) for r in exact_totals(df, ["k"], ["x", "minus"]).collect()}
    assert got == {k: (math.fsum(xs), math.fsum(-x for x in xs)) for k, xs in data.items()}


def test_special_values_keys_and_empty_tables(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([("a", 1.0, 2), ("a", inf, 3), (None, nan, 4), (None, 0.1, None), ("b", inf, None), ("b", -inf, None)],
                               "k string, x double, n int")
    got = {r.k: r for r in exact_totals(df, ["k"], ["x", "n"]).collect()}
    assert (got["a"].x, got["a"].n, got[None].x, got[None].n, got["b"].n) == (inf, 5.0, 0.1, 4.0, 0.0)
    assert math.isnan(got["b"].x)
    assert exact_totals(df.filter("false"), ["k"], ["x"]).count() == 0


def test_one_row_without_keys(spark):
    df = spark.createDataFrame([(1e-20,), (1e25,), (-1e25,)], "x double")
    assert [r.x for r in exact_totals(df, [], ["x"]).collect()] == [1e-20]
    assert [r.x for r in exact_totals(df.filter("false"), [], ["x"]).collect()] == [0.0]


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_partitions_do_not_matter(spark, parts):
    rng = random.Random(9)
    xs = [rng.uniform(-1, 1) * 10.0 ** rng.randint(-20, 20) for _ in range(2000)]
    df = spark.createDataFrame([(x,) for x in xs], "x double").repartition(parts)
    assert exact_totals(df, [], ["x"]).first().x == math.fsum(xs)
