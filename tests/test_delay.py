"""O1: Delay normalisation (text / interval / numeric) and P11 delay_days."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from feira.functions.delay import delay_days, format_seconds_as_text, normalize_delay

H = 3600 * 10**9
DAY = 24 * H


def _ns(spark, values, **kw):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, Delay string")
    rows = normalize_delay(df, **kw).orderBy("i").select("delay_ns").collect()
    return [r.delay_ns for r in rows]


def test_pandas_text_forms(spark):
    got = _ns(spark, ["-8 days +07:32:10", "-1 days +22:00:00", "-1 days 22:00:00", "-02:00:00",
                      "3 days 04:00:00.5", "1 day", "0 days", "02:00:00", "+02:00:00",
                      "0 days 00:00:00.000000001"])
    assert got == [-8 * DAY + (7 * 3600 + 32 * 60 + 10) * 10**9, -2 * H, -2 * H, -2 * H,
                   3 * DAY + 4 * H + 500_000_000, DAY, 0, 2 * H, 2 * H, 1]


def test_null_like_text_is_null_not_malformed(spark):
    assert _ns(spark, ["", "NaT", None, "  "]) == [None, None, None, None]


def test_iso_and_integer_text(spark):
    assert _ns(spark, ["P1DT2H", "-P1D", "PT30M", "PT1.5S", "3", "-7"]) == [
        DAY + 2 * H, -DAY, 30 * 60 * 10**9, 1_500_000_000, 3, -7]


def test_iso_sign_rules_follow_pandas(spark):
    # pandas' isoformat() writes negative durations with the sign on the days
    assert _ns(spark, ["P-1DT22H0M0S", "P-1W2D", "PT-2H30M", "-P-1D", "P+1D", "P1DT", "P1D2H"]) == [
        -2 * H, -5 * DAY, -90 * 60 * 10**9, DAY, DAY, DAY, DAY + 2 * H]


def test_malformed_text(spark):
    assert _ns(spark, ["junk", "-1 days -22:00:00", "-", "P", "PT", "+P1D", "P1DT-2H", "PT100H"],
               on_error="null") == [None] * 8
    with pytest.raises(Exception, match="cannot convert Delay"):
        _ns(spark, ["1 days 02:00:00", "junk"], on_error="fail")


def test_interval_passthrough_and_delay_days(spark):
    df = spark.createDataFrame([(dt.timedelta(days=-1, hours=22),), (dt.timedelta(seconds=1.5),), (None,)],
                               "Delay interval day to second")
    out = normalize_delay(df).select("Delay", "delay_ns", delay_days(F.col("delay_ns")).alias("d")).collect()
    assert [r.delay_ns for r in out] == [-2 * H, 1_500_000_000, None]
    assert out[0].Delay == dt.timedelta(hours=-2)
    assert out[0].d == (-2 * H / 1e9) / 86400
    assert out[2].d is None


def test_numeric_default_is_nanoseconds(spark):
    df = spark.createDataFrame([(-3.5,), (5.0,), (None,), (float("nan"),)], "Delay double")
    out = normalize_delay(df).select("delay_ns", delay_days(F.col("delay_ns")).alias("d")).collect()
    assert [r.delay_ns for r in out] == [-3, 5, None, None]
    assert out[0].d < 0 < out[1].d and abs(out[0].d) < 1e-12


def test_numeric_days_unit(spark):
    df = spark.createDataFrame([(-3,), (5,), (None,)], "Delay int")
    out = normalize_delay(df, unit="D").select(delay_days(F.col("delay_ns")).alias("d")).collect()
    assert [r.d for r in out] == [-3.0, 5.0, None]


def test_unsupported_type_rejected(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, 1),)], "Delay timestamp")
    with pytest.raises(TypeError):
        normalize_delay(df)


def test_missing_column_is_noop(spark):
    df = spark.createDataFrame([(1,)], "x int")
    assert normalize_delay(df).columns == ["x"]


def test_text_round_trip(spark):
    secs = [-7200, 0, 86400, -3024000, 3023999, 1, None]
    df = spark.createDataFrame([(s,) for s in secs], "s long")
    text = df.select(format_seconds_as_text(F.col("s")).alias("Delay"))
    assert [r.Delay for r in text.collect()] == [
        "-1 days +22:00:00", "0 days 00:00:00", "1 days 00:00:00", "-35 days +00:00:00",
        "34 days 23:59:59", "0 days 00:00:01", None]
    back = normalize_delay(text).select("delay_ns").collect()
    assert [r.delay_ns for r in back] == [None if s is None else s * 10**9 for s in secs]
