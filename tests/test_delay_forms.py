"""Free-form Delay text against pd.to_timedelta, and what it rejects."""

import random
import warnings

import pandas as pd
import pytest

from feira.functions.delay import normalize_delay

FORMS = ["100:00:00", "2:3:4", "1 days 1:2:3", "1d 2:03:04", "10 hours 2:00:00", "2h1d", "+1h", "00:00:00.1234567891", "-1d2h",
         "1d+2h", "+ 1d", "- 1d", "-+1d", "+-1d", "1,5h", "1h 1h", "1:60:75", "2:00:00 1d", "-1d 2h 3:00:00", "1.h", "1..5h", "12 34 h",
         "1 Day", "1day2hours", "1 days 02:00:00 x", "-1 days, 1:00:00", "1 days+1:00:00", "-0 days 1:00:00", "1 days 24:00:00", "1 T",
         "3 L", "3 U", "3 N", "5 min", "4 hr", "2 sec", "7 milli", "7 micros", "7 µs", "7 nanos", "-106751 days", "P1W", "P1DT2H3M4.5S",
         "-P-1D", "1.23456789s", "0.5ns", "1.5ns"]
REJECTED = ["5 mins", "4 hrs", "2 secs", "2 weeks", "None", "none", "null", "1 M", "1y", "1 month", "1 day 2", "1 day 2:00", "1:2", "1:2:3:4",
            "1d -2h", "1 days -1:00:00", "3.0", "3.5", ".5h", "1e3s", "d", "1d2", "1\td", "foo", "-", "P", "106752 days",
            "99999999999999999999", "12:34:56.7 days", "|", "#|1"]


def parsed(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, Delay string")
    return [r.delay_ns for r in normalize_delay(df, on_error="null").orderBy("i").collect()]


def reference(text):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return pd.to_timedelta(text).value


def test_forms_that_pandas_reads(spark):
    assert parsed(spark, FORMS) == [reference(t) for t in FORMS]


def test_forms_that_pandas_rejects_are_malformed(spark):
    for text in REJECTED:
        with pytest.raises(Exception):
            reference(text)
    assert parsed(spark, REJECTED) == [None] * len(REJECTED)
    for text in ("5 mins", "106752 days", "1 days -1:00:00"):
        with pytest.raises(Exception, match="cannot convert Delay"):
            normalize_delay(spark.createDataFrame([(text,)], "Delay string")).collect()


def test_random_parts_in_any_order(spark):
    """Whole-number parts are exact; pandas cuts a float product for fractions, so they may differ by one nanosecond a part."""
    r, texts = random.Random(17), []
    units = ["w", "W", "d", "days", "h", "hours", "m", "min", "s", "sec", "ms", "us", "ns", "mins", "M"]
    for _ in range(1500):
        parts = []
        for _ in range(r.randrange(1, 4)):
            number = str(r.randrange(400)) if r.random() < 0.7 else f"{r.randrange(50)}.{r.randrange(9999)}"
            parts.append(number + r.choice(["", " "]) + r.choice(units))
        if r.random() < 0.4:
            parts.append(f"{r.randrange(130)}:{r.randrange(60)}:{r.randrange(60):02d}")
        texts.append(r.choice(["", "-", "+", "- "]) + r.choice([" ", ", "]).join(parts))
    for text, got in zip(texts, parsed(spark, texts)):
        try:
            want = reference(text)
        except ValueError:
            want = None
        if want is None or "." not in text:
            assert got == want, text
        else:
            assert abs(got - want) <= text.count("."), text
