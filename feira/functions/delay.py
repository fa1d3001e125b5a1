"""``Delay`` normalisation: text, interval or number -> exact nanoseconds.

The analyses receive ``Delay`` as a signed duration (negative = late) in
whatever form the upstream cleaning produced: a pandas ``timedelta`` (an
interval here), pandas' or Python's text form (``-8 days +07:32:10``,
``-1 day, 22:00:00``), ISO 8601 (``P1DT2H``), number + unit text in any order
(``2h1d``, ``10 hours 2:00:00``) or a plain number. ``normalize_delay`` turns each form into
``delay_ns`` (bigint, exact, pandas' own unit) and a ``Delay`` day-time
interval (microseconds, truncated toward zero). Lateness is classified from
``delay_ns`` so sub-microsecond numeric delays keep their sign.

Everything is a JVM-side column expression (regex extraction + integer
arithmetic); no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NS_PER_SECOND = 1_000_000_000
NS_PER_DAY = 86_400 * NS_PER_SECOND
UNIT_NS = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": NS_PER_SECOND,
           "m": 60 * NS_PER_SECOND, "h": 3_600 * NS_PER_SECOND, "D": NS_PER_DAY}

# pandas' own str(Timedelta) layout, by far the common input: parsed with
# fixed-position substrings after one match. The sign belongs to the days only
# ("-1 days +22:00:00" is -2 hours).
STRICT_PANDAS = r"^-?\d{1,5} days \+?\d{2}:\d{2}:\d{2}(\.\d{1,9})?$"
# ISO 8601 duration as pandas reads it: a leading "-" negates everything; a
# sign right after "P" (or "PT") belongs to the first component only
# ("P-1DT2H" is -22 hours, pandas' own isoformat() of negative durations);
# weeks allowed; hours and minutes at most two digits.
ISO_FORM = (r"(-?)P([+-]?)(?:(\d{1,5})W)?(?:(\d{1,6})D)?(?:T([+-]?))?"
            r"(?:(\d{1,2})H)?(?:(\d{1,2})M)?(?:(\d{1,9})(?:\.(\d{1,9}))?S)?")
_MARK = "#"
_ISO_LAYOUT = _MARK + "|" + "|".join(f"${i}" for i in range(1, 10))

# Free form, after blanks, commas and plus signs (which mean nothing) are
# taken out: an optional leading minus, any number of number + unit parts in any
# order, and at most one clock, at the end; letters after a clock are ignored.
# The minus applies to every part, but to the clock only if it stands alone.
_NUMBER = r"\d+(?:\.+\d*)?"
_LETTERS = "[A-Za-z\u00b5]"
_CLOCK = r"\d{1,9}:\d{1,9}:\d{1,9}(?:\.\d+)?"
FREE_FORM = rf"^-?(?:{_NUMBER}{_LETTERS}+)*(?:\d{{1,9}}:\d{{1,9}}:\d{{1,9}}(?:\.\d+|{_LETTERS}*))?$"
INTEGER_FORM = r"^-?\d{1,19}$"
# The words for a unit, in any case ("M" alone would be months).
UNIT_WORDS = {
    "w": ["w"],
    "D": ["d", "day", "days"],
    "h": ["h", "hr", "hour", "hours"],
    "m": ["m", "t", "min", "minute", "minutes"],
    "s": ["s", "sec", "second", "seconds"],
    "ms": ["ms", "l", "milli", "millis", "millisecond", "milliseconds"],
    "us": ["us", "\u00b5s", "u", "micro", "micros", "microsecond", "microseconds"],
    "ns": ["ns", "n", "nano", "nanos", "nanosecond", "nanoseconds"],
}
# Text that means no duration.
NULL_TEXTS = ["", "NaT", "nat", "NAT", "nan", "NaN", "NAN"]
_ROUNDED = ["s", "ms", "us"]  # units whose parts are rounded to a whole nanosecond; the others are cut
_TOTAL = "decimal(38,0)"


def _int(g: Column) -> Column:
    return F.when(g == "", F.lit(0).cast("long")).otherwise(g.cast("long"))


def _frac_ns(g: Column) -> Column:
    """Digits after the point as nanoseconds; digits beyond the ninth are cut."""
    return F.when(g == "", F.lit(0).cast("long")).otherwise(F.rpad(F.substring(g, 1, 9), 9, "0").cast("long"))


def _strict_ns(t: Column) -> Column:
    """``[-]D days [+]HH:MM:SS[.f]`` by fixed positions; the sign belongs to the days."""
    days = F.substring_index(t, " ", 1).cast("long")
    clock = F.substring_index(t, " ", -1)
    clock = F.when(clock.startswith("+"), F.substring(clock, 2, 64)).otherwise(clock)
    hms = ((F.substring(clock, 1, 2).cast("long") * 60 + F.substring(clock, 4, 2).cast("long")) * 60
           + F.substring(clock, 7, 2).cast("long")) * NS_PER_SECOND
    return days * NS_PER_DAY + hms + _frac_ns(F.substring(clock, 10, 9))


def _iso_ns(g: Column) -> Column:
    """From the groups of ISO_FORM (item 0 is the marker); null if they make no duration."""
    grp = lambda i: g.getItem(i)
    present = lambda i: grp(i) != ""
    date, time = present(3) | present(4), present(6) | present(7) | present(8)
    valid = ((date | time) & (~present(2) | date)      # a sign after P needs a date component
             & (~present(5) | (~date & time)))         # a sign after T only on the first component
    scaled = lambda i, ns: (_int(grp(i)).cast(_TOTAL) * ns).cast(_TOTAL)
    parts = [scaled(3, 7 * NS_PER_DAY), scaled(4, NS_PER_DAY), scaled(6, 3600 * NS_PER_SECOND), scaled(7, 60 * NS_PER_SECOND),
             scaled(8, NS_PER_SECOND) + _frac_ns(grp(9)).cast(_TOTAL)]
    first = (F.when(present(3), parts[0]).when(present(4), parts[1]).when(present(6), parts[2])
             .when(present(7), parts[3]).otherwise(parts[4]))
    total = parts[0] + parts[1] + parts[2] + parts[3] + parts[4]
    signed = F.when((grp(2) == "-") | (grp(5) == "-"), total - 2 * first).otherwise(total)  # only the first flips
    return F.when(valid, F.when(grp(1) == "-", -signed).otherwise(signed).cast(_TOTAL))


def _units() -> Column:
    """Unit word -> (nanoseconds, whether its parts are rounded)."""
    entries = []
    for unit, names in UNIT_WORDS.items():
        ns = 7 * NS_PER_DAY if unit == "w" else UNIT_NS[unit]
        for name in names:
            entries += [F.lit(name), F.struct(F.lit(ns).cast("decimal(16,0)").alias("ns"), F.lit(unit in _ROUNDED).alias("round"))]
    return F.create_map(*entries)


def _part_ns(number: Column, word: Column) -> Column:
    """One number + unit part in whole nanoseconds; null if the unit is unknown or the part is out of range."""
    unit = F.when(word != "M", F.try_element_at(_units(), F.lower(word)))
    n = F.regexp_replace(number, r"\.+", ".").try_cast("decimal(38,12)")
    near = n.cast("double") * unit["ns"].cast("double")
    exact = n * unit["ns"]
    return F.when(near < 1e19, F.when(unit["round"], F.round(exact, 0)).otherwise(F.floor(exact)).cast(_TOTAL))


def _free_ns(u: Column) -> Column:
    """Sum of the parts of a text in free form (``u``: without blanks, commas and plus signs)."""
    one = rf"({_NUMBER})({_LETTERS}+)"
    parts = F.regexp_extract(u, rf"^-?((?:{_NUMBER}{_LETTERS}+)*)", 1)
    each = F.zip_with(F.regexp_extract_all(parts, F.lit(one), 1), F.regexp_extract_all(parts, F.lit(one), 2), _part_ns)
    total = F.aggregate(each, F.lit(0).cast(_TOTAL), lambda acc, x: (acc + x).cast(_TOTAL))
    clock = F.split(F.regexp_extract(u, rf"({_CLOCK}){_LETTERS}*$", 1), "[:.]")
    item = lambda i: F.coalesce(F.try_element_at(clock, F.lit(i)), F.lit(""))
    seconds = (_int(item(1)) * 60 + _int(item(2))) * 60 + _int(item(3))
    clock_ns = (seconds.cast("decimal(20,0)") * NS_PER_SECOND).cast(_TOTAL) + _frac_ns(item(4)).cast(_TOTAL)
    minus = u.startswith("-")
    signed_parts = F.when(minus, -total).otherwise(total)
    signed_clock = F.when(minus & (parts == ""), -clock_ns).otherwise(clock_ns)
    return (signed_parts + signed_clock).cast(_TOTAL)


def _parse_stage(text: Column) -> Column:
    """struct(t, strict, iso, free): trimmed text; whether it has pandas'
    exact str(Timedelta) layout; otherwise the groups of an ISO duration, or
    the text without blanks, commas and plus signs if it has the free form."""
    t = F.trim(text)
    strict = F.coalesce(t.rlike(STRICT_PANDAS), F.lit(False))
    is_iso = t.rlike("^-?P")
    laid_out = F.regexp_replace(t, f"^{ISO_FORM}$", _ISO_LAYOUT)
    iso = F.when(~t.contains("|") & laid_out.startswith(_MARK + "|"), F.split(laid_out, r"\|", -1))
    bare = F.regexp_replace(t, "[ ,+]", "")
    free = F.when(bare.rlike(FREE_FORM) | bare.rlike(INTEGER_FORM), F.when(bare.rlike("[0-9]"), bare))
    return F.struct(t.alias("t"), strict.alias("strict"), F.when(~strict & is_iso, iso).alias("iso"),
                    F.when(~strict & ~is_iso, free).alias("free"))


def _ns_from_stage(s: Column) -> Column:
    """Nanoseconds; null for a text that means none and for a malformed one."""
    t, free = s.getField("t"), s.getField("free")
    total = (F.when(s.getField("iso").isNotNull(), _iso_ns(s.getField("iso")))
             .when(free.rlike(INTEGER_FORM), free.try_cast(_TOTAL))
             .when(free.isNotNull(), _free_ns(free)))
    return F.when(s.getField("strict"), _strict_ns(t)).when(~t.isin(NULL_TEXTS), total.try_cast("long"))


def _malformed(text: Column, ns: Column) -> Column:
    return text.isNotNull() & ~F.trim(text).isin(NULL_TEXTS) & ns.isNull()


def parse_delay_text(text: Column) -> tuple[Column, Column]:
    """Return ``(ns, malformed)`` for a text column.

    ``ns`` is null for null / empty / ``NaT`` text and for malformed text;
    ``malformed`` is true only for non-empty text of no accepted form or beyond
    the range of nanoseconds in a long (about 292 years). ``normalize_delay``
    evaluates the parse once per row; used directly this is still correct.
    """
    ns = _ns_from_stage(_parse_stage(text))
    return ns, _malformed(text, ns)


def interval_to_ns(c: Column) -> Column:
    return (c.cast("decimal(20,6)") * F.lit(NS_PER_SECOND)).cast("long")


def ns_to_interval(ns: Column) -> Column:
    """Day-time interval with the nanoseconds truncated toward zero to µs."""
    # exact decimal division, then the cast truncates toward zero
    micros = (ns.cast("decimal(20,0)") / F.lit(1000)).cast("long")
    return micros * F.expr("INTERVAL '0.000001' SECOND")


def numeric_to_ns(c: Column, dtype: T.DataType, unit: str) -> Column:
    if unit not in UNIT_NS:
        raise ValueError(f"unknown unit {unit!r}; expected one of {sorted(UNIT_NS)}")
    factor = UNIT_NS[unit]
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        c = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
        if factor == 1:
            return c.cast("long")
        return (c.cast("decimal(38,9)") * F.lit(factor)).cast("long")
    if isinstance(dtype, T.DecimalType):
        return (c * F.lit(factor)).cast("long")
    return c.cast("long") * F.lit(factor)


def delay_days(ns: Column) -> Column:
    """pandas ``total_seconds() / 86400``: (ns / 1e9) / 86400 in double."""
    return (ns.cast("double") / F.lit(1e9)) / F.lit(86400.0)


def normalize_delay(df: DataFrame, column: str = "Delay", unit: str = "ns",
                    on_error: str = "fail") -> DataFrame:
    """Add ``delay_ns`` and replace ``column`` by a day-time interval.

    ``unit`` applies to numeric input (default ``'ns'``, pandas' reading of a
    bare number; ``'D'`` reads numbers as days). ``on_error='fail'`` raises on
    the first malformed text value, ``'null'`` turns it into null (pandas'
    ``errors='coerce'``). A frame without ``column`` is returned unchanged.
    """
    if on_error not in ("fail", "null"):
        raise ValueError("on_error must be 'fail' or 'null'")
    if column not in df.columns:
        return df
    dtype = df.schema[column].dataType
    c = F.col(column)
    if isinstance(dtype, T.DayTimeIntervalType):
        ns = interval_to_ns(c)
    elif isinstance(dtype, T.StringType):
        # The regex work runs in its own projection, and ``delay_ns`` is
        # bound once per row behind a one-element ``inline``: a filter on
        # ``delay_ns`` downstream is then evaluated on the bound value instead
        # of being pushed below and re-expanding the whole parse at every reference.
        df = df.withColumn("_delay_parse", _parse_stage(c))
        ns = _ns_from_stage(F.col("_delay_parse"))
        bound = df.select("*", F.inline(F.array(F.struct(ns.cast("long").alias("delay_ns"))))).drop("_delay_parse")
        if on_error == "fail":
            bound = bound.withColumn("delay_ns", F.when(_malformed(c, F.col("delay_ns")), F.raise_error(
                F.concat(F.lit(f"cannot convert {column} to a duration: "), c))).otherwise(F.col("delay_ns")))
        return bound.withColumn(column, ns_to_interval(F.col("delay_ns")))
    elif isinstance(dtype, T.NumericType):
        ns = numeric_to_ns(c, dtype, unit)
    else:
        raise TypeError(f"{column} has type {dtype.simpleString()}; expected a duration, text or number")
    return (df.withColumn("delay_ns", ns.cast("long"))
              .withColumn(column, ns_to_interval(F.col("delay_ns"))))


def format_seconds_as_text(seconds: Column) -> Column:
    """pandas' ``str(Timedelta)`` for whole seconds: ``-1 days +22:00:00``."""
    rem = F.pmod(seconds, F.lit(86400))
    days = ((seconds - rem) / 86400).cast("long")
    hh = F.lpad((rem / 3600).cast("long").cast("string"), 2, "0")
    mm = F.lpad(((rem % 3600) / 60).cast("long").cast("string"), 2, "0")
    ss = F.lpad((rem % 60).cast("string"), 2, "0")
    sign = F.when(seconds < 0, F.lit("+")).otherwise(F.lit(""))
    return F.when(seconds.isNull(), F.lit(None).cast("string")).otherwise(
        F.concat(days.cast("string"), F.lit(" days "), sign, hh, F.lit(":"), mm, F.lit(":"), ss))
