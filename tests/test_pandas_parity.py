"""Semantics on randomized inputs: against pandas itself where a function of it
defines them (``pd.cut``, ``pd.to_timedelta``), else counted row by row from
the written rules (heat map, daily trend, geo feed, revenue, delivery)."""

import datetime as dt
import math
import re
from collections import Counter

import numpy as np
import pytest
import pandas as pd
from pyspark.sql import functions as F

from feira.functions.bins import PCT_EDGES, edges_from_ranges, pct_labels, range_labels, right_closed_bin
from feira.functions.delay import normalize_delay
from feira.operators.heatmap import heatmap_grid
from feira.operators.trend import daily_trend

RANGES = [(-30, -20), (-20, -10), (-10, -5), (-5, -2), (-2, 0)]


def _values(rng, edges, n=3000):
    lo, hi = edges[0], edges[-1]
    span = hi - lo
    vals = list(rng.uniform(lo - 0.2 * span, hi + 0.2 * span, n))
    vals += [float(e) for e in edges] + [np.nextafter(float(e), np.inf) for e in edges]
    vals += [np.nextafter(float(e), -np.inf) for e in edges] + [None, float("nan")]
    return vals


def test_right_closed_bin_equals_pd_cut(spark):
    rng = np.random.default_rng(11)
    for edges in (edges_from_ranges(RANGES), PCT_EDGES, [0.5, 0.75, 3.0]):
        vals = _values(rng, edges)
        df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(vals)],
                                   "i int, v double")
        got = [r.b for r in df.orderBy("i").select(right_closed_bin(F.col("v"), edges).alias("b")).collect()]
        want = pd.cut(pd.Series(vals, dtype="float64"), bins=edges, labels=False, include_lowest=True)
        want = [None if pd.isna(w) else int(w) for w in want]
        assert got == want, edges


def test_delay_text_equals_pd_to_timedelta(spark):
    rng = np.random.default_rng(12)
    ns = list(rng.integers(-40 * 86400 * 10**9, 40 * 86400 * 10**9, 1500))
    ns += list(rng.integers(-86400, 86400, 200) * 10**9) + [0, 1, -1, 86400 * 10**9, -86400 * 10**9]
    ns += list(rng.integers(-10**12, 10**12, 300) // 1000 * 1000)  # microsecond fractions
    texts = [str(pd.Timedelta(int(v))) for v in ns] + [pd.Timedelta(int(v)).isoformat() for v in ns[:300]]
    texts += ["02:00:00", "-02:00:00", "1 day", "3 days 04:00:00.5", "-1 days 22:00:00", "P1DT2H", "PT30M"]
    # Python's own timedelta text ("-1 day, 22:00:00", "0:00:05.500000")
    texts += [str(dt.timedelta(microseconds=int(v) // 1000)) for v in ns[:400]]
    # number + unit sequences in canonical order, with optional leading minus
    words = [("w", "w"), ("d", "days"), ("h", "hours"), ("m", "min"), ("s", "s"), ("ms", "ms"), ("us", "us"),
             ("ns", "ns")]
    for i in range(400):
        picks = [w for w in words if rng.random() < 0.4] or [words[1]]
        parts = []
        for short, long_ in picks:
            num = str(int(rng.integers(0, 50))) if short in ("ms", "us", "ns", "w") or rng.random() < 0.7 \
                else f"{rng.integers(0, 50)}.{rng.integers(0, 100):02d}"
            parts.append(num + (short if rng.random() < 0.5 else " " + long_))
        texts.append(("-" if rng.random() < 0.3 else "") + (" " if rng.random() < 0.5 else "").join(parts))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, Delay string")
    got = [r.delay_ns for r in normalize_delay(df).orderBy("i").select("delay_ns").collect()]
    want = [pd.to_timedelta(t).value for t in texts]
    for t, g, w in zip(texts, got, want):
        if re.search(r"\d\.\d+\s*(?:days|[dhm])", t):
            # fractional unit counts ("29.57 days"): pandas multiplies in
            # float and can be a few ns off; ours is exact decimal arithmetic
            assert abs(g - w) <= 1000, t
        else:
            assert g == w, t


def test_heatmap_counts_cell_by_cell(spark):
    rng = np.random.default_rng(13)
    n = 4000
    days = np.round(rng.uniform(-40, 0.5, n), 3)
    days[:40] = [-30, -20, -10, -5, -2, 0, -31, 0.25] * 5
    pct = np.round(rng.uniform(-5, 105, n), 1)
    pct[40:60] = [0, 10, 100, 100.0001, -0.0001] * 4
    pct[60:70] = np.nan
    late = spark.createDataFrame([(float(a), None if np.isnan(b) else float(b)) for a, b in zip(days, pct)],
                                 "delay_days double, Site_Real_PCT double")
    got = heatmap_grid(late).collect()
    # counted cell by cell: an interval holds its upper edge, the first one its lower edge too;
    # a column for every percentage interval, the last row for delays or percentages outside
    labels, tens = range_labels(RANGES), [(10 * k, 10 * k + 10) for k in range(10)]

    def place(value, intervals):
        inside = [i for i, (lo, hi) in enumerate(intervals) if lo < value <= hi or (i == 0 and value == lo)]
        return inside[0] if inside else None

    cells = Counter((place(a, RANGES), place(b, tens)) for a, b in zip(days, pct))
    got_rows = {r["delay_bin"]: [r[c] for c in pct_labels()] for r in got}
    assert len(got_rows) == len(got)
    for i, label in enumerate(labels):
        assert got_rows[label] == [cells[i, k] for k in range(10)], label
    outside = [cells[None, k] for k in range(10)]
    assert got_rows.get(None, [0] * 10) == outside
    assert [r["delay_bin"] for r in got][:5] == labels[::-1]


def test_rolling_mean_over_days_with_orders(spark):
    rng = np.random.default_rng(14)
    start = dt.datetime(2021, 1, 1)
    rows, oid = [], 0
    for d in sorted(rng.choice(400, 150, replace=False)):
        for _ in range(int(rng.integers(1, 9))):
            oid += 1
            rows.append((oid % 700, start + dt.timedelta(days=int(d), hours=int(rng.integers(0, 24)))))
    df = spark.createDataFrame(rows, "order_id long, order_purchase_timestamp timestamp")
    # the orders of a day as a set, the mean over the last days that have orders
    per_day = {}
    for order, at in rows:
        per_day.setdefault(at.date(), set()).add(order)
    days = sorted(per_day)
    counts = [len(per_day[d]) for d in days]
    for window in (1, 3, 7, 30):
        got = daily_trend(df, window=window).collect()
        assert [r.orders for r in got] == counts
        for i, r in enumerate(got):
            last = counts[max(0, i + 1 - window):i + 1]
            assert abs(r.orders_roll - sum(last) / len(last)) <= 1e-12, (window, days[i])


def test_geo_feed_equals_pandas(spark):
    from feira.operators.geo import geo_feed
    from feira.sources.states import STATES

    rng = np.random.default_rng(15)
    codes = [s[0] for s in STATES[:10]] + ["XX"]
    n = 3000
    pdf = pd.DataFrame({
        "order_id": rng.integers(0, 1200, n),
        "customer_state": rng.choice(codes, n),
        "Net_State": rng.choice(["Delivered", "Not_Delivered"], n),
        "Delay": [f"{int(d)} days" for d in rng.integers(-5, 5, n)],
        "TOTAL": np.round(rng.uniform(1, 500, n), 2),
    })
    orders = normalize_delay(spark.createDataFrame(pdf))
    centroids = {s: (lat, lon) for s, lat, lon, _ in STATES}
    for metric in ("orders", "revenue"):
        got = geo_feed(orders, metric, bubble_size_multiplier=1.5).toPandas()
        # row by row from the written rules: located states only, bubbles from 10 to 40, times the multiplier
        ids, money = {}, {}
        for oid, state, amount in zip(pdf["order_id"], pdf["customer_state"], pdf["TOTAL"]):
            if state in centroids:
                ids.setdefault(state, set()).add(oid)
                money[state] = money.get(state, 0.0) + amount
        want = {s: len(ids[s]) if metric == "orders" else money[s] for s in sorted(ids)}
        lo, hi = min(want.values()), max(want.values())
        assert list(got["state"]) == list(want)
        assert np.allclose(got["value"], list(want.values()), rtol=1e-12, atol=1e-6)
        sizes = [1.5 * (10 + 30 * (v - lo) / (hi - lo)) for v in want.values()]
        assert np.allclose(got["bubble_size"], sizes, rtol=1e-9)
        if metric == "orders":
            assert list(got["label"]) == [f"{s}<br>{v:,}" for s, v in want.items()]


def test_revenue_path_pair_by_pair(spark):
    from feira.operators import revenue as R

    rng = np.random.default_rng(16)
    n, m = 2000, 60
    pid = rng.integers(0, 80, n).astype(float)
    pid[rng.random(n) < 0.05] = np.nan                       # null product ids on the item side
    items = pd.DataFrame({
        "order_id": np.where(rng.random(n) < 0.03, np.nan, rng.integers(0, 500, n).astype(float)),
        "product_id": pid,
        "seller_id": np.where(rng.random(n) < 0.04, np.nan, rng.integers(0, 30, n).astype(float)),
        "price": np.round(rng.uniform(1, 900, n), 2),
        "freight_value": np.where(rng.random(n) < 0.05, np.nan, np.round(rng.uniform(0, 60, n), 2)),
    })
    ppid = rng.integers(0, 70, m).astype(float)              # duplicates fan out; ids 70-79 unmatched
    ppid[:2] = np.nan                                        # null keys on the product side too
    prods = pd.DataFrame({
        "product_id": ppid,
        "product_category_name": rng.choice(["a", "b", "c", None], m),
        "product_weight_g": np.where(rng.random(m) < 0.1, np.nan, rng.uniform(100, 900, m).round(0)),
        "product_length_cm": rng.uniform(10, 30, m).round(0),
        "product_height_cm": rng.uniform(5, 20, m).round(0),
        "product_width_cm": np.where(rng.random(m) < 0.1, np.nan, rng.uniform(5, 25, m).round(0)),
    })
    det = R.prepare_data(spark.createDataFrame(items), spark.createDataFrame(prods))

    # pair by pair from the written rules: an item meets every product with its id (no id meets no id),
    # one row without a product if there is none
    def rows_of(pdf):
        return [{c: None if pd.isna(v) else v for c, v in r.items()} for r in pdf.to_dict("records")]

    catalogue = {}
    for p in rows_of(prods):
        catalogue.setdefault(p["product_id"], []).append(p)
    nothing = dict.fromkeys(prods.columns)
    joined = [{**p, **i} for i in rows_of(items) for p in catalogue.get(i["product_id"], [nothing])]
    paid = [None if r["freight_value"] is None else r["price"] + r["freight_value"] for r in joined]
    assert det.count() == len(joined)

    per_order = {}
    for r, amount in zip(joined, paid):
        if r["order_id"] is not None:
            per_order.setdefault(r["order_id"], []).append(amount or 0.0)
    k = R.revenue_kpis(det).first()
    assert k.total_revenue == pytest.approx(math.fsum(a for a in paid if a is not None), rel=1e-12)
    assert k.total_orders == len(per_order) and k.total_products == len(joined)
    assert k.average_order_value == pytest.approx(math.fsum(map(math.fsum, per_order.values())) / len(per_order), rel=1e-12)

    for key in ("product_category_name", "seller_id"):
        for metric in ("Total", "freight_value", "price"):
            want = {}
            for r, amount in zip(joined, paid):
                group = r[key] or "Others" if key == "product_category_name" else r[key]
                if group is not None:
                    want.setdefault(group, []).append((amount if metric == "Total" else r[metric]) or 0.0)
            got = {r[key]: r.Total for r in R.revenue_by(det, key, metric).collect()}
            assert set(got) == set(want)
            assert all(abs(got[g] - math.fsum(v)) < 1e-6 for g, v in want.items())
    absent = Counter(c for r in joined for c in R.DIMENSION_COLUMNS if r[c] is None)
    assert {r.column_name: r.missing_count for r in R.missing_dimensional_data(det).collect()} == {
        c: absent[c] for c in R.DIMENSION_COLUMNS}
    complete = sum(all(r[c] is not None for c in R.DIMENSION_COLUMNS) for r in joined)
    assert R.volume_analysis_data(det).count() == complete


def test_delivery_kpis_equal_pandas(spark):
    from feira.operators import delivery as D
    from feira.operators import feeds as FD

    rng = np.random.default_rng(17)
    n = 3000
    ns = rng.integers(-20 * 86400, 20 * 86400, n) * 10**9
    ns[rng.random(n) < 0.05] = 0
    texts = [None if rng.random() < 0.04 else str(pd.Timedelta(int(v))) for v in ns]
    pdf = pd.DataFrame({"order_id": np.arange(n), "Delay": texts,
                        "Net_State": rng.choice(["Delivered", "Not_Delivered", "Other", None], n, p=[.55, .3, .1, .05])})
    perf = D.delivery_performance(normalize_delay(spark.createDataFrame(pdf)))
    k = perf.first()
    # counted row by row from the written rules: no Delay, no row; below zero is late, above is early
    seen = [(state, int(v)) for state, v, t in zip(pdf["Net_State"], ns, texts) if t is not None]

    def count(state=None, sign=None):
        return sum(1 for s, v in seen if (state is None or s == state) and (sign is None or v * sign > 0))

    total, delivered = count(), count("Delivered")
    late_in, early_in = count("Delivered", -1), count("Delivered", 1)
    assert (k.total_orders, k.delivered_orders, k.not_delivered_orders) == (total, delivered, count("Not_Delivered"))
    assert (k.delay_delivered, k.delay_not_delivered, k.no_delay_delivered, k.no_delay_not_delivered) == (
        late_in, count("Not_Delivered", -1), early_in, count("Not_Delivered", 1))
    assert k.delivery_rate == delivered / total * 100
    assert k.on_time_rate == early_in / delivered * 100
    chart = {r.category: r.pct for r in D.delivery_chart(perf, "delivered").collect()}
    both = early_in + late_in
    assert chart == {"No Delay": early_in / both * 100, "With Delay": late_in / both * 100}
    disp = FD.delivery_metrics_display(perf).first()
    assert disp.delivered_orders == f"{delivered:,} ({delivered / total * 100:.1f}%)"
