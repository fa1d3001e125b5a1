"""Stage durations, heat maps of all stages, ranges as data, rate levels, rankings without a checkpoint."""

import datetime as dt
import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from feira.operators import extras as X
from feira.operators import stages as ST
from feira.operators.ranking import ranked_by

T0 = dt.datetime(2024, 1, 1)


def test_quantiles_of_seconds_are_exact(spark):
    r = random.Random(3)
    rows = [("a", r.choice([r.randrange(-70, 70), r.randrange(10 ** 7), -r.randrange(10 ** 9), 12345])) for _ in range(3000)]
    rows += [("b", 5)] * 2000 + [("c", -(2 ** 62)), ("c", 2 ** 62), ("c", 0)]
    got = {x.stage: x for x in ST.stage_quantiles(spark.createDataFrame(rows, "stage string, seconds long"), (0.1, 0.5, 0.99)).collect()}
    for stage in "abc":
        values = sorted(v for s, v in rows if s == stage)
        rank = lambda q: values[math.ceil(round(q * len(values), 9)) - 1]
        x = got[stage]
        assert (x.n, x.p10_seconds, x.p50_seconds, x.p99_seconds) == (len(values), rank(0.1), rank(0.5), rank(0.99))
        assert x.mean_seconds == pytest.approx(sum(values) / len(values))


def test_stages_need_both_times(spark):
    rows = [(T0, T0 + dt.timedelta(seconds=90), None), (T0, None, T0), (None, T0, T0 - dt.timedelta(days=1))]
    df = spark.createDataFrame(rows, "p timestamp_ntz, q timestamp_ntz, r timestamp_ntz")
    out = ST.stage_seconds(df, [("x", "p", "q"), ("y", "q", "r")])
    assert sorted((r.stage, r.seconds) for r in out.collect()) == [("x", 90), ("y", -86400)]
    assert ST.stage_quantiles(out.filter("false")).collect() == []
    with pytest.raises(ValueError):
        ST.stage_seconds(df, [])


def test_duration_buckets_never_decrease(spark):
    values = sorted({s * v for s in (-1, 1) for v in [*range(300), *(2 ** k + d for k in range(7, 62) for d in (-1, 0, 1))]})
    got = [r.b for r in spark.createDataFrame([(v,) for v in values], "v long").select("v", ST.duration_bucket(F.col("v")).alias("b"))
           .orderBy("v").collect()]
    assert got == sorted(got) and max(got) < 2 ** 13


def late(spark):
    rows = [(float(d), float(p), None if p > 90 else 100.0 - p, 5.0) for d, p in ((-29, 5), (-1, 95), (-7, 50), (-40, 20), (0, 0), (-5, 10))]
    return spark.createDataFrame(rows, "delay_days double, A_PCT double, B_PCT double, C_PCT double")


def test_one_scan_for_all_stages(spark, capsys):
    path = os.path.join(spark.sparkContext.getCheckpointDir().removeprefix("file:"), "late-stages")
    late(spark).write.mode("overwrite").parquet(path)
    grid = ST.stage_heatmaps(spark.read.parquet(path))
    grid.explain("formatted")
    plan = capsys.readouterr().out
    assert plan.count("Scan parquet") == 2  # in the tree and in its details
    cells = {(r.stage, r.delay_bin, r.pct_bin): r.orders for r in grid.collect()}
    assert len(cells) == 3 * 6 * 10 and sum(v for (s, _, _), v in cells.items() if s == "C_PCT") == 6
    assert cells[("A_PCT", "-2–0", "90–100 %")] == 1 and cells[("B_PCT", "-2–0", "90–100 %")] == 1
    assert cells[("A_PCT", None, "10–20 %")] == 1 and cells[("B_PCT", "-30–-20", "90–100 %")] == 1


def test_ranges_of_several_tenants(spark):
    rows = [("a", -10.0), ("a", -5.0), ("a", -0.5), ("a", 0.0), ("a", 1.0), ("b", -3.0), ("b", -1.0), ("b", None), ("c", -1.0), (None, -1.0)]
    df = spark.createDataFrame(rows, "tenant string, delay_days double")
    ranges = spark.createDataFrame([("a", -10.0, -5.0), ("a", -5.0, 0.0), ("b", -2.5, -1.0)], "range_set string, low double, high double")
    got = {(r.range_set, r.delay_bin): r.orders for r in ST.delay_bins_by_set(df, ranges, "tenant").collect()}
    assert got == {("a", "-10–-5"): 2, ("a", "-5–0"): 2, ("a", None): 1, ("b", "-2.5–-1"): 1, ("b", None): 2}
    for bad in ([("a", 0.0, -1.0)], [("a", -5.0, -1.0), ("a", -5.0, -1.0)]):
        with pytest.raises(Exception, match="ranges of a set"):
            ST.delay_bins_by_set(df, spark.createDataFrame(bad, "range_set string, low double, high double"), "tenant").collect()


def test_rate_levels_keep_nulls_of_the_data_apart(spark):
    rows = [("SP", T0, "Delivered", 5), ("SP", T0, "Not_Delivered", -1), (None, T0, "Delivered", -5), ("RJ", None, "Delivered", 0),
            ("RJ", T0 + dt.timedelta(days=40), None, 3), ("RJ", T0, "Delivered", None)]
    df = spark.createDataFrame(rows, "customer_state string, order_purchase_timestamp timestamp_ntz, Net_State string, delay_ns long")
    got = {(r.level, r.state, r.month): (r.orders, r.delivered, r.on_time_delivered) for r in ST.success_rate_levels(df).collect()}
    assert got[("all", None, None)] == (5, 3, 1)
    assert got[("state", None, None)] == (1, 1, 0) and got[("month", None, None)] == (1, 1, 0)
    assert got[("state_month", "RJ", None)] == (1, 1, 0) and got[("state", "SP", None)] == (2, 1, 1)
    assert Counter(level for level, _, _ in got) == {"all": 1, "state": 3, "month": 3, "state_month": 4}


@pytest.mark.parametrize("value, key", [("decimal(38,16)", "string"), ("long", "long")])
def test_ranks_from_a_histogram(spark, value, key):
    r = random.Random(len(value))
    keys = r.sample(range(-3000, 90_000), 2000)
    rows = [(str(k) if key == "string" else k, r.choice([0, 0, r.randrange(-5, 900), r.randrange(10 ** 9)])) for k in keys]
    df = spark.createDataFrame(rows, f"k {key}, v long").withColumn("v", F.col("v").cast(value))
    got = sorted(ranked_by(df, "v", "k").collect(), key=lambda x: x.position)
    want = sorted(rows, key=lambda x: (-x[1], x[0]))
    assert [(x.k, int(x.v)) for x in got] == want
    assert [x.position for x in got] == list(range(1, len(rows) + 1)) and {x.n_rows for x in got} == {len(rows)}
    running = 0
    for x, (_, v) in zip(got, want):
        running += v
        assert int(x.running_value) == running
    assert int(got[0].total_value) == running


def test_rankings_start_no_job_and_leave_no_folder(spark):
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    detailed = spark.createDataFrame([(k % 7, "c" + str(k % 3), k / 4) for k in range(100)],
                                     "seller_id long, product_category_name string, Total double")
    before = sorted(os.listdir(folder))
    spark.sparkContext.setJobGroup("ranking-plans", "none expected")
    frames = [X.vendor_segments(detailed), X.vendor_concentration(detailed), X.vendor_concentration_summary(detailed), X.category_share_rank(detailed)]
    assert spark.sparkContext.statusTracker().getJobIdsForGroup("ranking-plans") == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [f.count() for f in frames] == [7, 7, 1, 3] and sorted(os.listdir(folder)) == before
