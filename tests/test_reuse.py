"""Bucketed join, partials per file, quarantine, order bitmaps, totals without the product join."""

import random
import uuid
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from feira.operators import order_bitmaps as OB
from feira.operators import revenue as R
from feira.operators.joins import left_join_null_safe
from feira.plans.revenue_analyzer import RevenueAnalyzer, analyze_revenue_data
from feira.sources.bucketed import left_join_bucketed, save_bucketed
from feira.sources.partials import FilePartials
from feira.sources.readers import read_marked, read_orders, store_split


def two_sides(spark):
    r = random.Random(8)
    left = [(i, r.choice([None, *range(20)]), i / 2) for i in range(400)]
    right = [(k, f"c{k}{j}") for k in range(0, 20, 2) for j in range(1 + (k == 4))] + [(None, "n1"), (None, "n2")]
    return (spark.createDataFrame(left, "order_id long, product_id long, price double"),
            spark.createDataFrame(right, "product_id long, product_category_name string"))


def test_bucketed_join_needs_no_exchange(spark, tmp_path, capsys):
    left, right = two_sides(spark)
    name = f"t_{uuid.uuid4().hex}"
    a = save_bucketed(left, f"{name}_a", "product_id", 4, str(tmp_path / "a"))
    b = save_bucketed(right, f"{name}_b", "product_id", 4, str(tmp_path / "b"))
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = left_join_bucketed(a, b, "product_id")
        joined.explain()
        plan = capsys.readouterr().out
        assert "SortMergeJoin [product_id" in plan and "hashpartitioning(product_id" not in plan
        got = Counter(tuple(r) for r in joined.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
        spark.sql(f"DROP TABLE {name}_a")
        spark.sql(f"DROP TABLE {name}_b")
    assert got == Counter(tuple(r) for r in left_join_null_safe(left, right, "product_id").collect())
    assert sum(1 for r in got.elements() if r[1] is None) == 2 * left.filter("product_id IS NULL").count()
    with pytest.raises(ValueError):
        left_join_bucketed(left, right.withColumn("price", F.lit(1)), "product_id")


def test_totals_without_the_product_join(spark):
    left, right = two_sides(spark)
    items = left.select("order_id", F.lit(1).alias("order_item_id"), "product_id", (F.col("order_id") % 5).alias("seller_id"), "price",
                        F.lit(0.25).alias("freight_value"), F.current_timestamp().alias("shipping_limit_date"))
    products = right.select("product_id", "product_category_name", *[F.lit(1.0).alias(c) for c in R.DIMENSION_COLUMNS])
    for some in (products, products.filter("product_id > 4"), products.filter("false")):
        full, slim = R.prepare_data(items, some), R.items_as_joined(items, some)
        assert slim.columns == [*items.columns, "Total"]
        assert Counter(r.order_id for r in full.collect()) == Counter(r.order_id for r in slim.collect())
        assert R.vendor_revenue(full).collect() == R.vendor_revenue(slim).collect()
        assert R.revenue_kpis(full).collect() == R.revenue_kpis(slim).collect()


def test_partials_read_new_files_only(spark, tmp_path):
    data, read = tmp_path / "in", []

    def put(n, rows):
        spark.createDataFrame(rows, "k string, v long").coalesce(1).write.mode("append").parquet(str(data))

    def reader(paths):
        read.append(len(paths))
        return spark.read.parquet(*paths)

    store = FilePartials(spark, str(tmp_path / "store"), reader, lambda rows, f: rows.groupBy(f, "k").agg(F.sum("v").alias("v")))
    total = lambda: {r.k: r.v for r in store.rows(str(data)).groupBy("k").agg(F.sum("v").alias("v")).collect()}
    with pytest.raises(ValueError):
        store.rows(str(data))
    put(1, [("a", 1), ("b", 2), ("a", 3)])
    assert store.refresh(str(data)) == 1 and total() == {"a": 4, "b": 2}
    put(2, [("a", 10), ("c", 5)])
    assert store.refresh(str(data)) == 1 and store.refresh(str(data)) == 0 and read == [1, 1]
    assert total() == {"a": 14, "b": 2, "c": 5}
    spark.createDataFrame([("z", 7)], "k string, v long").coalesce(1).write.mode("overwrite").parquet(str(data))
    assert store.refresh(str(data)) == 1 and total() == {"z": 7}  # the files of before are gone


def test_quarantine_splits_every_row(spark, tmp_path):
    (tmp_path / "a.csv").write_text("order_id,Net_State,Delay,TOTAL,order_purchase_timestamp,A_PCT\n"
                                    "o1,Delivered,1 days,10.5,2020-03-08 02:30:00,5\no2,Delivered,,abc,2020-01-02,x\n")
    (tmp_path / "b.csv").write_text("order_id,Net_State,Delay,TOTAL,order_purchase_timestamp,A_PCT\n"
                                    "o3,NA,2h,7,not a date,1\no4,Delivered,1h,3,2020-01-01,2,9\no5,Delivered\no6,Delivered,1h,NaN,2020-01-01,\n")
    marked = read_marked(spark, str(tmp_path / "*.csv"), "orders")
    good, bad = store_split(marked, str(tmp_path / "split"))
    assert sorted(r.order_id for r in good.collect()) == ["o1", "o6"] and good.count() + bad.count() == marked.count() == 6
    why = {r.order_id: (r.reject_reason, r.source_file.rsplit("/", 1)[1]) for r in bad.collect()}
    assert why["o2"] == ("column TOTAL: not a double: abc; column A_PCT: not a double: x", "a.csv")
    assert why["o3"] == ("column order_purchase_timestamp: not a timestamp_ntz: not a date", "b.csv")
    assert why["o4"][0].startswith("not the header's number of fields") and why["o5"][0].startswith("not the header's number of fields")
    assert dict(good.dtypes)["order_purchase_timestamp"] == "timestamp_ntz" and good.columns == marked.drop("source_file", "reject_reason").columns


def test_dates_do_not_depend_on_the_session_zone(spark, tmp_path):
    (tmp_path / "o.csv").write_text("order_id,Net_State,Delay,order_purchase_timestamp\no1,Delivered,1 days,2020-03-08 02:30:00\n")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            rows = read_orders(spark, str(tmp_path / "o.csv"))
            assert rows.select(F.col("order_purchase_timestamp").cast("string")).first()[0] == "2020-03-08 02:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_bitmaps_count_repeated_orders_once(spark):
    r = random.Random(4)
    rows = [(r.choice(["SP", "RJ", None]), r.randrange(3), r.choice([None, *range(-50, 100_000, 7)])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "state string, day int, order_id long")
    first, second = df.filter("day < 2"), df.filter("day >= 1")
    keys = [F.col("state"), F.col("day")]
    table = OB.united(OB.order_bitmaps(first, keys), OB.order_bitmaps(second, keys))
    want, days = defaultdict(set), defaultdict(set)
    for s, d, o in rows:
        if o is not None:
            want[s].add(o)
            days[d].add(o)
    assert {x.state: x.orders for x in OB.distinct_orders(table, ["state"]).collect()} == {s: len(v) for s, v in want.items()}
    assert {x.day: x.orders for x in OB.distinct_orders(table, ["day"]).collect()} == {d: len(v) for d, v in days.items()}
    assert OB.distinct_orders(table, [], "n", F.col("day") == 1).first().n == len(days[1])


def test_nothing_stays_cached_without_persist(spark):
    left, right = two_sides(spark)
    items = left.select("order_id", F.lit(1).alias("order_item_id"), "product_id", F.lit(1).alias("seller_id"), "price",
                        F.lit(0.25).alias("freight_value"), F.current_timestamp().alias("shipping_limit_date"))
    products = right.select("product_id", "product_category_name", *[F.lit(1.0).alias(c) for c in R.DIMENSION_COLUMNS])
    held = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before = held()
    analyze_revenue_data(items, products)["vendor_revenue_all"].collect()
    assert held() == before
    analyzer = RevenueAnalyzer(items, products, persist=True)
    analyzer.run_comprehensive_analysis()["vendor_revenue_all"].collect()
    assert held() > before
    analyzer.release()
    assert held() == before
