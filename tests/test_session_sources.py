"""Session helpers and small source/sink helpers."""

import pytest

from feira.session import SQL_SETTINGS, ensure_checkpoint_dir, tune_session
from feira.sources.readers import read_orders
from feira.sources.sinks import export_parquet, persisted


class _Ctx:
    def __init__(self, master, ckpt=None):
        self.master, self._ckpt, self.set_to = master, ckpt, None

    def getCheckpointDir(self):
        return self._ckpt

    def setCheckpointDir(self, d):
        self.set_to = d


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _Session:
    def __init__(self, master, ckpt=None, conf=None):
        self.sparkContext, self.conf = _Ctx(master, ckpt), _Conf(conf or {})


def test_checkpoint_dir_rules():
    # a configured shared folder is used as is
    s = _Session("spark://cluster:7077", conf={"spark.checkpoint.dir": "hdfs:///shared/ckpt"})
    assert ensure_checkpoint_dir(s) == "hdfs:///shared/ckpt" and s.sparkContext.set_to == "hdfs:///shared/ckpt"
    # never a machine-local folder on a cluster
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(_Session("spark://cluster:7077"))
    # local mode may get a scratch folder
    local = _Session("local[2]")
    assert ensure_checkpoint_dir(local) == local.sparkContext.set_to


def test_tune_session_applies_sql_settings(spark):
    saved = {k: spark.conf.get(k, None) for k in SQL_SETTINGS}
    try:
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
        tune_session(spark)
        assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"
    finally:
        for k, v in saved.items():
            if v is not None:
                spark.conf.set(k, v)


def test_parquet_reader_and_persisted(spark, tmp_path):
    src = spark.createDataFrame([("1", "SP", "Delivered", "-1 days +20:00:00", "12.5", "3.0", "x")],
                                "order_id string, customer_state string, Net_State string, Delay string, "
                                "TOTAL string, Stage_PCT string, note string")
    export_parquet(src, str(tmp_path / "orders"))
    orders = read_orders(spark, str(tmp_path / "orders"), fmt="parquet")
    types = dict(orders.dtypes)
    assert types["TOTAL"] == "double" and types["Stage_PCT"] == "double" and types["note"] == "string"
    with persisted(orders) as kept:
        assert kept.is_cached and kept.count() == 1
    assert not orders.is_cached


def test_readers_name_bad_values_and_know_null_words(spark, tmp_path):
    import pytest

    from feira.sources import readers

    path = str(tmp_path / "orders")
    rows = [("1", "NA", "1,000.5", "01/02/2020 10:00"), ("2", "SP", "7.5", "2020-01-02 10:00:00"), ("3", "RJ", "n/a", "")]
    spark.createDataFrame(rows, "order_id string, customer_state string, TOTAL string, order_purchase_timestamp string") \
        .write.option("header", True).csv(path)
    with pytest.raises(Exception, match="column TOTAL: not a double: 1,000.5|column order_purchase_timestamp: not a timestamp: 01/02"):
        readers.read_orders(spark, path).collect()
    got = {r.order_id: r for r in readers.read_orders(spark, path, on_error="null").collect()}
    assert got["1"].customer_state is None and got["1"].TOTAL is None and got["2"].TOTAL == 7.5 and got["3"].TOTAL is None
    raw = readers._read(spark, path, "csv")
    assert readers.rejected(raw, {"TOTAL": "double", "order_purchase_timestamp": "timestamp"}).first() == (1, 1)


def test_sums_keep_small_values(spark):
    from pyspark.sql import functions as F

    from feira.functions.numeric import exact_sum

    df = spark.createDataFrame([("a", 0.00004), ("a", 0.00004), ("b", 0.12345), ("c", None), ("d", float("nan"))], "k string, v double")
    got = {r.k: r.s for r in df.groupBy("k").agg(exact_sum("v").alias("s")).collect()}
    assert got == {"a": 0.00008, "b": 0.12345, "c": 0.0, "d": 0.0}
    assert df.limit(0).agg(exact_sum(F.col("v")).alias("s")).first().s == 0.0
