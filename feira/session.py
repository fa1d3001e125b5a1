"""SparkSession settings the library is designed around.

On a cluster the session is normally created by the platform; call
``tune_session`` on it to apply the SQL settings. ``build_session`` is for
local runs and tests.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# SQL settings that matter for the plans in this library:
# * AQE re-plans at runtime: coalesces small shuffle partitions, turns a
#   sort-merge join into a broadcast join when a side turns out small, and
#   splits skewed join partitions (a hot product_id or the null-key group).
# * ANSI mode stays on (Spark 4 default): overflow and division by zero raise
#   instead of producing silent nulls; the library guards its divisions.
SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64MB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
}

# Static settings: only take effect when the session is created.
STATIC_SETTINGS = {
    # Driver-side only: skip capturing the Python call site for every column
    # function (used to decorate error messages); it made building a query
    # plan ~10x slower than executing it at small scale.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # a dashboard runs dozens of distinct plans; keep their generated
    # classes instead of recompiling them (default cache: 100 entries)
    "spark.sql.codegen.cache.maxEntries": "2000",
}


def tune_session(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings to an existing session (static ones,
    ``STATIC_SETTINGS``, belong in the session builder)."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "feira") -> SparkSession:
    """Local session: UI off, AQE on, shuffle partitions sized to the cores."""
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    master = master or f"local[{cpus}]"
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
    )
    for key, value in {**SQL_SETTINGS, **STATIC_SETTINGS}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory of the session.

    A cluster names a shared folder in ``spark.checkpoint.dir``; that one is
    used as is. Only a local-mode session (tests, local runs) gets a fresh
    scratch folder when it is unset; on a cluster an unset directory is an
    error, never a machine-local folder.
    """
    configured = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS/S3) for this cluster")
    local = tempfile.mkdtemp(prefix="feira-ckpt-")
    spark.sparkContext.setCheckpointDir(local)
    return local
