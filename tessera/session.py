"""Session settings shared by queries, tests and the benchmark."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that the semantics or the plans of this package rely on.
SEMANTICS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.cbo.enabled": "true",
    "spark.sql.cbo.joinReorder.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "tessera", master: str | None = None, partitions: int | None = None, **extra: str) -> SparkSession:
    """A session with the package's settings; ``master`` and ``partitions`` are left to the cluster when not given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in {**SEMANTICS, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_semantics(spark: SparkSession) -> SparkSession:
    """Set the run-time settings on a session that somebody else has built."""
    for key, value in SEMANTICS.items():
        spark.conf.set(key, value)
    return spark


def local_master(default: int = 8) -> str:
    return f"local[{os.environ.get('BENCH_CPUS', default)}]"
