"""File sources and sinks. Everything is read and written by Spark, so that any store it knows will do."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def open_tables(spark: SparkSession, directory: str, names: tuple[str, ...] = TABLES[:8]) -> None:
    """Register Parquet tables of a directory as temporary views; nothing is read yet."""
    for name in names:
        read_native(spark, f"{directory}/{name}.parquet").createOrReplaceTempView(name)


def stored(df: DataFrame) -> DataFrame:
    """The rows as they are now, every column evaluated, in the checkpoint folder; one of its own only where none is set."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return df.checkpoint()


def load_csv(spark: SparkSession, path: str, schema: T.StructType, separator: str = ",", null_token: str = "NULL") -> DataFrame:
    """Positional columns without a header; empty fields and the null token are null; a malformed field fails the read of
    its column (``Engine.load`` reads all).

    Quoted empty strings count as null too, which Spark's reader alone would keep as ''.
    """
    raw = (
        spark.read.schema(schema).option("sep", separator).option("nullValue", null_token).option("mode", "FAILFAST").option("header", False)
        .option("dateFormat", "yyyy-MM-dd").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    )
    columns = [F.when((F.col(f.name) != "") & (F.col(f.name) != null_token), F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in schema]
    return raw.select(*columns)


def write_csv(df: DataFrame, path: str, separator: str = ",", null_token: str = "NULL") -> None:
    df.write.mode("overwrite").option("sep", separator).option("nullValue", null_token).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)


def read_native(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def store_native(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def copy_table(df: DataFrame, path: str, rows: int | None = None) -> None:
    """Copy a table, cut to a number of rows if one is given."""
    store_native(df if rows is None else df.limit(rows), path)
