"""Small relational operators: distinct rows, dictionary codes, value bounds, sorted edge layouts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.files import stored


def distinct_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct values of the columns; compared exactly."""
    return df.select(*columns).distinct()


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("cardinality"))


def dictionary_encode(df: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Replace string columns by order-preserving codes; returns the coded rows and the dictionary (value, code).

    Codes are global ranks. They come from a range partitioning by value: the rank within a partition plus the number
    of values in the partitions before it, so no task sees the whole dictionary. The partitioned values are stored first:
    ranks and counts then see the same partitions, whatever the plan reuses.
    """
    values = reduce(DataFrame.unionByName, [df.select(F.col(c).alias("value")) for c in columns]).where("value IS NOT NULL").distinct()
    ranged = stored(values.repartitionByRange("value").sortWithinPartitions("value").select("value", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    firsts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = firsts.alias("a").join(firsts.alias("b"), F.col("b.part") < F.col("a.part"), "left").groupBy("a.part").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"), F.first("a.first").alias("first"))
    dictionary = ranged.join(before, "part").select("value", (F.col("at") - F.col("first") + F.col("before")).cast("int").alias("code"))
    coded = df
    for c in columns:
        pairs = dictionary.select(F.col("value").alias(f"__{c}"), F.col("code").alias(f"__{c}_code"))
        coded = coded.join(pairs, F.col(c) == F.col(f"__{c}"), "left").withColumn(c, F.col(f"__{c}_code")).drop(f"__{c}", f"__{c}_code")
    return coded, dictionary


def value_bounds(frames: list[tuple[DataFrame, str]]) -> tuple | None:
    """Largest minimum and smallest maximum of a join attribute over its relations, or None if one is empty."""
    found = [df.agg(F.min(c), F.max(c)).first() for df, c in frames]
    if any(low is None for low, _ in found):
        return None
    return max(low for low, _ in found), min(high for _, high in found)


def sorted_edges(edges: DataFrame, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The edge relation laid out by source and by target: co-partitioned and sorted for merge joins."""
    split = (partitions,) if partitions else ()
    return (
        edges.repartition(*split, "sid").sortWithinPartitions("sid", "tid"),
        edges.repartition(*split, "tid").sortWithinPartitions("tid", "sid"),
    )
