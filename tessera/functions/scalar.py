"""Column helpers for semantics in which the engine's SQL differs from Spark's defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Integral types from narrow to wide.
INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def wider(left: str, right: str) -> str | None:
    """The common integral type of two type names, or None if one of them is not integral."""
    if left in INTEGRAL and right in INTEGRAL:
        return INTEGRAL[max(INTEGRAL.index(left), INTEGRAL.index(right))]
    return None


def divide(df: DataFrame, left: Column, right: Column) -> Column:
    """``left / right``: truncating toward zero between integral operands, double division otherwise."""
    a, b = (f.dataType.simpleString() for f in df.select(left.alias("l"), right.alias("r")).schema)
    kind = wider(a, b)
    if kind is None:
        return left.cast("double") / right.cast("double")
    # the difference is a multiple of the divisor, so the quotient is exact in the wide decimal type
    exact = (left - left % right).cast("decimal(20,0)") / right.cast("decimal(20,0)")
    return exact.cast(kind)


def nulls_ordered(column: Column, ascending: bool = True) -> Column:
    """Sort key with nulls last when ascending and first when descending."""
    return column.asc_nulls_last() if ascending else column.desc_nulls_first()


def format_value(column: Column, kind: T.DataType) -> Column:
    """Printed form of a value: ``[null]`` for null, ``N years M months`` for year-month intervals, ISO 8601 with hours,
    minutes and seconds for day-time intervals."""
    if isinstance(kind, T.YearMonthIntervalType):
        months = column.cast("interval month").cast("int")
        years = (months - months % 12) / 12
        text = F.concat_ws(" ", years.cast("int").cast("string"), F.lit("years"), (months % 12).cast("string"), F.lit("months"))
        text = F.when(column.isNotNull(), text)
    elif isinstance(kind, T.DayTimeIntervalType):
        total = column.cast("interval second").cast("decimal(18,6)")
        whole = (total - total % 60).cast("bigint")
        hours, minutes = (whole - whole % 3600) / 3600, (whole % 3600) / 60
        seconds = F.regexp_replace((total % 60).cast("decimal(18,6)").cast("string"), r"\.?0+$", "")
        parts = [F.when(x != 0, F.concat(n, F.lit(unit))).otherwise("") for x, n, unit in ((hours, hours.cast("bigint").cast("string"), "H"), (minutes, minutes.cast("bigint").cast("string"), "M"), (total % 60, seconds, "S"))]
        text = F.when(column.isNotNull(), F.when(total == 0, F.lit("PT0S")).otherwise(F.concat(F.lit("PT"), *parts)))
    else:
        text = column.cast("string")
    return F.coalesce(text, F.lit("[null]"))


def register_functions(spark: SparkSession) -> None:
    """The one user function: equality of two integers, as SQL, so that it is inlined into the plan."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION int_equals(a INT, b INT) RETURNS BOOLEAN RETURN a = b")
