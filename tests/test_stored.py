"""Rows that are kept as they were: dictionary codes, loads, SELECT INTO; and printed intervals."""

import pytest
from pyspark.sql import functions as F

from tessera.engine import Engine
from tessera.functions.scalar import format_value
from tessera.operators.relational import dictionary_encode


def test_codes_do_not_depend_on_reused_exchanges(spark):
    df = spark.range(30_000).select(F.sha2(F.col("id").cast("string"), 256).alias("s"))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        found = dictionary_encode(df, "s")[1].collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert [r.code for r in sorted(found, key=lambda r: r.value)] == list(range(30_000))


def test_a_malformed_field_fails_the_load(spark, tmp_path):
    (tmp_path / "t.csv").write_text("1,2\n3,x\n")
    engine = Engine(spark)
    engine.sql("CREATE TABLE loaded_t (a INT, b INT)")
    with pytest.raises(Exception, match="(?i)malformed|cast|parse"):
        engine.load("loaded_t", str(tmp_path / "t.csv"))
    assert engine.table("loaded_t").count() == 0
    engine.drop_table("loaded_t")


@pytest.mark.parametrize(
    ("literal", "printed"),
    [
        ("INTERVAL '14' MONTH", "1 years 2 months"), ("INTERVAL '2' YEAR", "2 years 0 months"), ("INTERVAL '1-2' YEAR TO MONTH", "1 years 2 months"),
        ("INTERVAL '0' SECOND", "PT0S"), ("INTERVAL '1 02:03:04.5' DAY TO SECOND", "PT26H3M4.5S"), ("INTERVAL '-90' MINUTE", "PT-1H-30M"), ("INTERVAL '20' SECOND", "PT20S"),
    ],
)
def test_printed_intervals(spark, literal, printed):
    df = spark.sql(f"SELECT {literal} AS i")
    assert df.select(format_value(F.col("i"), df.schema["i"].dataType)).first()[0] == printed
