import pytest

from tessera.dialect import DialectError, translate
from tessera.engine import Engine
from tessera.functions import divide


@pytest.fixture(scope="module")
def engine(spark):
    spark.sql("SELECT * FROM VALUES (1, 'a', 7.0D), (2, NULL, -7.0D), (3, 'b', NULL), (3, 'b', 1.0D) AS t(k, g, v)").createOrReplaceTempView("t")
    spark.sql("SELECT CAST(1 AS int) AS k, 1.0D AS v WHERE false").createOrReplaceTempView("t_empty")
    return Engine(spark)


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(
    ("sql", "expected"),
    [
        ("SELECT 7 / 2 AS a FROM t LIMIT 1", [(3,)]),
        ("SELECT -7 / 2 AS a FROM t LIMIT 1", [(-3,)]),
        ("SELECT k * 7 / 2 / 2 AS a FROM t WHERE k = 2", [(3,)]),
        ("SELECT v / 2 AS a FROM t WHERE k = 1", [(3.5,)]),
        ("SELECT (k + 1) / (CASE WHEN g = 'a' THEN 2 ELSE 1 END) AS a FROM t WHERE k = 1", [(1,)]),
        ("SELECT sum(k) / count(*) AS a FROM t", [(2,)]),
        ("SELECT a FROM (SELECT k / 2 AS a FROM t WHERE k = 3) s", [(1,), (1,)]),
    ],
)
def test_division(engine, sql, expected):
    assert rows(engine.sql(sql)) == expected


def test_division_of_columns(spark, engine):
    df = spark.table("t")
    assert df.select(divide(df, df.k * 7, -df.k - df.k)).first()[0] == -3
    assert df.select(divide(df, df.v, df.k)).first()[0] == 7.0


def test_null_order(engine):
    assert [r[0] for r in rows(engine.sql("SELECT g FROM t ORDER BY g, k"))] == ["a", "b", "b", None]
    assert [r[0] for r in rows(engine.sql("SELECT g FROM t ORDER BY g DESC, k"))] == [None, "b", "b", "a"]


def test_names(engine):
    assert engine.sql("SELECT k, t.k, count(*), sum(v), sum(k), k + 1, 2 FROM t GROUP BY k").columns == ["k", "k2", "count", "sum", "sum2", "default", "default2"]
    assert engine.sql("SELECT a.*, b.* FROM t a, t b").columns == ["k", "g", "v", "k2", "g2", "v2"]
    with pytest.raises(DialectError):
        translate("SELECT k AS x, g AS x FROM t")


def test_alias_in_where_and_literals(engine):
    assert rows(engine.sql("SELECT k + 1 AS n FROM t WHERE n > 3")) == [(4,), (4,)]
    assert rows(engine.sql("SELECT count(*) AS n FROM t WHERE v > 0.5 AND {d '2020-01-31'} + INTERVAL '1' MONTH = DATE '2020-02-29'")) == [(2,)]


def test_three_valued_logic_and_empty_aggregates(engine):
    assert rows(engine.sql("SELECT k FROM t WHERE NOT (g = 'a')")) == [(3,), (3,)]
    assert rows(engine.sql("SELECT count(*), sum(k), avg(v), min(k) FROM t_empty")) == [(0, None, None, None)]
    assert sorted(rows(engine.sql("SELECT g, count(*) AS n FROM t GROUP BY g")), key=str) == [("a", 1), ("b", 2), (None, 1)]


def test_into_ddl_and_script(engine, tmp_path):
    assert engine.sql("SELECT k INTO kept FROM t WHERE k > 1 LIMIT 2") is None
    assert engine.cardinality("kept") == 2
    (tmp_path / "x.csv").write_text('1|a|2020-01-02\n2||\n3|NULL|2020-02-03\n4|""|2020-02-03\n')
    said = engine.run_script(f"CREATE TABLE c (k int, s varchar(3), d date); load c {tmp_path}/x.csv | NULL; SELECT count(s) FROM c; SELECT nothing FROM c; SELECT s, d FROM c WHERE k = 2; DROP TABLE c")
    assert said[1] == "loaded 4 rows" and said[2] == "count\n1" and said[3].startswith("error") and said[4] == "s\td\n[null]\t[null]"
    with pytest.raises(DialectError):
        engine.sql("DROP TABLE c")
    with pytest.raises(DialectError):
        engine.sql("CREATE TABLE d (k bigint)")
    with pytest.raises(DialectError):
        translate("SELECT k INTO a, b FROM t")


def test_udf_and_explain(engine):
    assert rows(engine.sql("SELECT k FROM t WHERE int_equals(k, 2)")) == [(2,)]
    assert "Physical Plan" in engine.explain("SELECT k FROM t")
