"""The query catalogue: every query with its oracle in DuckDB's SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.engine import Engine
from tessera.operators import dictionary_encode
from tessera.plans import adaptive_count, bounded_cycles, count_bindings, edge_view, generic_join, pattern
from tessera.plans.multiway import Relation, Theta, pattern_relations
from tessera.plans.patterns import EDGE_SQL
from tessera.sources import load_csv, open_tables, write_csv

Query = Callable[[SparkSession, str], DataFrame]

#: name -> (statement of the dialect, oracle; None if the statement itself is DuckDB's SQL too)
SQL: dict[str, tuple[str, str | None]] = {
    # filters and predicates
    "filter_compare": ("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity < 10 AND l_discount >= 0.05 OR l_tax = 0", None),
    "filter_between_in": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 5 AND 8 AND l_returnflag IN ('A', 'R')", None),
    "filter_not_in_not_between": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity NOT BETWEEN 5 AND 45 AND l_returnflag NOT IN ('A', 'R')", None),
    "filter_like": ("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%e_%' AND p_type LIKE '%S%'", None),
    "filter_not_like": ("SELECT p_partkey, p_name FROM part WHERE p_name NOT LIKE '%a%'", None),
    "filter_null_logic": (
        "SELECT o_orderkey FROM orders WHERE NULLIF(o_orderstatus, 'P') IS NULL AND NOT (o_orderkey % 2 = 0) OR NULLIF(o_orderstatus, 'F') = 'O' AND (NULLIF(o_orderstatus, 'O') = 'O') IS NULL",
        None,
    ),
    "filter_is_not_null": ("SELECT count(*) AS n FROM orders WHERE NULLIF(o_orderstatus, 'P') IS NOT NULL", None),
    "filter_date_literal": ("SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < TIMESTAMP '1997-03-01 00:00:00'", None),
    "filter_string_order": ("SELECT c_custkey FROM customer WHERE c_mktsegment >= 'BUILDING' AND c_mktsegment < 'HOUSEHOLD'", None),
    "filter_index_style": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey = 7 OR l_partkey = 11 AND l_linenumber = 1", None),
    # scalar expressions
    "project_arith": (
        "SELECT l_orderkey, l_linenumber, l_linenumber / 2 AS half, (l_linenumber - 9) / 2 AS below, l_orderkey / l_linenumber AS q, l_linenumber % 3 AS r, -l_linenumber AS neg, -l_quantity AS negd, round(l_quantity / 4, 4) AS quarter, l_linenumber * 2 + 1 AS odd FROM lineitem",
        "SELECT l_orderkey, l_linenumber, l_linenumber // 2 AS half, (l_linenumber - 9) // 2 AS below, l_orderkey // l_linenumber AS q, l_linenumber % 3 AS r, -l_linenumber AS neg, -l_quantity AS negd, round(l_quantity / 4, 4) AS quarter, l_linenumber * 2 + 1 AS odd FROM lineitem",
    ),
    "project_bitwise": (
        "SELECT l_orderkey, l_linenumber, l_linenumber & 5 AS a, l_linenumber | 8 AS o, l_linenumber ^ 3 AS x FROM lineitem",
        "SELECT l_orderkey, l_linenumber, l_linenumber & 5 AS a, l_linenumber | 8 AS o, xor(l_linenumber, 3) AS x FROM lineitem",
    ),
    "project_concat_case": (
        "SELECT c_custkey, 'c:' || c_name || '/' || NULLIF(c_mktsegment, 'BUILDING') AS tag, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'high' END AS band, CASE WHEN c_acctbal > 5000 THEN 1 END AS rich FROM customer",
        None,
    ),
    "project_cast": (
        "SELECT o_orderkey, CAST(o_totalprice AS int) AS whole, CAST(-o_totalprice AS bigint) AS neg, CAST(o_orderkey AS double) AS d FROM orders",
        "SELECT o_orderkey, CAST(trunc(o_totalprice) AS int) AS whole, CAST(trunc(-o_totalprice) AS bigint) AS neg, CAST(o_orderkey AS double) AS d FROM orders",
    ),
    "project_extract": (
        "SELECT event_id, EXTRACT(year FROM ts) AS y, EXTRACT(month FROM ts) AS mo, EXTRACT(day FROM ts) AS d, EXTRACT(hour FROM ts) AS h, EXTRACT(minute FROM ts) AS mi, CAST(EXTRACT(second FROM ts) AS int) AS s FROM events",
        "SELECT event_id, CAST(EXTRACT(year FROM ts) AS int) AS y, CAST(EXTRACT(month FROM ts) AS int) AS mo, CAST(EXTRACT(day FROM ts) AS int) AS d, CAST(EXTRACT(hour FROM ts) AS int) AS h, CAST(EXTRACT(minute FROM ts) AS int) AS mi, CAST(EXTRACT(second FROM ts) AS int) AS s FROM events",
    ),
    "project_interval": (
        "SELECT o_orderkey, CAST(o_orderdate AS date) + INTERVAL '1' MONTH AS m, CAST(o_orderdate AS date) - INTERVAL '3' DAY AS d, o_orderdate + INTERVAL '2' HOUR AS h, CAST(o_orderdate AS date) - INTERVAL '1' YEAR AS y FROM orders",
        "SELECT o_orderkey, CAST(CAST(o_orderdate AS date) + INTERVAL 1 MONTH AS date) AS m, CAST(CAST(o_orderdate AS date) - INTERVAL 3 DAY AS date) AS d, o_orderdate + INTERVAL 2 HOUR AS h, CAST(CAST(o_orderdate AS date) - INTERVAL 1 YEAR AS date) AS y FROM orders",
    ),
    "project_star_naming": (
        "SELECT n.*, r_name, r_regionkey + 1, r_regionkey * 2 FROM nation n, region WHERE n_regionkey = r_regionkey",
        'SELECT n.*, r_name, r_regionkey + 1 AS "default", r_regionkey * 2 AS default2 FROM nation n, region WHERE n_regionkey = r_regionkey',
    ),
    "project_function_naming": (
        "SELECT n_regionkey, count(*), sum(n_nationkey), sum(n_regionkey) FROM nation GROUP BY n_regionkey",
        'SELECT n_regionkey, count(*) AS "count", CAST(sum(n_nationkey) AS bigint) AS "sum", CAST(sum(n_regionkey) AS bigint) AS sum2 FROM nation GROUP BY n_regionkey',
    ),
    "project_constant": ("SELECT 1 AS one, 'x' AS x FROM region", None),
    "alias_in_where": (
        "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice FROM lineitem WHERE twice > 90",
        "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice FROM lineitem WHERE l_quantity * 2 > 90",
    ),
    "udf_int_equals": (
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE int_equals(l_linenumber, 3)",
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber = 3",
    ),
    # aggregation
    "agg_global": (
        "SELECT count(*) AS n, count(o_custkey) AS c, sum(o_custkey) AS s, round(avg(o_totalprice), 4) AS a, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders",
        "SELECT count(*) AS n, count(o_custkey) AS c, CAST(sum(o_custkey) AS bigint) AS s, round(avg(o_totalprice), 4) AS a, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders",
    ),
    "agg_global_empty": (
        "SELECT count(*) AS n, sum(o_custkey) AS s, avg(o_totalprice) AS a, min(o_orderdate) AS lo, max(o_orderstatus) AS hi FROM orders WHERE o_orderkey < 0",
        "SELECT count(*) AS n, CAST(sum(o_custkey) AS bigint) AS s, avg(o_totalprice) AS a, min(o_orderdate) AS lo, max(o_orderstatus) AS hi FROM orders WHERE o_orderkey < 0",
    ),
    "agg_group": (
        "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus",
        None,
    ),
    "agg_group_expr": (
        "SELECT EXTRACT(year FROM o_orderdate) AS y, round(sum(o_totalprice) / count(*), 4) AS mean, sum(o_orderkey) / count(*) AS whole FROM orders GROUP BY EXTRACT(year FROM o_orderdate)",
        "SELECT CAST(EXTRACT(year FROM o_orderdate) AS int) AS y, round(sum(o_totalprice) / count(*), 4) AS mean, CAST(sum(o_orderkey) // count(*) AS bigint) AS whole FROM orders GROUP BY 1",
    ),
    "agg_minmax_string_date": ("SELECT o_orderstatus, min(o_orderpriority) AS p, max(o_orderdate) AS d, min(o_orderdate) AS e FROM orders GROUP BY o_orderstatus", None),
    "agg_count_null": ("SELECT NULLIF(o_orderstatus, 'P') AS g, count(NULLIF(o_orderpriority, '1-URGENT')) AS c, count(*) AS n FROM orders GROUP BY NULLIF(o_orderstatus, 'P')", None),
    "agg_having": ("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING avg(c_acctbal) > 4500 AND n > 1", None),
    "agg_distinct": ("SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, count(DISTINCT l_partkey) AS p FROM lineitem GROUP BY l_returnflag", None),
    "agg_case": (
        "SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS f FROM orders GROUP BY o_orderpriority",
        "SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS bigint) AS f FROM orders GROUP BY o_orderpriority",
    ),
    "select_distinct": ("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", None),
    "group_no_agg": ("SELECT o_orderstatus, o_orderpriority FROM orders GROUP BY o_orderstatus, o_orderpriority", None),
    # order and limit
    "order_nulls_asc_desc": (
        "SELECT o_orderkey, row_number() OVER (ORDER BY NULLIF(o_orderstatus, 'P') ASC NULLS LAST, o_orderkey) AS up FROM (SELECT o_orderkey, o_orderstatus FROM orders ORDER BY NULLIF(o_orderstatus, 'P') DESC, o_orderkey LIMIT 500) t",
        "SELECT o_orderkey, row_number() OVER (ORDER BY NULLIF(o_orderstatus, 'P') ASC NULLS LAST, o_orderkey) AS up FROM (SELECT o_orderkey, o_orderstatus FROM orders ORDER BY NULLIF(o_orderstatus, 'P') DESC NULLS FIRST, o_orderkey LIMIT 500) t",
    ),
    "order_nulls_last_limit": (
        "SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS s FROM orders ORDER BY s, o_orderkey DESC LIMIT 40",
        "SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS s FROM orders ORDER BY s ASC NULLS LAST, o_orderkey DESC LIMIT 40",
    ),
    "order_multi_limit": ("SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_extendedprice * (1 - l_discount) DESC, l_orderkey, l_linenumber DESC LIMIT 25", None),
    "order_by_aggregate": ("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey LIMIT 10", None),
    # joins
    "join_chain_region": (
        "SELECT r_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM region, nation, customer, orders WHERE r_regionkey = n_regionkey AND n_nationkey = c_nationkey AND c_custkey = o_custkey GROUP BY r_name",
        None,
    ),
    "join_star_tpch": (
        "SELECT s_nationkey, p_brand, round(sum(l_extendedprice), 2) AS total FROM orders, lineitem, part, supplier WHERE o_orderkey = l_orderkey AND l_partkey = p_partkey AND l_suppkey = s_suppkey AND o_orderdate >= DATE '1996-01-01' AND p_size < 20 GROUP BY s_nationkey, p_brand",
        None,
    ),
    "join_theta": ("SELECT l_orderkey, l_linenumber FROM lineitem, part WHERE l_partkey = p_partkey AND l_extendedprice > p_retailprice * 40", None),
    "join_theta_only": ("SELECT r.r_name AS r, n.n_name AS n FROM region r, nation n WHERE n.n_regionkey < r.r_regionkey", None),
    "join_self": ("SELECT a.n_name AS a, b.n_name AS b FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "join_cross": ("SELECT r_name, n_name FROM region, nation", None),
    "join_on_syntax": ("SELECT n_name, c_custkey FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey AND c_acctbal > 9000", None),
    "join_null_keys": ("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a, nation b WHERE NULLIF(a.n_regionkey, 1) = NULLIF(b.n_regionkey, 1)", None),
    "join_attr_class": ("SELECT count(*) AS n FROM customer c, supplier s, nation n WHERE c.c_nationkey = s.s_nationkey AND s.s_nationkey = n.n_nationkey AND c.c_nationkey = n.n_nationkey", None),
    "join_documents_labels": ("SELECT source, toxic, count(*) AS n FROM documents d, labels l WHERE d.doc_id = l.doc_id AND text LIKE '%the%' GROUP BY source, toxic", None),
    # subqueries
    "sub_from": ("SELECT s, count(*) AS n FROM (SELECT o_orderstatus AS s, o_totalprice AS p FROM orders WHERE o_totalprice > 1000) t WHERE p < 200000 GROUP BY s", None),
    "sub_scalar_where": ("SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0)", None),
    "sub_scalar_having": ("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > (SELECT avg(o_totalprice) * 14 FROM orders)", None),
    "sub_in": ("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)", None),
    "sub_correlated_agg": (
        "SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS s FROM lineitem l, part WHERE p_partkey = l_partkey AND p_size < 25 AND l_quantity < (SELECT 0.8 * avg(l_quantity) FROM lineitem i WHERE i.l_partkey = l.l_partkey)",
        None,
    ),
    "sub_nested": (
        "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > (SELECT max(l_quantity) - 1 FROM lineitem)))",
        None,
    ),
    "sub_exists": ("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 AS one FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 48 AND l_discount > 0.09)", None),
    "sub_not_in": ("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", None),
}

GRAPHS = [(kind, k) for kind in ("clique", "cycle") for k in (3, 4, 5, 6, 7)]
SELECTIVITY = {"3clique": ("clique", 3, 3), "4clique": ("clique", 4, 4), "4cycle": ("cycle", 4, 4), "5clique": ("clique", 5, 4), "5cycle": ("cycle", 5, 4), "6clique": ("clique", 6, 4)}
#: The sweep's fractions of the vertex range, the same for all three bounded attributes.
FRACTIONS = (25, 50, 75, 100)


def _statement(text: str) -> Query:
    def run(spark: SparkSession, directory: str) -> DataFrame:
        engine = Engine(spark)
        open_tables(spark, directory)
        for name in ("documents", "labels"):
            if name in text:
                open_tables(spark, directory, (name,))
        return engine.sql(text)

    return run


def vertex_limit(spark: SparkSession) -> int:
    return spark.table("edge").agg(F.max("sid")).first()[0] + 1


def _relations(spark: SparkSession, directory: str, kind: str, k: int) -> tuple[list[Relation], list[Theta]]:
    """Increasing vertices: on the ordered half, only pairs of neighbours in no common edge need a predicate."""
    p = pattern(kind, k)
    thetas = [Theta((a, b), lambda a=a, b=b: F.col(a) < F.col(b)) for a, b in zip(p.attributes, p.attributes[1:])]
    return pattern_relations(edge_view(spark, directory).cache(), p.pairs), thetas


def _graph(kind: str, k: int) -> Query:
    """Pattern counts run as a generic join: multiway plans need not be chosen by hand."""

    def run(spark: SparkSession, directory: str) -> DataFrame:
        relations, thetas = _relations(spark, directory, kind, k)
        return count_bindings(generic_join(relations, order=pattern(kind, k).attributes, theta=thetas))

    return run


def _graph_sql(kind: str, k: int) -> Query:
    def run(spark: SparkSession, directory: str) -> DataFrame:
        edge_view(spark, directory).cache().createOrReplaceTempView("edge")
        return Engine(spark).sql(pattern(kind, k).sql())

    return run


def _selective(kind: str, k: int, last: int, percent: int) -> Query:
    def run(spark: SparkSession, directory: str) -> DataFrame:
        edges = edge_view(spark, directory).cache()
        limit = int(percent / 100 * vertex_limit(spark))
        if kind == "cycle" and k in (4, 5) and last == 4:
            return bounded_cycles(edges, k, limit)
        bounded = {"v1", "v2", f"v{last}"}
        relations = []
        for r in pattern_relations(edges, pattern(kind, k).pairs, ordered=False):
            df = r.df
            for a in set(r.attributes) & bounded:
                df = df.where(F.col(a) < limit)
            relations.append(Relation(r.name, df, r.attributes))
        return count_bindings(generic_join(relations, order=pattern(kind, k).attributes))

    return run


def _adaptive(spark: SparkSession, directory: str) -> DataFrame:
    relations, thetas = _relations(spark, directory, "clique", 3)
    run = adaptive_count(relations, thetas, first="v1", boxes=4, orders=2)
    return spark.createDataFrame([(run.count,)], "count bigint")


def _bag_join(spark: SparkSession, directory: str) -> DataFrame:
    """Relations with repeated rows keep their multiplicities."""
    lines = spark.read.parquet(f"{directory}/lineitem.parquet").select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    orders = spark.read.parquet(f"{directory}/lineitem.parquet").where("l_linenumber = 1").select(F.col("l_partkey").alias("p"), F.col("l_orderkey").alias("o"))
    return count_bindings(generic_join([Relation("a", lines, ("p", "s"), distinct=False), Relation("b", orders, ("p", "o"), distinct=False)]))


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir where it is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/tessera-tmp"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def _csv_roundtrip(spark: SparkSession, directory: str) -> DataFrame:
    rows = spark.read.parquet(f"{directory}/orders.parquet").select("o_orderkey", F.expr("NULLIF(o_orderstatus, 'P')").alias("o_orderstatus"), "o_totalprice", "o_orderdate")
    path = shared_folder(spark)
    write_csv(rows, path, "|", "NULL")
    return load_csv(spark, path, rows.schema, "|", "NULL")


def _select_into(spark: SparkSession, directory: str) -> DataFrame:
    engine = Engine(spark)
    open_tables(spark, directory)
    engine.sql("SELECT c_custkey, c_acctbal INTO rich FROM customer WHERE c_acctbal > 5000 ORDER BY c_custkey LIMIT 50")
    return engine.sql("SELECT count(*) AS n, min(c_custkey) AS lo FROM rich")


def _ddl(spark: SparkSession, directory: str) -> DataFrame:
    engine = Engine(spark)
    for name in ("t_ddl", "t_copy"):
        if engine.exists(name):
            engine.drop_table(name)
    engine.sql("CREATE TABLE t_ddl (k integer PRIMARY KEY, v numeric, s character varying(12) NOT NULL, d date)")
    engine.create_like("t_ddl", "t_copy")
    engine.sql("DROP TABLE t_ddl")
    return engine.sql("SELECT count(*) AS n, max(v) AS v, min(s) AS s FROM t_copy")


def _copy_limit(spark: SparkSession, directory: str) -> DataFrame:
    engine = Engine(spark)
    open_tables(spark, directory)
    path = shared_folder(spark)
    engine.copy("supplier", path, 7)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"))


def _dictionary(spark: SparkSession, directory: str) -> DataFrame:
    rows = spark.read.parquet(f"{directory}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return dictionary_encode(rows, "o_orderstatus", "o_orderpriority")[0]


def _sorted_index(spark: SparkSession, directory: str) -> DataFrame:
    engine = Engine(spark)
    edge_view(spark, directory)
    by_source, by_target = engine.index()
    return by_source.groupBy("sid").agg(F.count(F.lit(1)).alias("n")).join(by_target.groupBy("tid").agg(F.count(F.lit(1)).alias("m")), F.col("sid") == F.col("tid")).select("sid", "n", "m")


def _render(spark: SparkSession, directory: str) -> DataFrame:
    from tessera.functions import format_value

    rows = spark.read.parquet(f"{directory}/orders.parquet").select("o_orderkey", F.expr("NULLIF(o_orderstatus, 'P')").alias("s"))
    return rows.select("o_orderkey", format_value(F.col("s"), rows.schema["s"].dataType).alias("shown"))


#: name -> (query, oracle)
CUSTOM: dict[str, tuple[Query, str]] = {
    "graph_adaptive_3_clique": (_adaptive, EDGE_SQL + pattern("clique", 3).sql()),
    "join_bag_multiplicity": (_bag_join, "SELECT count(*) AS count FROM lineitem a, lineitem b WHERE a.l_partkey = b.l_partkey AND b.l_linenumber = 1"),
    "csv_roundtrip": (_csv_roundtrip, "SELECT o_orderkey, NULLIF(o_orderstatus, 'P') AS o_orderstatus, o_totalprice, o_orderdate FROM orders"),
    "select_into": (_select_into, "SELECT count(*) AS n, min(c_custkey) AS lo FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 5000 ORDER BY c_custkey LIMIT 50)"),
    "ddl_create_drop": (_ddl, "SELECT CAST(0 AS bigint) AS n, CAST(NULL AS double) AS v, CAST(NULL AS varchar) AS s"),
    "table_copy_limit": (_copy_limit, "SELECT CAST(7 AS bigint) AS n"),
    "dictionary_encode": (
        _dictionary,
        "WITH v AS (SELECT o_orderstatus AS s FROM orders UNION SELECT o_orderpriority FROM orders), c AS (SELECT s, CAST(row_number() OVER (ORDER BY s) - 1 AS int) AS code FROM v) SELECT o_orderkey, a.code AS o_orderstatus, b.code AS o_orderpriority FROM orders, c a, c b WHERE o_orderstatus = a.s AND o_orderpriority = b.s",
    ),
    "sorted_edge_index": (_sorted_index, EDGE_SQL + "SELECT sid, count(*) AS n, count(*) AS m FROM edge GROUP BY sid"),
    "render_null": (_render, "SELECT o_orderkey, coalesce(NULLIF(o_orderstatus, 'P'), '[null]') AS shown FROM orders"),
}


def catalogue() -> dict[str, Query]:
    found: dict[str, Query] = {name: _statement(text) for name, (text, _) in SQL.items()}
    for kind, k in GRAPHS:
        found[f"graph_{k}_{kind}"] = _graph(kind, k)
        if k <= 4:
            found[f"graph_sql_{k}_{kind}"] = _graph_sql(kind, k)
    for name, (kind, k, last) in SELECTIVITY.items():
        for percent in FRACTIONS if k < 5 else (25, 50):
            found[f"graph_sel_{name}_{percent}"] = _selective(kind, k, last, percent)
    return found | {name: query for name, (query, _) in CUSTOM.items()}


def oracles() -> dict[str, str]:
    found = {name: oracle or text for name, (text, oracle) in SQL.items()}
    # ordered patterns over the increasing half of the graph: the same counts, and DuckDB ends on 7-cliques too
    half = EDGE_SQL.replace("edge AS (SELECT sid, tid FROM o UNION SELECT tid, sid FROM o)", "edge AS (SELECT sid, tid FROM o)")
    for kind, k in GRAPHS:
        found[f"graph_{k}_{kind}"] = half + pattern(kind, k).sql()
        if k <= 4:
            found[f"graph_sql_{k}_{kind}"] = EDGE_SQL + pattern(kind, k).sql()
    for name, (kind, k, last) in SELECTIVITY.items():
        for percent in FRACTIONS if k < 5 else (25, 50):
            limit = f"(SELECT CAST(floor({percent} / 100.0 * (max(sid) + 1)) AS int) FROM edge)"
            found[f"graph_sel_{name}_{percent}"] = EDGE_SQL + pattern(kind, k).sql(ordered=False, bounds={1: limit, 2: limit, last: limit})
    return found | {name: oracle for name, (_, oracle) in CUSTOM.items()}
