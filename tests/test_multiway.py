import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import dictionary_encode, value_bounds
from tessera.plans import adaptive_count, attribute_classes, bounded_cycles, count_bindings, generic_join, order_attributes, pattern
from tessera.plans.multiway import Relation, Theta, pattern_relations
from tessera.queries import catalogue


def graph(spark, vertices=14, edges=45, seed=1):
    r = random.Random(seed)
    half = {tuple(sorted(r.sample(range(vertices), 2))) for _ in range(edges)}
    both = half | {(b, a) for a, b in half}
    return spark.createDataFrame(sorted(both), "sid int, tid int"), half, both


def brute(kind, k, half, vertices=14):
    pairs = pattern(kind, k).pairs
    return sum(all((c[a - 1], c[b - 1]) in half for a, b in pairs) for c in itertools.combinations(range(vertices), k))


@pytest.mark.parametrize(("kind", "k"), [("clique", 3), ("clique", 4), ("cycle", 4), ("cycle", 5)])
def test_patterns(spark, kind, k):
    df, half, _ = graph(spark)
    df.createOrReplaceTempView("edge")
    p = pattern(kind, k)
    expected = brute(kind, k, half)
    thetas = [Theta((a, b), lambda a=a, b=b: F.col(a) < F.col(b)) for a, b in zip(p.attributes, p.attributes[1:])]
    assert count_bindings(generic_join(pattern_relations(df, p.pairs), p.attributes, thetas)).first()[0] == expected
    assert spark.sql(p.sql()).first()[0] == expected


def test_every_order_gives_the_same_count(spark):
    df, half, _ = graph(spark, seed=3)
    relations = pattern_relations(df, pattern("clique", 3).pairs)
    counts = {count_bindings(generic_join(relations, order)).first()[0] for order in itertools.permutations(("v1", "v2", "v3"))}
    assert counts == {brute("clique", 3, half)}
    assert set(order_attributes(relations)) == {"v1", "v2", "v3"}


def test_adaptive(spark):
    df, half, _ = graph(spark, seed=4)
    run = adaptive_count(pattern_relations(df, pattern("clique", 3).pairs), first="v1", boxes=3, orders=2)
    assert run.count == brute("clique", 3, half) and len({o for o, _ in run.picks}) == 2


def test_bags_nulls_and_classes(spark):
    a = spark.createDataFrame([(1, 1), (1, 1), (None, 1)], "x int, y int")
    b = spark.createDataFrame([(1, 5), (1, 5), (None, 5)], "x int, z int")
    c = spark.createDataFrame([(1, 5)], "y int, z int")
    relations = [Relation("a", a, ("x", "y"), distinct=False), Relation("b", b, ("x", "z"), distinct=False), Relation("c", c, ("y", "z"))]
    assert count_bindings(generic_join(relations)).first()[0] == 4
    assert attribute_classes([("a.x", "b.y"), ("b.y", "c.z"), ("d.p", "e.q")]) == [frozenset({"a.x", "b.y", "c.z"}), frozenset({"d.p", "e.q"})]
    assert value_bounds([(a, "x"), (c, "y")]) == (1, 1)


def test_dictionary(spark):
    df = spark.createDataFrame([(1, "b", "x"), (2, None, "a"), (3, "c", "b")], "k int, s string, t string")
    coded, words = dictionary_encode(df, "s", "t")
    assert {r.value: r.code for r in words.collect()} == {"a": 0, "b": 1, "c": 2, "x": 3}
    assert sorted(tuple(r) for r in coded.collect()) == [(1, 1, 3), (2, None, 0), (3, 2, 1)]


def co_purchases(spark, path, parts):
    """lineitem with one order that holds all parts: the complete graph."""
    spark.range(parts).selectExpr("1L AS l_orderkey", "id AS l_partkey", "'R' AS l_returnflag").write.mode("overwrite").parquet(f"{path}/lineitem.parquet")
    return {(a, b) for a in range(parts) for b in range(parts) if a != b}


def walks(k, edges, limit):
    """Closed walks of four or five vertices, v1, v2 and v4 below the limit."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
    low = [v for v in near if v < limit]
    if k == 4:
        return sum(len(near[v2] & near[v4]) for v1 in low for v2 in near[v1] for v4 in near[v1] if v2 < limit and v4 < limit)
    return sum(len(near[v2] & near[v4]) * len(near[v4] & near[v1]) for v1 in low for v2 in near[v1] if v2 < limit for v4 in low)


def dealt_rows(spark, query):
    """The query's result and the rows that its stages gave to exchanges; no join is a broadcast."""
    sc, seen = spark.sparkContext, {}
    store, empty = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        found = store.stageList(sc._jvm.java.util.ArrayList(), False, False, empty, sc._jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        seen = stages()
        value = query().first()[0]
        return value, sum(n for stage, n in stages().items() if stage not in seen)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.mark.parametrize(("name", "k", "limit"), [("graph_sel_4cycle_100", 4, 40), ("graph_sel_5cycle_50", 5, 20)])
def test_cycles_deal_out_no_whole_paths(spark, tmp_path, name, k, limit):
    expected = walks(k, co_purchases(spark, tmp_path, 40), limit)
    value, rows = dealt_rows(spark, lambda: catalogue()[name](spark, str(tmp_path)))
    assert value == expected and rows < 30_000  # 2,372,760 paths of four vertices


@pytest.mark.parametrize("k", [4, 5])
@pytest.mark.parametrize(("shift", "edges"), [(0, 45), (65528, 25)])
def test_bounded_cycles(spark, k, shift, edges):
    _, _, both = graph(spark, edges=edges, seed=edges)
    both = {(a + shift, b + shift) for a, b in both}
    df = spark.createDataFrame(sorted(both), "sid int, tid int")
    for limit in (shift, shift + 6, shift + 10, shift + 20):
        assert bounded_cycles(df, k, limit).first()[0] == walks(k, both, limit)
    assert bounded_cycles(df.where("sid < 0"), k, 5).first()[0] == 0
