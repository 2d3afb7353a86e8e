"""4- and 5-cycles under upper bounds, counted without binding all their vertices.

Of the vertices v1, v2, ... of a cycle, v1, v2 and v4 lie below the limit ("inside"); vertices may repeat, as in the join
over the edges. A closed walk is turned until its largest vertex u comes first. It then consists of half paths u - a - w
with a < u and w < u, which meet in w (four vertices) or by an edge between their ends (five). Only half paths are
dealt out, many ends in one row, and counted by their ends; whole paths are never rows. This holds for any edges; an
order by degree would hold the half paths of hubs down, the order by number does not.

Sorted ends travel as two arrays, of their lower and of their upper 16 bits: the upper ones repeat and compress well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Half paths that a task counts, about. Their number is estimated; more of them cost a task time and spilling only.
PER_TASK = 1_000_000


def bounded_cycles(edges: DataFrame, k: int, limit: int) -> DataFrame:
    """COUNT(*) of the k-cycle join (k is 4 or 5) with v1, v2 and v4 below the limit.

    ``edges`` (sid int, tid int) is symmetric, without loops, repeats and nulls. No edges count as 0.
    """
    if k not in (4, 5):
        raise ValueError("only cycles of four or five vertices")
    near = _neighbours(edges, limit).cache()
    size = F.size("near").cast("double")
    ends, pairs = near.agg(F.coalesce(F.sum(size), F.lit(0.0)), F.coalesce(F.sum(size * size), F.lit(0.0))).first()
    least = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    halves = max(least, int(pairs / 3 / PER_TASK) + 1)
    if k == 4:
        return _four(near, limit, halves)
    return _five(near, limit, halves, max(least, int((pairs / 3 + pairs * pairs / 8 / max(1.0, ends)) / PER_TASK) + 1))


def _low(x: Column) -> Column:
    return F.shiftright(F.shiftleft(x, 16), 16).cast("smallint")


def _high(x: Column) -> Column:
    return F.shiftright(x, 16).cast("smallint")


def _whole(low: Column, high: Column) -> Column:
    return F.shiftleft(high.cast("int"), 16).bitwiseOR(low.cast("int").bitwiseAND(F.lit(65535)))


def _neighbours(edges: DataFrame, limit: int) -> DataFrame:
    """Per vertex its neighbours in order, how many are inside and how many smaller. Edges are dealt out before they are collected: partial lists would be of one or two."""
    near = edges.repartition("sid").groupBy("sid").agg(F.sort_array(F.collect_list("tid")).alias("near"), F.count_if(F.col("tid") < limit).cast("int").alias("inside"), F.count_if(F.col("tid") < F.col("sid")).cast("int").alias("smaller"))
    return near.withColumns({"lows": F.transform("near", _low), "highs": F.transform("near", _high)})


def _four(near: DataFrame, limit: int, tasks: int) -> DataFrame:
    """Closed walks whose largest vertex u stands once: the squared number of half paths from u to w, four times if u is inside (it may stand
    at any vertex), once if not (at v3 only). If it stands twice, opposite itself, any two smaller neighbours make a walk, in two places."""
    central = near.where(F.col("sid") < limit)
    halves = central.select("sid", "lows", "highs", "inside", F.posexplode("near").alias("before", "u")).where("u > sid").withColumn("n", F.least("before", "inside")).where("n > 0")
    dealt = halves.select("u", *(F.slice(a, F.lit(1), F.col("n")).alias(a) for a in ("lows", "highs"))).repartition(tasks, "u")
    ends = dealt.select("u", "highs", F.posexplode("lows").alias("k", "low")).select("u", _whole(F.col("low"), F.get("highs", F.col("k"))).alias("w"))
    met = ends.groupBy("u", "w").agg(F.count(F.lit(1)).alias("n"))
    once = met.agg(F.sum(F.col("n") * F.col("n") * F.when(F.col("u") < limit, 4).otherwise(1)).alias("n"))
    smaller = F.col("smaller").cast("bigint")
    twice = central.agg(F.sum(smaller * smaller * 2).alias("n"))
    return once.unionAll(twice).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("count"))


def _five(near: DataFrame, limit: int, halves: int, tasks: int) -> DataFrame:
    """Half paths (w, u) meet those of every neighbour of w, sent from the larger end of the edge to the smaller. Kinds of half paths, and walks for each meeting:

    0: u inside has five places and two directions, u not inside has v3 or v5 and two directions.
    1: from w to any vertex inside, through one that is not, so that v3 and v5 both are not; u is v4 here, two directions.
    Walks in which a largest vertex u inside stands twice are a triangle below u and any smaller neighbour of u: a half path (w, u) whose w is joined to u,
    half of ten for each, since the triangle has two. So u holds (u, u), as often as it has smaller neighbours; to stay whole, all others count twice.
    """
    ends = near.where("inside > 0").select("sid", "lows", "highs", "inside", "smaller", F.posexplode(F.slice("near", F.lit(1), F.col("inside"))).alias("before", "w"))
    above, central = F.greatest(F.col("before") + 1, F.col("smaller")), F.col("sid") < limit
    paths = ends.select(
        "w", F.when(central, 0).otherwise(1).alias("kind"), "lows", "highs", F.when(central, above).otherwise(0).alias("from"), F.when(central, F.size("lows")).otherwise(F.col("inside")).alias("to")
    ).where("to > from")
    paths = paths.select("w", "kind", *(F.slice(a, F.col("from") + 1, F.col("to") - F.col("from")).alias(a) for a in ("lows", "highs")))
    below = near.where((F.col("sid") < limit) & (F.col("smaller") > 0))
    # a negative kind: (u, u), so many times
    again = below.select(F.col("sid").alias("w"), -F.col("smaller"), F.array(_low(F.col("sid"))), F.array(_high(F.col("sid"))))
    dealt = paths.unionAll(again).repartition(halves, "w").select("w", F.greatest("kind", F.lit(0)).alias("kind"), F.when(F.col("kind") < 0, -F.col("kind")).otherwise(2).alias("n"), "highs", F.posexplode("lows").alias("k", "low"))
    counted = dealt.select("w", "kind", "n", _whole(F.col("low"), F.get("highs", F.col("k"))).alias("u")).groupBy("w", "kind", "u").agg(F.sum("n").cast("int").alias("n"))
    held = counted.groupBy("w", "kind").agg(F.sort_array(F.collect_list(F.struct("n", "u"))).alias("us"))
    held = held.select("w", "kind", F.transform("us", lambda x: _low(x["u"])).alias("lows"), F.transform("us", lambda x: _high(x["u"])).alias("highs"), F.col("us")["n"].alias("ns"))
    lists = below.select(F.col("sid").alias("w"), F.slice("near", F.lit(1), F.col("smaller")).alias("to"))
    # the half paths of the place itself go there with -1 - kind
    to = F.explode(F.concat(F.array("w"), F.coalesce("to", F.array().cast("array<int>")))).alias("at")
    sent = held.join(lists, "w", "left").select("w", to, "kind", "lows", "highs", "ns").withColumn("kind", F.when(F.col("at") == F.col("w"), -1 - F.col("kind")).otherwise(F.col("kind"))).drop("w")
    rows = sent.repartition(tasks, "at").select("at", "kind", "highs", "ns", F.posexplode("lows").alias("k", "low"))
    own = F.col("kind") < 0
    rows = rows.select("at", F.when(own, -1 - F.col("kind")).otherwise(F.col("kind")).alias("kind"), own.alias("own"), _whole(F.col("low"), F.get("highs", F.col("k"))).alias("u"), F.get("ns", F.col("k")).cast("bigint").alias("n"))
    met = rows.groupBy("at", "kind", "u").agg(F.sum(F.when(F.col("own"), F.col("n")).otherwise(0)).alias("own"), F.sum(F.when(F.col("own"), 0).otherwise(F.col("n"))).alias("others"))
    walks = F.when(F.col("kind") == 1, 2).when(F.col("u") < limit, 10).otherwise(4)
    return met.agg(F.sum(F.col("own") * F.col("others") * walks).alias("n")).select(F.expr("coalesce(n div 4, 0)").cast("bigint").alias("count"))
