"""Graph patterns: k-cliques and k-cycles over an edge relation, as SQL text or as relations of a multiway join."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The symmetric co-purchase graph over lineitem: parts bought and returned together.
EDGE_SQL = """WITH o AS (
  SELECT DISTINCT CAST(a.l_partkey AS INT) AS sid, CAST(b.l_partkey AS INT) AS tid
  FROM lineitem a, lineitem b
  WHERE a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey
    AND a.l_returnflag = 'R' AND b.l_returnflag = 'R'),
edge AS (SELECT sid, tid FROM o UNION SELECT tid, sid FROM o)
"""


@dataclass(frozen=True)
class Pattern:
    """Vertices 1..k and the vertex pairs that an edge must join."""

    vertices: int
    pairs: tuple[tuple[int, int], ...]

    @property
    def attributes(self) -> tuple[str, ...]:
        return tuple(f"v{k}" for k in range(1, self.vertices + 1))

    def sql(self, ordered: bool = True, bounds: dict[int, str] | None = None) -> str:
        """One alias of ``edge`` per pair, shared vertices equated, the vertices in increasing order or under upper bounds."""
        at: dict[int, str] = {}
        where: list[str] = []
        for n, (a, b) in enumerate(self.pairs, 1):
            for vertex, column in ((a, f"e{n}.sid"), (b, f"e{n}.tid")):
                if vertex in at:
                    where.append(f"{at[vertex]} = {column}")
                else:
                    at[vertex] = column
        if ordered:
            where += [f"{at[k]} < {at[k + 1]}" for k in range(1, self.vertices)]
        where += [f"{at[vertex]} < {bound}" for vertex, bound in sorted((bounds or {}).items())]
        tables = ", ".join(f"edge e{n}" for n in range(1, len(self.pairs) + 1))
        return f"SELECT count(*) AS count FROM {tables} WHERE {' AND '.join(where)}"


def pattern(kind: str, k: int) -> Pattern:
    if k < 3:
        raise ValueError("a pattern has at least three vertices")
    if kind == "clique":
        return Pattern(k, tuple(combinations(range(1, k + 1), 2)))
    if kind == "cycle":
        return Pattern(k, (*((i, i + 1) for i in range(1, k)), (1, k)))
    raise ValueError(f"unknown pattern {kind}")


def edge_view(spark: SparkSession, directory: str, name: str = "edge") -> DataFrame:
    """The co-purchase graph of a test directory: symmetric, without loops or repeated edges.

    Written once as a self-join of lineitem on the order key (co-partitioned, small groups) and one distinct; the
    reverse orientation needs no second distinct, since the two halves cannot overlap.
    """
    lines = spark.read.parquet(f"{directory}/lineitem.parquet").where("l_returnflag = 'R'").select("l_orderkey", F.col("l_partkey").cast("int").alias("part"))
    a, b = lines.alias("a"), lines.alias("b")
    half = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.part") < F.col("b.part"))).select(F.col("a.part").alias("sid"), F.col("b.part").alias("tid")).distinct()
    ends = F.explode(F.array(F.struct("sid", "tid"), F.struct(F.col("tid").alias("sid"), F.col("sid").alias("tid")))).alias("e")
    edges = half.select(ends).select("e.sid", "e.tid")
    edges.createOrReplaceTempView(name)
    return edges
