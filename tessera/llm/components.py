"""Connected components of a stored edge table.

First every partition replaces its own edges by stars (union-find over one partition's rows). What is left goes through
rounds of alternating star contraction, each written to the shared folder, until nothing changes. As soon as the edges
left are few (a fixed, checked bound), one task ends the work; the result is the same either way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import keep

EDGES = "u bigint, v bigint"


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node and smallest node reachable by this partition's edges, for all nodes but the smallest."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    nodes = list(parent)
    for k in range(0, len(nodes), 100_000):
        part = nodes[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(part, np.int64)), pa.array(np.array([find(x) for x in part], np.int64))], names=["u", "v"])


def contract(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with u > v that keep the components, at most one per node and partition."""
    return edges.select("u", "v").mapInArrow(_stars, EDGES)


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = keep(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")), "least")
    large = keep(both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
    least = keep(large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")), "least")
    ends = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
    return keep(large.join(least, F.col("u") == F.col("w")).select(ends).select("e.u", "e.v").where("u <> v").distinct(), "small")


def components(edges: DataFrame, few: int = 50_000) -> DataFrame:
    """Node and smallest node of its component, for every node of an edge but the smallest ones. ``edges``: u, v."""
    left = keep(contract(edges.where("u <> v")), "stars")
    seen = None
    while True:
        now = left.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if now[0] <= few:
            return keep(left.repartition(1).mapInArrow(_stars, EDGES), "components").select(F.col("u").alias("node"), F.col("v").alias("root"))
        if tuple(now) == seen:
            return left.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen, left = tuple(now), _round(left)
