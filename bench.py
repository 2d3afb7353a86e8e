"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tessera.queries import catalogue
from tessera.session import build_session, local_master

HEADLINE = (
    "graph_3_clique", "graph_4_clique", "graph_5_clique", "graph_6_clique", "graph_7_clique",
    "graph_4_cycle", "graph_5_cycle", "graph_6_cycle", "graph_7_cycle",
    "graph_sel_3clique_50", "graph_sel_4clique_50", "graph_sel_4cycle_50", "join_star_tpch", "join_chain_region", "agg_group", "sub_correlated_agg",
)


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", 8))
    spark = build_session("bench", local_master(), partitions=cpus, **{"spark.driver.memory": "8g"})
    every, took = catalogue(), {}
    for name in HEADLINE:
        began = time.perf_counter()
        every[name](spark, directory).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": directory.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
