"""Connected components by alternating large-star and small-star steps, each step joins and aggregates.

Neighbour minima come from partial aggregates and a join that adaptive execution can split, so a node
with a third of all edges does not land in one task. Each round is a table in the shared folder:
lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportlake.llm.common import drop_table, store


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (u, v: long); component is the smallest node reachable.

    Self loops and repeated edges do no harm; rows with a null end are left out; no edges give no rows.
    """
    e = store(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _print(e)
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = e.select(F.col("v").alias("u"), F.col("u").alias("v")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = store(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        mark = _print(after)
        drop_table(e)
        e = after
        if mark == before:
            break
        before = mark
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())


def _print(e: DataFrame) -> tuple:
    """Two numbers that tell one edge set from another."""
    h = F.xxhash64("u", "v")
    return tuple(e.agg(F.count("*"), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 40)))).first())
