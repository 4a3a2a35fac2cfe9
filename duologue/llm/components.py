"""Connected components by alternating large-star and small-star rounds over an edge table.

Every round is two minimum aggregates and two joins on the node, written to the shared folder.
Hubs are safe: the minimum is combined before the shuffle, and the join's other side has one row
a node, so a hub's edges can be split among tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duologue.llm.store import Scratch

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v), u > v. Each node's neighbours move to the smallest of them and itself."""
    seen = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = seen.join(least, "u")
    if large:
        moved = moved.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return moved.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node reachable. edges: (a, b), long, not null."""
    scratch = Scratch(edges.sparkSession, "components")
    now = scratch.keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges-0")
    for i in range(1, MAX_ROUNDS + 1):
        after = scratch.keep(_star(_star(now, True), False), f"edges-{i}")
        n, m = now.count(), after.count()
        # it has converged when no row is new: stars whose centres are smallest map onto themselves
        same = n == m and after.join(now, ["u", "v"], "left_anti").isEmpty()
        scratch.drop(f"edges-{i - 1}")
        now = after
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
