"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A node with more than 1 / HUBS of all edges, and more than FEW, is a hub: there are fewer than HUBS of them, whatever the table.
HUBS, FEW = 10_000, 64


def with_least(edges: DataFrame, n: int) -> DataFrame:
    """(u, v, m) for n edges (u, v): m is the least of u and its neighbours v.

    The minimum combines before it is shuffled. The edges of a hub are not dealt by their node: fewer than
    HUBS rows (u, m), the hubs', are broadcast. The other nodes' edges meet their minimum in a join by node,
    where no node has more than FEW rows or one in HUBS of all.
    """
    low = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    is_hub = F.col("n") > max(FEW, n // HUBS)
    hubs = F.broadcast(low.where(is_hub).select(F.col("u").alias("hub"), "m"))
    of_hubs = edges.join(hubs, F.col("u") == F.col("hub")).select("u", "v", "m")
    others = edges.join(hubs, F.col("u") == F.col("hub"), "left_anti")
    return of_hubs.union(others.join(low.where(~is_hub).select("u", "m"), "u").select("u", "v", "m"))


def connected_components(edges: DataFrame, cut: Callable[[DataFrame], DataFrame], drop: Callable[..., None] | None = None) -> DataFrame:
    """(node, component) of every node that an edge (a, b) names; component is the smallest node that can be reached.

    Alternates two rounds until nothing changes: each node's larger neighbours are linked to its
    smallest neighbour, then its smaller ones and itself are. A round is a minimum by node and a join
    (see with_least), so that a hub's edges stay dealt out. The number of rounds grows with the
    logarithm of the longest path. cut(df) writes a table and reads it back; drop(old) frees one.
    Loops and repeated edges count once; an edge with a null end is none.
    """
    pairs = edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("a is not null and b is not null")
    nodes = cut(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    now = cut(pairs.where("u < v").distinct())
    n, before = now.count(), None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(with_least(both, 2 * n).where("v > u and m < v").select(F.col("m").alias("u"), "v").distinct())
        # large-star leaves edges (m, v) with m < v; small-star goes by the larger end.
        small = with_least(large.select(F.col("v").alias("u"), F.col("u").alias("v")), n)
        nxt = cut(small.select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).where("u < v").distinct())
        state = tuple(nxt.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if drop:
            drop(now, large)
        now, n = nxt, state[0]
        if state == before:
            break
        before = state
    component = now.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))
    return nodes.join(component, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
