"""Connected components of an undirected graph, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import FEW_ROWS, HOT_SHARE, join_per_key, shared_dir

#: Edges that one task of a round handles.
EDGES_PER_TASK = 200_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Component of every node that has an edge: columns node and component (its least node).

    Alternates two star rewrites until nothing changes: large-star links every larger neighbour of a node to the least
    neighbour, small-star links the smaller ones. Edges point from a smaller node to a larger one, so a node's least neighbour is the
    least start of the edges that end in it, and each edge gives one edge. Their number never grows, and rounds grow with the
    logarithm of the longest path. Least neighbours are aggregates, pre-aggregated on the map side; where they join the edges again,
    those of a hub come by broadcast, so that its edges are never gathered. Each round is cut with checkpoint(), which survives lost
    executors. Loops, repeated edges and edges with a null end are allowed; the latter are ignored.
    """
    shared_dir(edges.sparkSession)
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    now = now.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct().checkpoint()  # u < v
    state = _state(now)
    while state[0]:
        # as many tasks as the edges are worth, so that a small graph doesn't leave a file for each of many empty partitions
        tasks = state[0] // EDGES_PER_TASK + 1
        large = _hung_lower(now.coalesce(tasks), state[0], tasks).coalesce(tasks)
        lowest = large.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n")).coalesce(tasks)
        small = join_per_key(large, lowest, "v", state[0])
        # the least neighbour takes the node itself, and the node's other neighbours
        small = small.select(F.col("m").alias("u"), F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"))
        now = small.coalesce(tasks).distinct().coalesce(tasks).checkpoint()
        before, state = state, _state(now)
        if state == before:
            break
    members = now.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return members.unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())


def _hung_lower(edges: DataFrame, total: int, tasks: int) -> DataFrame:
    """Edges u, v with the least node that u itself hangs on in place of u."""
    least = edges.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("u"), "m").coalesce(tasks)
    if total <= FEW_ROWS:
        found = edges.join(least, "u", "left")
    else:
        hubs = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * HOT_SHARE > total).select("u")
        found = edges.join(F.broadcast(hubs), "u", "left_anti").join(least, "u", "left").unionByName(edges.join(F.broadcast(hubs.join(least, "u", "left")), "u"))
    return found.select(F.coalesce("m", "u").alias("u"), "v")


def _state(edges: DataFrame) -> tuple[int, int, int]:
    """Number of edges and two sums of their hashes: equal for equal sets of edges."""
    h = lambda seed: F.sum(F.xxhash64("u", "v", F.lit(seed)) % (1 << 40))
    r = edges.agg(F.count(F.lit(1)).alias("n"), h(1).alias("x"), h(2).alias("y")).first()
    return r["n"], r["x"] or 0, r["y"] or 0
