"""Connected components over edge tables, by alternating star contractions.

Each step joins edges with one minimum per node and stores the result, so no step gathers a node's neighbours; a node with very
many edges is aggregated map-side, and the join with its minimum has two plain shuffles that can be split. Edges are small beside
the texts they come from: their stages run as many tasks as the number of edges asks for, not one for each shuffle partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribelake.session import checkpointed

#: Edges that a task takes at most, and the tasks that there are at least (if there are as many partitions).
EDGES, TASKS = 50_000, 16


def _minima(edges: DataFrame, tasks: int) -> DataFrame:
    return checkpointed(edges.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks))


def _large(edges: DataFrame, tasks: int) -> DataFrame:
    """Every neighbour above a node is tied to the node's least neighbour (or itself); a tie may come twice."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _minima(both, tasks).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(tasks)


def _small(edges: DataFrame, tasks: int) -> DataFrame:
    """Every neighbour below a node, and the node, is tied to the least of them. Edges have u > v."""
    tied = edges.join(_minima(edges, tasks), "u").coalesce(tasks)
    down = tied.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v")
    return down.distinct().coalesce(tasks)


def stars(edges: DataFrame) -> DataFrame:
    """``u, v``: each node that is not the least of its component, with the least one. ``edges`` has ``u, v`` in any order."""
    turned = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = checkpointed(turned)
    tasks = max(TASKS, -(-edges.count() // EDGES))
    edges = edges.coalesce(tasks)
    while True:
        # Done when no parent is a child and no child has two parents.
        ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if ends.where("up > 0 AND up + down > 1").coalesce(tasks).isEmpty():
            return edges
        edges = checkpointed(_small(checkpointed(_large(edges, tasks)), tasks))
