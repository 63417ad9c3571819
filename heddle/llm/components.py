"""Connected components by alternating large-star and small-star, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

#: Edges that a task of a step may well hold; steps of few edges run in few tasks, whatever the session's partitions.
TASK_EDGES = 200_000


def _mark(edges: DataFrame) -> tuple:
    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))  # noqa: E731  # ids may be any longs
    r = edges.agg(F.count(F.lit(1)), wide("lo"), wide("hi")).first()
    return tuple(r)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """id, component (the smallest id that it reaches), for every id that has an edge to a smaller one.

    Each step is written to the shared folder. A node's least neighbour is a map-side minimum that is written before it
    is joined, so that the join of a node with very many neighbours can be split.
    """
    both = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi <> lo").distinct()
    now = store.keep(both, "edges")
    mark = _mark(now)
    for _ in range(rounds):
        if not mark[0]:
            break
        tasks = 1 + 2 * mark[0] // TASK_EDGES
        least = store.keep(now.groupBy("hi").agg(F.min("lo").alias("m")).coalesce(tasks), "least")
        # Small star: what lies below a node meets at the least of it.
        meet = now.join(least, "hi")
        small = store.keep(meet.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").union(least.select("hi", F.col("m").alias("lo"))).distinct().coalesce(tasks), "small-star")
        # Large star: what lies above a node moves to the least that the node knows.
        least = store.keep(small.groupBy("hi").agg(F.min("lo").alias("m")).coalesce(tasks), "least")
        up = small.join(least.select(F.col("hi").alias("lo"), "m"), "lo", "left")
        now = store.keep(up.select("hi", F.coalesce("m", "lo").alias("lo")).distinct().coalesce(tasks), "large-star")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise ValueError(f"components not closed in {rounds} rounds")
    return now.groupBy("hi").agg(F.min("lo").alias("component")).withColumnRenamed("hi", "id")
