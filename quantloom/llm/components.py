"""Connected components of an edge table by alternating large and small stars.

An edge table of at most SMALL_EDGES rows is kept in one partition, where the same
steps need no shuffle; a larger one is shuffled by node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, is_small

SMALL_EDGES = 50_000


def _large_star(edges: DataFrame, keep) -> DataFrame:
    """Larger neighbours of each node hang below the least of its neighbours and itself."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = keep(keep.local(both).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
    return keep.local(both).join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(edges: DataFrame, keep) -> DataFrame:
    """Smaller neighbours of each node, and the node, hang below the least of them."""
    least = keep(edges.groupBy("b").agg(F.min("a").alias("m")))
    moved = edges.join(least, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("e"))
    return moved.select("e.a", "e.b").where("a <> b").distinct()


class _Keep:
    """Writes a step's table and reads it back, in one partition if the edges are few."""

    def __init__(self, scratch: Scratch, name: str):
        self.scratch, self.name, self.n, self.small = scratch, name, 0, False

    def local(self, df: DataFrame) -> DataFrame:
        return df.coalesce(1) if self.small else df

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        return self.local(self.scratch.save(df, f"{self.name}-{self.n}"))


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, root) for every node of edges(a, b), root being the least node it reaches; roots map to themselves."""
    keep = _Keep(scratch, name)
    edges = keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    keep.small = is_small(edges, SMALL_EDGES)
    edges, seen = keep.local(edges), None
    while True:
        edges = keep(_small_star(keep(_large_star(edges, keep)), keep))
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select("a", "a").distinct().toDF("node", "root"))
