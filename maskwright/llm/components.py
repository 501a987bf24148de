"""Connected components by alternating large-star and small-star rounds.

Every round is two group-by-minimum joins, so the edges of a hub are split over
tasks: its minimum is pre-aggregated before the shuffle, and the join back is
salted. After Kiveris et al.,
"Connected Components in MapReduce and Beyond" (2014).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import salted_join, shared_checkpoint


def _minimum(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a").agg(F.min("b").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Point every larger neighbour of a vertex at the vertex's smallest neighbour."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    small = _minimum(both).select("a", F.least("a", "m").alias("m"))
    return salted_join(both, small, "a", F.col("b")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Point a vertex and its smaller neighbours at the smallest of them. Edges have a > b."""
    small = _minimum(edges)
    moved = salted_join(edges, small, "a", F.col("b")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
    return moved.unionAll(small.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Map each vertex of ``edges(a, b)`` that is not its component's smallest to that one.

    Returns ``(vertex, root)``; a vertex without an edge, and each root, has no
    row. Null ends are not vertices: such rows are left out. An empty table
    gives an empty table.
    """
    state = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state = shared_checkpoint(state)
    seen = None
    while True:
        # Two equal states in a row end the loop; the sum over hashed edges does not depend on order.
        mark = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return state.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
        seen = mark
        state = shared_checkpoint(_small_star(_large_star(state)))
