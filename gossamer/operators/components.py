"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.checkpoints import checkpoint


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Label every vertex of an undirected edge list with the smallest vertex of its component.

    Returns ``(id, component)``, one row per vertex that occurs in an edge with two known ends; ``component`` has
    the type of the ends. Self-loops give a vertex its own component, edges with a null end are ignored, repeated
    and reversed edges change nothing, and an empty list gives no rows.

    Each round is two aggregations with map-side combine and two equi-joins that AQE may split when a hub
    is hot; the edge list is checkpointed after every round, and only its count and hash reach the driver.
    """
    known = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    vertices = known.select(F.col("a").alias("id")).union(known.select(F.col("b").alias("id"))).distinct()
    # invariant: b < a
    pairs = checkpoint(known.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _signature(pairs)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = checkpoint(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        after = _signature(pairs)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return vertices.join(pairs.select(F.col("a").alias("id"), F.col("b").alias("component")), "id", "left").select(
        "id", F.coalesce("component", "id").alias("component")
    )
