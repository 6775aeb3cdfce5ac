"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregate-then-join steps on narrow (src, dst) rows, so a hot
vertex is a pre-aggregated minimum plus a join that adaptive execution can split;
no adjacency list is ever gathered. The minima are written first: both sides of
the join are then shuffled for it, which is what adaptive splitting needs. Rounds are logarithmic in the diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.storage import Scratch, discard, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "least")
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialise(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    links = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return links.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Return ``(node, component)`` for every vertex of ``edges``; component is its least vertex.

    Self loops and repeated edges are harmless, rows with a null end are ignored,
    and vertices without an edge to another vertex are absent. An empty input
    gives an empty result. What is written on the way is deleted again.
    """
    with Scratch(edges.sparkSession) as scratch:
        now = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v").distinct()
        now = materialise(now, "edges")
        seen = None
        for _ in range(max_rounds):
            state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if state == seen or not state[0]:
                break
            seen, before = state, now
            now = materialise(_small_star(materialise(_large_star(now), "edges")), "edges")
            discard(before)
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        scratch.keep(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())
