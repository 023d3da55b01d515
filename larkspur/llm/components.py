"""Connected components of a graph given as pairs of numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.workspace import forget, written


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``edges (src, dst)``.

    ``component`` is the smallest node reachable.  Large-star and small-star
    steps alternate until no edge changes: each pulls a node's neighbours to the
    smallest one, so that the number of rounds grows with the logarithm of a
    component's size.  Minima are aggregated partially before they are shuffled,
    and each round's edges are written to shared storage.
    """
    now = edges.where("src != dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    now, before = written(now, "cc"), None
    for _ in range(max_rounds):
        both = now.unionAll(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = written(both.groupBy("src").agg(F.least("src", F.min("dst")).alias("low")), "cc-low")
        large = both.join(low, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        large = large.unionAll(low.where("src > low").select("src", F.col("low").alias("dst"))).where("src != dst")
        large = written(large.distinct(), "cc-large")
        forget(now, low)
        low = written(large.groupBy("src").agg(F.min("dst").alias("low")), "cc-low")
        small = large.join(low, "src").where("dst != low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        now = written(small.unionAll(low.select("src", F.col("low").alias("dst"))).distinct(), "cc")
        forget(large, low)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components are not complete after {max_rounds} rounds")
    star = now.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return star.unionAll(star.select(F.col("component").alias("node"), "component").distinct())
