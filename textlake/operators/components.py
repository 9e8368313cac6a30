"""Connected components of a graph of any size, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 64) -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node it reaches.

    Each round first ties every larger neighbour of a node to the node's smallest
    neighbour, then every smaller neighbour likewise. Both halves keep the components,
    shorten paths by half or more, and end in one star per component. A round aggregates
    minima before it shuffles, joins on node ids and writes its edges to the shared
    folder; only the number of changed edges comes to the driver. Self-loops, repeated
    and reversed edges are allowed; null ends are dropped; no edge gives no row."""
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    now = materialize(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # every edge now runs from a larger node to a smaller one
        down = large.where("a <> b").distinct()
        smallest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            down.join(smallest, "a")
            .select(F.explode(F.array(
                F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b").where("a <> b").distinct()
        )
        new = materialize(small, "edges")
        done = new.join(now, ["a", "b"], "left_anti").isEmpty() and new.count() == now.count()
        now = new
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    return (
        now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        .union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    )
