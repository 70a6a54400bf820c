"""Connected components of a link table, wholly as joins and aggregates."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, functions as F

from sqlkiln.session import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every long-valued node that has a link; nodes of
    one component share a root (some node of it).

    Contraction: in each round every node picks the smallest node of its
    closed neighbourhood under a fresh random order, links and roots are
    mapped to the picks, and links inside one pick disappear. The image of a
    connected graph is connected, so the last picks are the components; the
    random order shrinks any graph, chains included, geometrically.

    A hub's links are only ever aggregated with map-side combine or joined
    with the pick table, whose keys are unique, so that adaptive execution
    can split a hub. Each round is cut with a reliable checkpoint."""
    pair = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    edges = materialize(pair.unionAll(pair.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = materialize(edges.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")))
    order = random.Random(0)
    while not edges.isEmpty():
        key = F.lit(order.getrandbits(63)).cast("long")
        mixed = F.least(F.col("a").bitwiseXOR(key), F.col("b").bitwiseXOR(key))
        picks = materialize(edges.groupBy(F.col("a").alias("at")).agg(F.min(mixed).bitwiseXOR(key).alias("pick")))
        left = edges.join(picks, F.col("a") == F.col("at")).select(F.col("pick").alias("a"), "b")
        both = left.join(picks, F.col("b") == F.col("at")).select("a", F.col("pick").alias("b"))
        edges = materialize(both.where("a <> b").distinct())
        moved = roots.join(picks, F.col("root") == F.col("at"), "left")
        roots = materialize(moved.select("node", F.coalesce("pick", "root").alias("root")))
    return roots
