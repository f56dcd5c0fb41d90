"""Connected components by star rounds: the core library's union-find over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored

#: Rounds take about log^2 of the longest chain; more than these mean an error.
ROUNDS = 200


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over ``links`` (u, v), for each node of a link.

    Large-star and small-star alternate, each by a pre-aggregated least
    neighbour, so no node's neighbours are gathered; every round is stored.
    """
    edges = stored(links.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(ROUNDS):
        now = tuple(edges.agg(F.count("*"), F.sum(F.expr("cast(u as decimal(38,0))")), F.sum(F.expr("cast(v as decimal(38,0))"))).first())
        if now == before:
            nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return nodes.union(edges.select("v", "v")).distinct()
        before = now
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = stored(large.join(least, "u").select(F.explode(ends).alias("e")).select("e.u", "e.v").where("u <> v").distinct())
    raise RuntimeError(f"components didn't settle in {ROUNDS} rounds")
