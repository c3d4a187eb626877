"""Connected components of a distributed edge list.

Large-star / small-star rounds: each replaces a node's neighbours by links to the
smallest one it knows. Edges stay in Spark tables; a round is written to the shared
folder, so lineage stays short and a lost executor costs one round. The minima are
written too before they are joined: a join of two plain tables can be split where a hub
has most of the edges, one with an aggregate on the same key cannot. The driver sees one
row of counts per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseline.durable import materialise


def _minima(directed: DataFrame) -> DataFrame:
    return directed.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialise(_minima(both).select("u", F.least("u", "m").alias("m")), "minima")
    return (both.where("v > u").join(least, "u").where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` point from the larger to the smaller node."""
    least = _minima(edges)
    return (edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) of every node with an edge; component is the smallest node
    reachable. Edges may repeat and may point either way; null ends are ignored."""
    now = edges.select(F.greatest(left, right).cast("long").alias("u"), F.least(left, right).cast("long").alias("v"))
    now = materialise(now.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("u") != F.col("v"))).distinct(), "edges")
    before = None
    while True:
        now = materialise(_small_star(_large_star(now)), "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
