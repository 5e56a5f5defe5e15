"""Connected components of a link table, by alternating star steps over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its least neighbour (or itself) to its larger neighbours."""
    both = stored(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
    least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands its least neighbour to its smaller neighbours and itself. Edges run from larger to smaller."""
    down = edges.filter("u <> v")
    least = stored(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    kept = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).union(kept)


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u, v), both long and not null -> (node, component), component being the least node that is reachable.
    Nodes whose only link is to themselves are left out."""
    now = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, seen = stored(now, "edges"), None
    while True:
        sign = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == seen:
            break
        seen = sign
        now = stored(_small_star(stored(_large_star(now).distinct(), "large")).distinct(), "edges")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
