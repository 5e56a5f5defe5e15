"""Chains of pointers by doubling: every node points to one other at most, and is told where its chain ends.

In each round a node that has not arrived takes over where the node that it points to points to, so a chain of n takes about
log2(n) joins, each on the node alone. A node that is still under way after more steps than there are pointers goes round a
circle. Arrived nodes are written once and not again.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut


class Chains(NamedTuple):
    """ended (node, end, steps, weight, carried columns); circular (node, ring, entry): ring is the least node of the circle
    that the chain runs into, entry the first of its nodes that the chain meets (itself for one on the circle)."""

    ended: DataFrame
    circular: DataFrame


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _double(pointers: DataFrame, carried: list[str], trail: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The arrived nodes and those that go round, with the node `to` that they have come to and the least one passed."""
    new = [F.col(c) for c in carried]
    if trail:
        new.append(F.when(F.col("next").isNull(), F.slice(F.array(trail), 1, 0)).otherwise(F.array(trail)).alias("trail"))
    more = ["trail"] if trail else []
    rows = pointers.select("node", F.coalesce("next", "node").alias("to"), F.col("next").isNull().alias("done"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.when(F.col("next").isNull(), 0).otherwise(F.col("weight")).cast("long").alias("weight"), F.col("node").alias("least"), *new)
    state = cut(rows, "chains", by=["done"])
    arrived, open_ = [state.filter("done")], state.filter("not done")
    rounds = open_.count().bit_length() + 1
    for _ in range(rounds):
        if open_.isEmpty():
            break
        hop = _union([*arrived, open_]).select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("done").alias("done2"), F.col("steps").alias("steps2"), F.col("weight").alias("weight2"), F.col("least").alias("least2"), *[F.col(c).alias(f"{c}2") for c in [*carried, *more]])
        step = open_.join(hop, "to", "left")
        step = step.select(
            "node", F.coalesce("to2", "to").alias("to"), F.coalesce("done2", F.lit(True)).alias("done"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"),
            (F.col("weight") + F.coalesce("weight2", F.lit(0))).alias("weight"), F.least("least", "least2").alias("least"), *[F.coalesce(c, f"{c}2").alias(c) for c in carried], *[F.concat(c, F.coalesce(f"{c}2", F.slice(c, 1, 0))).alias(c) for c in more],
        )
        state = cut(step, "chains", by=["done"])
        arrived.append(state.filter("done"))
        open_ = state.filter("not done")
    return _union(arrived), open_


def follow(pointers: DataFrame, carried: list[str] | None = None, trail: str | None = None) -> Chains:
    """Where the chains of pointers (node, next, weight, carried columns) end: at a node without next, or at a name that is no
    node. weight (1 if the column is missing) is summed over the nodes before the end; of a carried column the first value that
    is not null, from the node itself to its end, is kept. trail names a column whose values on the nodes before the end are
    listed, the node's own first; such lists are as long as the chains. Nodes are unique and not null."""
    carried = carried or []
    if "weight" not in pointers.columns:
        pointers = pointers.withColumn("weight", F.lit(1))
    arrived, open_ = _double(pointers, carried, trail)
    ended = arrived.select("node", F.col("to").alias("end"), "steps", "weight", *carried, *(["trail"] if trail else []))
    on_ring = open_.select(F.col("to").alias("node")).distinct()
    rings = cut(open_.join(on_ring, "node", "left_semi").select(F.col("node").alias("to"), F.col("least").alias("ring")), "rings")
    tails = open_.select("node").join(pointers.select("node", "next"), "node").join(rings.select(F.col("to").alias("node")), "node", "left_anti")
    entries = rings.select(F.col("to").alias("node"), F.col("to").alias("entry"))
    if not tails.isEmpty():
        entries = entries.unionByName(_double(tails.withColumn("weight", F.lit(1)), [])[0].select("node", F.col("to").alias("entry")))
    circular = open_.select("node", "to").join(rings, "to").select("node", "ring").join(entries, "node")
    return Chains(ended, cut(circular, "circular"))
