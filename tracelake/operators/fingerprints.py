"""States as multisets of their elements: fingerprints that are added up before the shuffle, and their verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.text import stable_hash


def state_fingerprints(elements: DataFrame, state: str, parts: list[str]) -> DataFrame:
    """(state, n, fingerprint) for elements (state, parts): equal for states with the same elements equally often, in whatever
    order. Two hashes of each element are summed, so tasks add up their own elements and no state is ever gathered. Missing
    parts count as empty ones."""
    told = F.concat_ws("\u001f", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])
    sums = [F.sum(F.xxhash64(F.lit(seed), told).cast("decimal(20,0)")).cast("string").alias(f"s{seed}") for seed in (1, 2)]
    found = elements.groupBy(state).agg(F.count(F.lit(1)).alias("n"), *sums)
    return found.select(state, "n", stable_hash(F.concat_ws("|", F.col("n").cast("string"), "s1", "s2")).alias("fingerprint"))


def fingerprint_groups(elements: DataFrame, state: str, parts: list[str]) -> DataFrame:
    """(fingerprint, states, first_state, n, verified): the states of each fingerprint. verified: each element stands in all
    of them, equally often, so that the states are equal and not only their hashes."""
    prints = state_fingerprints(elements, state, parts)
    groups = prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("states"), F.min(state).alias("first_state"), F.min("n").alias("n"))
    keys = [F.coalesce(F.col(p).cast("string"), F.lit("")).alias(f"k{i}") for i, p in enumerate(parts)]
    names = [f"k{i}" for i in range(len(parts))]
    shared = elements.select(state, *keys).groupBy(state, *names).agg(F.count(F.lit(1)).alias("times")).join(prints.select(state, "fingerprint"), state)
    spread = shared.groupBy("fingerprint", *names).agg(F.count(F.lit(1)).alias("held"), (F.min("times") == F.max("times")).alias("even"))
    worst = spread.groupBy("fingerprint").agg(F.min("held").alias("held"), F.every("even").alias("even"))
    return groups.join(worst, "fingerprint").select("fingerprint", "states", "first_state", "n", ((F.col("held") == F.col("states")) & F.col("even")).alias("verified"))
