"""Operators over ordered observations: occurrence numbers, transitions, stable polls, carried state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.functions.text import stable_hash
from tracelake.functions.urls import origin, request_path


def occurrence_ids(rows: DataFrame, parts: list[str], order: list[str]) -> DataFrame:
    """The rows with `occurrence`, from 1 among equal parts, and `occurrence_id`, hashed from the parts and it."""
    at = W.partitionBy(*parts).orderBy(*order)
    rows = rows.withColumn("occurrence", F.row_number().over(at).cast("long"))
    key = F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts], F.col("occurrence").cast("string"))
    return rows.withColumn("occurrence_id", stable_hash(key))


def transitions(rows: DataFrame, key: str, order: list[str], url: str) -> DataFrame:
    """(key, before_url, after_url, kind) of each step of a key's observations."""
    steps = rows.withColumn("before_url", F.lag(url).over(W.partitionBy(key).orderBy(*order))).filter("before_url is not null")
    return steps.select(key, "before_url", F.col(url).alias("after_url"), transition_kind(F.col("before_url"), F.col(url)).alias("kind"))


def transition_kind(before: Column, after: Column) -> Column:
    same = F.when(origin(before) != origin(after), "cross-origin-attempt").when(before == after, "same-url")
    return same.when(request_path(before) == request_path(after), "hash-change").otherwise("same-origin-url-change")


def stable_runs(rows: DataFrame, key: str, order: list[str], signature: str) -> DataFrame:
    """The rows with `run`, the number of the run of equal signatures, and `stable_polls`, the place in it."""
    at = W.partitionBy(key).orderBy(*order)
    change = F.when(F.lag(signature).over(at).eqNullSafe(F.col(signature)), 0).otherwise(1)
    rows = rows.withColumn("__change", change).withColumn("run", F.sum("__change").over(at.rowsBetween(W.unboundedPreceding, 0)))
    return rows.withColumn("stable_polls", F.row_number().over(W.partitionBy(key, "run").orderBy(*order)).cast("long")).drop("__change")


def first_ready(rows: DataFrame, key: str, order: list[str], signature: str, evidence: str, loaders: str, polls: int = 2) -> DataFrame:
    """The first observation of each key at which its content is there, nothing loads and `polls` polls were equal."""
    runs = stable_runs(rows, key, order, signature)
    ready = runs.filter((F.col(evidence) > 0) & (F.col(loaders) == 0) & (F.col("stable_polls") >= polls))
    return ready.groupBy(key).agg(F.min(F.struct(*order)).alias("ready_at"), F.count(F.lit(1)).alias("ready_polls"))


def conflicting_repeats(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, n, n_values, status): repeated observations of a key, a duplicate if all are equal, else a conflict."""
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct(*values)).alias("n_values")).filter("n > 1")
    return found.withColumn("status", F.when(F.col("n_values") > 1, "conflict").otherwise("duplicate"))
