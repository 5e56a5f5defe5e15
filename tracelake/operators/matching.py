"""Join patterns that the domains share: unique matches, first matches, two-sided reconciliation, violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def unique_left_join(left: DataFrame, right: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Every left row with `name`, the value of the only right row with its keys (null if there are none or several), and
    `n_<name>`, how many there are. The right side is aggregated before the join, so no left row multiplies."""
    found = right.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"n_{name}"), F.min(value).alias("__only"))  # no row of the right side is kept
    rows = left.join(found, keys, "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0).cast("long")))
    return rows.withColumn(name, F.when(F.col(f"n_{name}") == 1, F.col("__only"))).drop("__only")


def first_match(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order, as one aggregation (partial before the shuffle, unlike a rank)."""
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), place).alias("__row"))
    return best.select("__row.*")


def longest_prefix(rows: DataFrame, value: str, prefixes: list[str], name: str) -> DataFrame:
    """The rows with the longest of a configured list of prefixes that their value begins with, else null."""
    found = F.lit(None).cast("string")
    for prefix in sorted(prefixes, key=lambda p: (len(p), p)):
        found = F.when(F.startswith(F.col(value), F.lit(prefix)), F.lit(prefix)).otherwise(found)
    return rows.withColumn(name, found)


def reconcile(declared: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """(key, n_static, n_runtime, status, results) for each key of declared (key null: dynamic) and observed rows.

    dynamic: ambiguous for each row. Several declared and some observed: ambiguous for each observation. One declared:
    corroborated once. Only declared: static-only for each row. Only observed: runtime-only for each observation."""
    s = declared.groupBy(key).agg(F.count(F.lit(1)).alias("n_static"))
    r = observed.groupBy(key).agg(F.count(F.lit(1)).alias("n_runtime"))
    both = s.join(r, key, "full").fillna(0, ["n_static", "n_runtime"])
    n_s, n_r = F.col("n_static"), F.col("n_runtime")
    status = F.when(F.col(key).isNull(), "ambiguous").when(n_s == 0, "runtime-only").when(n_r == 0, "static-only").when(n_s > 1, "ambiguous").otherwise("corroborated")
    results = F.when(F.col(key).isNull() | (n_r == 0), n_s).when((n_s == 1), 1).otherwise(n_r)
    return both.select(key, "n_static", "n_runtime", status.alias("status"), results.cast("long").alias("results"))


def status_summary(results: DataFrame, statuses: list[str], column: str = "status", weight: Column | None = None) -> DataFrame:
    """(status, results), with a zero for each status that does not occur."""
    spine = results.sparkSession.createDataFrame([(s,) for s in statuses], f"{column} string")
    counts = results.groupBy(column).agg(F.sum(weight if weight is not None else F.lit(1)).cast("long").alias("results"))
    return spine.join(counts, column, "left").fillna(0, ["results"])


def missing_references(rows: DataFrame, column: str, known: DataFrame, known_column: str, rule: str) -> DataFrame:
    """(rule, subject): references that no known row answers. An empty result means that the rule holds."""
    named = known.select(F.col(known_column).alias("__known"))
    lost = rows.filter(F.col(column).isNotNull()).join(named, F.col(column) == F.col("__known"), "left_anti")
    return lost.select(F.lit(rule).alias("rule"), F.col(column).cast("string").alias("subject"))


def duplicate_keys(rows: DataFrame, column: str, rule: str) -> DataFrame:
    """(rule, subject): keys that stand more than once."""
    found = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return found.select(F.lit(rule).alias("rule"), F.col(column).cast("string").alias("subject"))


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """The rows numbered from 1 within each key."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long"))
