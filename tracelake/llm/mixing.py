"""Operator 4, mixing sources to target weights: Poisson replication.

Every document is repeated as often as a Poisson distribution says whose mean is the target repetition rate of its
source; the distribution is inverted at a number hashed from the seed and the identifier, so a run can be repeated. The
copies are then shuffled globally: dealt and ordered by a hash of seed, identifier and copy number.

Defined results: a null source is a source of its own. A source that the weights leave out gets weight 0 and no rows.
Rows repeated under one identifier get equal counts; a null identifier counts as the empty text. Texts are not looked at.
An empty table gives an empty result. Further columns pass through; an input column named copy_no is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, stored, unit


@dataclass(frozen=True)
class MixParams:
    """weights: target share by source, equal shares where None. epochs: expected rows out per row in."""

    weights: dict[str, float] | None = None
    epochs: float = 1.0
    seed: str = "mix"


def rates(docs: DataFrame, params: MixParams = MixParams(), source_col: str = "source") -> DataFrame:
    """(source, rate, low, cdf): the mean repetition rate of each source, and its distribution function at low, low + 1, ..."""
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if params.weights is None:
        counts = counts.withColumn("w", F.lit(1.0))
    else:
        pairs = [x for k, v in params.weights.items() for x in (F.lit(k), F.lit(float(v)))]
        counts = counts.withColumn("w", F.coalesce(F.create_map(*pairs)[F.col("source").cast("string")], F.lit(0.0)) if pairs else F.lit(0.0))
    counts = stored(counts, "sources")
    rows, weight = counts.agg(F.sum("n"), F.sum("w")).first()
    rate = F.lit(params.epochs) * F.lit(rows or 0) * F.col("w") / F.lit(weight) / F.col("n") if weight else F.lit(0.0)
    known = counts.select("source", rate.alias("rate")).filter("rate > 0")
    reach = 12 * F.sqrt("rate") + 16  # what lies further off is far below the resolution of the hashed number
    low = F.greatest(F.lit(0), F.floor(F.col("rate") - reach)).cast("long")
    cells = known.withColumn("low", low).withColumn("k", F.explode(F.sequence("low", F.ceil(F.col("rate") + reach).cast("long"))))
    cells = cells.withColumn("cdf", F.sum(F.exp(-F.col("rate") + F.col("k") * F.ln("rate") - ln_factorial("k"))).over(W.partitionBy("source").orderBy("k")))
    cdf = F.transform(F.array_sort(F.collect_list(F.struct("k", "cdf"))), lambda x: x["cdf"])  # a square root of the rate
    return stored(cells.groupBy("source", "rate", "low").agg(cdf.alias("cdf")), "rates")


def ln_factorial(k: str) -> Column:
    """ln k! by Stirling's series, exact up to 20."""
    x = F.greatest(F.col(k), F.lit(20)).cast("double")
    series = x * F.ln(x) - x + F.ln(2 * pi * x) / 2 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(F.col(k) <= 20, F.ln(F.factorial(F.least(F.col(k), F.lit(20)).cast("int")))).otherwise(series)


def replicate(docs: DataFrame, params: MixParams = MixParams(), id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The documents, each as often as drawn, with copy_no (from 1), in hashed order."""
    docs = docs.drop("copy_no") if id_col != "copy_no" else docs
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"), name.alias("name"), F.col(source_col).alias("of"))
    rows = rows.join(rates(docs, params, source_col), F.col("of").eqNullSafe(F.col("source")))
    draw = unit(F.md5(F.concat(F.lit(params.seed + "|"), F.col("name"))))
    rows = rows.withColumn("copies", (F.col("low") + F.size(F.filter("cdf", lambda x: x < draw))).cast("int")).filter("copies > 0")
    rows = rows.select("row", "name", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"))
    place = F.xxhash64(F.lit(params.seed), F.col("name"), F.col("copy_no"))
    rows = rows.repartition(partitions(docs) * max(1, ceil(params.epochs)), place).sortWithinPartitions(place)
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns], "copy_no")
