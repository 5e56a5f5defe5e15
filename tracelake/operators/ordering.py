"""Total orders and numbers within groups, without one task holding an order or a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import cut

#: Names of Spark collations: code points; the root collation of Unicode; the same without case.
BINARY, UNICODE, UNICODE_CI = "UTF8_BINARY", "UNICODE", "UNICODE_CI"
#: Fixed value: rows of one key that a task may have to itself.
LARGE = 1_000_000


def collated(value: Column, collation: str = UNICODE) -> Column:
    """A text that sorts by a collation."""
    return F.collate(value, collation)


def total_order(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """The rows with their place, from 1, in the given order (which ties must not leave open). The rows are sorted over
    ranges of the order and written once; each row's number within its range is shifted by the sizes of the ranges before it,
    of which the driver's plan holds one row each. Equal rows of the order, however many, may share a range."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 1)
    keys = {f"o{i}": c for i, c in enumerate(order)}
    packed = rows.select(F.struct(*rows.columns).alias("row"), *[c.alias(k) for k, c in keys.items()])
    ranged = packed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    held = cut(ranged.select("row", F.monotonically_increasing_id().alias("at")), "order")
    part = F.shiftright("at", 33).alias("part")
    sizes = held.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shifts = cut(sizes.select("part", before.alias("before")), "shifts")
    joined = held.withColumn("part", part).join(F.broadcast(shifts), "part")  # a row for each range
    place = F.col("at").bitwiseAND(F.lit(2**33 - 1)) + 1 + F.col("before")
    return joined.select(*[F.col("row")[c].alias(c) for c in rows.columns if c != name], place.alias(name))


def large_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that hold more than LARGE rows, stored: more than one task should be given."""
    return cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LARGE).select(*keys), "large")


def split_off(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows without and with one of the given keys."""
    names = [f"__{c}" for c in keys.columns]
    same, given = F.lit(True), keys.toDF(*names)
    for c, name in zip(keys.columns, names):
        same = same & F.col(c).eqNullSafe(F.col(name))
    return tuple(rows.join(given, same, how) for how in ("left_anti", "left_semi"))


def numbers_within(rows: DataFrame, keys: list[str], order: list[Column], name: str = "number", large: DataFrame | None = None) -> DataFrame:
    """The rows numbered from 1 within each key: their place in the total order by keys and order, less that of the key's
    first row. A key may hold most of the rows: no task holds a key. Null keys are a key of their own. Where `large_keys` of the
    rows are known, only the rows of these take that way, which stores all of them; all others are numbered in one window."""
    if large is not None:
        few = rows
        if not large.isEmpty():
            few, many = split_off(rows, large)
        few = few.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long"))
        return few if large.isEmpty() else few.unionByName(numbers_within(many, keys, order, name))
    placed = total_order(rows, [*map(F.col, keys), *order], "__place")
    placed = placed.select(*placed.columns, F.struct(*keys).alias("__key"))
    first = placed.groupBy("__key").agg(F.min("__place").alias("__first")).withColumnRenamed("__key", "__of")
    joined = placed.join(first, F.col("__key").eqNullSafe(F.col("__of")))
    return joined.select(*[c for c in rows.columns if c != name], (F.col("__place") - F.col("__first") + 1).alias(name))
