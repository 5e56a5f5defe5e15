"""Tables of a domain as projections of the given tables: one statement each, in SQL that Spark and other engines read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Types of the tables' columns in Spark, and in SQL.
SQL_TYPES = {"string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "long": "BIGINT"}


def columns(told: str) -> list[tuple[str, str]]:
    return [tuple(c.strip().split(" ", 1)) for c in told.split(",")]


class Projected:
    """Tables by name: (columns as 'name type, ...', a SELECT with given tables in braces; {list} makes an array, {none} an empty one)."""

    def __init__(self, tables: dict[str, tuple[str, str]]):
        self.tables = tables

    def frame(self, spark: SparkSession, folder: str, name: str) -> DataFrame:
        """The table over the given tables of a folder."""
        told, sql = self.tables[name]
        put = {"list": "array", "none": "cast(array() as array<string>)"}
        rows = spark.sql(re.sub(r"\{(\w+)\}", lambda m: put.get(m[1], f"parquet.`{folder}/{m[1]}.parquet`"), sql))
        return rows.toDF(*[c for c, _ in columns(told)]).select(*[F.col(c).cast(kind).alias(c) for c, kind in columns(told)])

    def with_sql(self, *names: str) -> str:
        """A WITH clause of the tables, over the given tables under their own names."""
        return "WITH " + ",\n".join(self.table_sql(n) for n in names)

    def table_sql(self, name: str) -> str:
        told, sql = self.tables[name]
        told = columns(told)
        put = {"list": "list_value", "none": "CAST([] AS VARCHAR[])"}
        sql = re.sub(r"\{(\w+)\}", lambda m: put.get(m[1], m[1]), sql)
        cast = ", ".join(f"{c}::{SQL_TYPES[k]} AS {c}" for c, k in told)
        return f"{name} AS (SELECT {cast} FROM ({sql}) AS given({', '.join(c for c, _ in told)}))"
