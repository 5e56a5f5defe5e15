"""Tables, manifests and pages as rows of the evidence domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders that a repository listing passes over, and the extensions that it keeps.
IGNORED = [".git", ".next", ".nuxt", ".output", ".svelte-kit", ".turbo", "build", "coverage", "dist", "node_modules", "out"]
KEPT = ["ts", "tsx", "js", "jsx", "json"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def manifest(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON manifest with its declared schema; nothing is inferred, what does not fit fails."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """(path, extension, size_bytes) of the source files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(root)
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    files = files.select("path", extension.alias("extension"), F.col("length").alias("size_bytes"))
    return files.filter(F.col("extension").isin(KEPT) & ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, IGNORED))))


def links(html: Column) -> Column:
    """array of (href, label): the links of the menus of a page."""
    menus = F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<nav[^>]*>(.*?)</nav>"), F.lit(1)), " ")
    pattern = r"(?is)<a href=\"([^\"]*)\"[^>]*>(.*?)</a>"
    return F.arrays_zip(F.regexp_extract_all(menus, F.lit(pattern), F.lit(1)).alias("href"), F.regexp_extract_all(menus, F.lit(pattern), F.lit(2)).alias("label"))


def containment(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The driver tables as a typed graph: region, nation, customer and order nodes, each contained in the one before."""
    levels = [("region", "r_regionkey", None, None), ("nation", "n_nationkey", "region", "n_regionkey"), ("customer", "c_custkey", "nation", "c_nationkey"), ("orders", "o_orderkey", "customer", "o_custkey")]
    nodes, edges = [], []
    for kind, key, above, parent in levels:
        rows = table(spark, sf_dir, kind)
        node = F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))
        nodes.append(rows.select(node.alias("id"), F.lit(kind).alias("type")))
        if above:
            up = F.concat(F.lit(f"{above}:"), F.col(parent).cast("string"))
            edges.append(rows.select(F.concat(up, F.lit(">"), node).alias("id"), F.lit("CONTAINS").alias("type"), up.alias("src"), node.alias("dst")))
    out = []
    for parts in (nodes, edges):
        one = parts[0]
        for part in parts[1:]:
            one = one.unionByName(part)
        out.append(one)
    return out[0], out[1]


ENDPOINTS = [("CONTAINS", "region", "nation"), ("CONTAINS", "nation", "customer"), ("CONTAINS", "customer", "orders")]
