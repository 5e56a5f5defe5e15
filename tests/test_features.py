"""Nodes of features: shared components, features of several components, and who is first."""

from pyspark.sql import functions as F

from tracelake.operators import features

SEEDS = "feature_id string, route_id string, navigation_id string, place int"
EDGES = "id string, type string, src string, dst string"
RENDERS, HAS, CALLS = "ROUTE_RENDERS_COMPONENT", "CONTAINS_ELEMENT", "CALLS"


def example(spark):
    """A and B share X; B has Y too, which shares the element u with X; C has nothing below its component."""
    seeds = spark.createDataFrame([("A", "ra", None, 2), ("B", "rb", "nb", 1), ("B", "rb", None, 1), ("C", "rc", None, 3), ("D", None, None, 4)], SEEDS)
    told = [
        (RENDERS, "ra", "X"), (RENDERS, "rb", "X"), (RENDERS, "rb", "Y"), (RENDERS, "rc", "Z"), (HAS, "X", "u"), (HAS, "Y", "u"), (HAS, "Y", "v"), ("HAS_EVENT", "u", "e"), ("HAS_EVENT", "v", "d"),
        ("BINDS_TO", "e", "f"), ("BINDS_TO", "d", "g"), (CALLS, "f", "g"), (CALLS, "g", "f"), (CALLS, "g", "h"), ("PERFORMS_HTTP_REQUEST", "h", "q"), ("PERFORMS_GRAPHQL_EXECUTION", "g", "x"), ("USES_DOCUMENT", "x", "d1"),
        ("NAVIGATES_TO", "na", "ra"), ("NAVIGATES_TO", "other", "rb"), ("NAVIGATES_TO", "u", "rc"),
    ]
    return seeds, spark.createDataFrame([(str(i), *x) for i, x in enumerate(told)], EDGES)


def wide(spark, n, m):
    """n features with one component of m elements."""
    seeds = spark.range(n).select(F.concat(F.lit("F"), "id").alias("feature_id"), F.concat(F.lit("r"), "id").alias("route_id"), F.lit(None).cast("string").alias("navigation_id"), F.col("id").cast("int").alias("place"))
    edges = seeds.select(F.lit("a").alias("id"), F.lit(RENDERS).alias("type"), F.col("route_id").alias("src"), F.lit("C").alias("dst"))
    return seeds, edges.union(spark.range(m).select(F.lit("b"), F.lit(HAS), F.lit("C"), F.concat(F.lit("u"), "id")))


def test_nodes_of_features_that_share_components(spark):
    found = sorted(tuple(r) for r in features.feature_nodes(*example(spark)).collect())
    below = [("callable", "f"), ("callable", "g"), ("callable", "h"), ("event", "e"), ("graphql", "d1"), ("graphql", "x"), ("http", "q"), ("ui", "u")]
    wanted = [("A", *x) for x in [*below, ("component", "X"), ("route", "ra"), ("navigation", "na")]]
    wanted += [("B", *x) for x in [*below, ("event", "d"), ("ui", "v"), ("component", "X"), ("component", "Y"), ("route", "rb"), ("navigation", "nb")]]
    assert found == sorted([*wanted, ("C", "component", "Z"), ("C", "route", "rc"), ("C", "navigation", "u")])


def test_no_task_has_a_component_of_many_features(spark):
    rows = features.feature_nodes(*wide(spark, 3000, 2500)).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()
    assert sum(r.n for r in rows) == 3000 * 2502 and max(r.n for r in rows) < 3000 * 2502 / 2


def test_who_is_first_needs_no_node_of_every_feature(spark):
    seeds, edges = example(spark)
    order = seeds.select("feature_id", "place").distinct()
    firsts = lambda nodes: sorted(tuple(r) for r in nodes.join(order, "feature_id").groupBy("node").agg(F.min_by("feature_id", "place")).collect())
    assert firsts(features.leading_nodes(seeds, edges, order)) == firsts(features.feature_nodes(seeds, edges))
    seeds, edges = wide(spark, 200, 300)
    assert features.leading_nodes(seeds, edges, seeds).count() == 200 * 2 + 300
