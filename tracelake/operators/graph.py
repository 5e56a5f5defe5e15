"""The evidence graph: typed nodes and edges, traces and closures, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chains import follow
from .matching import duplicate_keys, missing_references, unique_left_join
from .ordering import numbers_within, total_order
from .storage import cut, shared_path


def trace(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(root, node, depth): all that a root leads to over edges (src, dst), with the least number of steps. Roots are nodes
    (node), or have a name (root, node) under which a root begins at several nodes. A level is joined to the edges and loses what
    was seen, so cycles end; each level is appended to one table and written once."""
    spark, path = roots.sparkSession, shared_path(roots.sparkSession, "trace")
    first = roots.select(F.col("root" if "root" in roots.columns else "node").alias("root"), "node").distinct()
    schema = ", ".join(f"{c} {first.schema[c].dataType.simpleString()}" for c in ("root", "node")) + ", depth int"
    first.write.parquet(f"{path}/depth=0")
    depth = 0
    while max_depth is None or depth < max_depth:
        seen = spark.read.schema(schema).parquet(path)
        level = seen.filter(F.col("depth") == depth)
        if level.isEmpty():
            break
        depth += 1
        step = level.join(edges, level["node"] == edges["src"]).select("root", F.col("dst").alias("node")).distinct()
        step.join(seen, ["root", "node"], "left_anti").write.parquet(f"{path}/depth={depth}")
    return spark.read.schema(schema).parquet(path)


def trace_via(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(root, node, depth, via): as trace, with the edge (id, src, dst) that discovers each node when every level is visited in
    the order in which it was discovered and the edges of a node in the order of their identifiers; null for the root. The
    order of a level is a total order over all roots, so that no root's level is one task's."""
    spark, path = roots.sparkSession, shared_path(roots.sparkSession, "via")
    kind, of = (x.dataType.simpleString() for x in (roots.schema["node"], edges.schema["id"]))
    schema = f"root {kind}, node {kind}, via {of}, place long, depth int"
    first = roots.select(F.col("node").alias("root"), "node").distinct()
    first.select("root", "node", F.lit(None).cast(of).alias("via"), F.lit(1).cast("long").alias("place")).write.parquet(f"{path}/depth=0")
    depth = 0
    while max_depth is None or depth < max_depth:
        seen = spark.read.schema(schema).parquet(path)
        level = seen.filter(F.col("depth") == depth)
        if level.isEmpty():
            break
        depth += 1
        step = level.select("root", F.col("node").alias("src"), "place").join(edges.select("id", "src", "dst"), "src")
        found = step.groupBy("root", F.col("dst").alias("node")).agg(F.min(F.struct("place", "id")).alias("from"))
        found = found.join(seen.select("root", "node"), ["root", "node"], "left_anti")
        placed = total_order(found, [F.col("from.place"), F.col("from.id"), F.col("root")])
        placed.select("root", "node", F.col("from.id").alias("via"), "place").write.parquet(f"{path}/depth={depth}")
    return spark.read.schema(schema).parquet(path).select("root", "node", "depth", "via")


def violations(nodes: DataFrame, edges: DataFrame, endpoints: list[tuple[str, str, str]]) -> DataFrame:
    """(rule, subject) for nodes (id, type) and edges (id, type, src, dst); endpoints: allowed (type, source type, target
    type). Empty if identifiers are unique and every edge joins nodes of allowed types."""
    ends = edges.join(nodes.select(F.col("id").alias("src"), F.col("type").alias("src_type")), "src").join(nodes.select(F.col("id").alias("dst"), F.col("type").alias("dst_type")), "dst")
    allowed = F.lit(False)
    for kind, a, b in endpoints:
        allowed = allowed | ((F.col("type") == kind) & (F.col("src_type") == a) & (F.col("dst_type") == b))
    wrong = ends.filter(~allowed).select(F.lit("edge-endpoint-type").alias("rule"), F.col("id").alias("subject"))
    found = duplicate_keys(nodes, "id", "duplicate-node").union(duplicate_keys(edges, "id", "duplicate-edge"))
    found = found.union(missing_references(edges, "src", nodes, "id", "missing-source")).union(missing_references(edges, "dst", nodes, "id", "missing-target"))
    return found.union(wrong)


def unique_ids(rows: DataFrame, base: str, order: str) -> DataFrame:
    """The rows with `id`: the base, from its second row on with #2, #3, ... in the given order."""
    placed = numbers_within(rows, [base], [F.col(order)], "__place")
    told = F.when(F.col("__place") > 1, F.concat(base, F.lit("#"), F.col("__place").cast("string"))).otherwise(F.col(base))
    return placed.withColumn("id", told).drop("__place")


def render_edges(renders: DataFrame) -> DataFrame:
    """(src, dst, evidence): one edge for each pair that a component renders, with its distinct evidence, sorted."""
    return renders.groupBy("src", "dst").agg(F.array_sort(F.collect_set("evidence")).alias("evidence"))  # places in the code of one pair


def resolve_references(references: DataFrame, targets: DataFrame, keys: list[str], relationship: str) -> tuple[DataFrame, DataFrame]:
    """Edges (type, src, dst) of the references (src, keys) that exactly one target (id, keys) answers, and the others as
    unresolved (relationship, src, reason): not-found or ambiguous."""
    found = unique_left_join(references, targets, keys, "id", "target")
    edges = found.filter("target is not null").select(F.lit(relationship).alias("type"), "src", F.col("target").alias("dst"))
    reason = F.when(F.col("n_target") == 0, F.lit("not-found")).otherwise(F.lit("ambiguous"))
    return edges, found.filter("target is null").select(F.lit(relationship).alias("relationship"), "src", reason.alias("reason"))


def resolve_component(usages: DataFrame, components: DataFrame) -> DataFrame:
    """The usages (src, name, path, line) with component: that of the same name and place, else the only one of the name in
    the file, else null."""
    exact = unique_left_join(usages, components, ["name", "path", "line"], "id", "exact")
    loose = unique_left_join(exact, components, ["name", "path"], "id", "loose")
    return loose.select(*usages.columns, F.coalesce("exact", "loose").alias("component"))


def ui_tree(elements: DataFrame) -> DataFrame:
    """(owner, id, depth): the elements below each root of elements (id, parent, kind), in which fragments are transparent
    and texts are left out. Depth counts real elements, however deep. Elements on or below a circle, and below a parent that
    is not there, have no root and give no row."""
    rows = elements.select(F.col("id").alias("node"), F.col("parent").alias("next"), F.when(F.col("kind") == "fragment", 0).otherwise(1).alias("weight"))
    ended = follow(rows).ended
    tops = elements.filter("parent is null").select(F.col("id").alias("end"))
    real = elements.filter("kind not in ('fragment', 'text')").select(F.col("id").alias("node"))
    return ended.join(tops, "end", "left_semi").join(real, "node", "left_semi").select(F.col("end").alias("owner"), F.col("node").alias("id"), F.col("weight").cast("int").alias("depth"))


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node): what roots (node, or root and node) reach over edges (src, dst), themselves included."""
    return trace(edges, roots).select("root", "node")


def route_scopes(edges: DataFrame, routes: DataFrame, max_depth: int = 32) -> DataFrame:
    """(route_id, node_id): the elements of the components below a route. edges (type, src, dst): a route RENDERS_ROUTE a
    component, a component RENDERS others (up to max_depth) and CONTAINS_ELEMENT elements, which contain others."""
    start = routes.join(edges.filter("type = 'RENDERS_ROUTE'"), F.col("route_id") == F.col("src")).select("route_id", F.col("dst").alias("node")).distinct()
    below = trace(edges.filter("type = 'RENDERS'").select("src", "dst"), start.select("node").distinct(), max_depth)
    inside = trace(edges.filter("type = 'CONTAINS_ELEMENT'").select("src", "dst"), below.select("node").distinct()).filter("depth > 0")
    parts = below.select(F.col("root").alias("node"), F.col("node").alias("component")).join(inside.select(F.col("root").alias("component"), F.col("node").alias("node_id")), "component")
    return start.join(parts, "node").select("route_id", "node_id").distinct()


def inner_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(feature_id, id): edges (id, src, dst) whose two ends belong to a feature (feature_id, node)."""
    ends = edges.join(members.select("feature_id", F.col("node").alias("src")), "src")
    return ends.join(members.select("feature_id", F.col("node").alias("dst")), ["feature_id", "dst"], "left_semi").select("feature_id", "id")


def shared_shell(items: DataFrame) -> DataFrame:
    """items (state_id, route_id, key) with scope: shared-shell if a state of another route shows the key too, else own."""
    spread = items.groupBy("key").agg((F.min("route_id") != F.max("route_id")).alias("shared"))
    scope = F.when(F.col("shared"), F.lit("shared-shell")).otherwise(F.lit("own"))
    return items.join(spread, "key").select(*items.columns, scope.alias("scope"))


def resolve_exports(exports: DataFrame) -> DataFrame:
    """(module, name, status, target) for exports (module, name, target, from_module, from_name): a declaration has a target,
    a re-export names another module's export. resolved, ambiguous, not-found or circular (nothing is found and some way leads
    round a circle).

    An export that is one re-export is a pointer: chains of them are followed by doubling. What is left are the exports with
    several ways; they lead to each other's chain ends, and are traced to all declarations that they reach."""
    key = lambda m, n: F.to_json(F.array(m, n))
    rows = exports.select(key("module", "name").alias("node"), "module", "name", "target", F.when(F.col("from_module").isNotNull(), key("from_module", F.coalesce("from_name", F.lit("")))).alias("to"))
    rows = cut(rows, "exports")
    of = rows.groupBy("node").agg(F.min("module").alias("module"), F.min("name").alias("name"), F.count(F.lit(1)).alias("n"), F.max("to").alias("to"))
    of = cut(of, "names")
    chains = follow(of.select("node", F.when(F.col("n") == 1, F.col("to")).alias("next")))
    ended = cut(chains.ended.select("node", "end"), "ended")
    ways = rows.filter("to is not null").join(of.filter("n > 1").select("node"), "node", "left_semi")
    ways = ways.join(ended.select(F.col("node").alias("to"), "end"), "to", "left").select(F.col("node").alias("src"), F.coalesce("end", "to").alias("dst"))
    rings = rows.join(chains.circular.select(F.col("node").alias("to")), "to", "left_semi").select("node").distinct()
    ways = cut(ways.distinct(), "ways")
    branching = of.filter("n > 1").select("node")
    reached = trace(ways, branching)
    round_ = reached.select("root", F.col("node").alias("src")).join(ways, "src").filter("dst = root").select(F.col("root").alias("node")).distinct()  # exports on a circle of several ways
    round_ = cut(round_.unionByName(rings).distinct(), "round")
    ends = reached.select("root", "node").unionByName(of.filter("n = 1").select(F.col("node").alias("root"), "node"))
    found = rows.filter("target is not null").select("node", "target")
    told = ends.join(found, "node", "left").join(round_.withColumn("circle", F.lit(True)), "node", "left")
    told = told.groupBy("root").agg(F.count_distinct("target").alias("found"), F.min("target").alias("target"), F.coalesce(F.max("circle"), F.lit(False)).alias("circle"))
    out = of.select("node", "module", "name").join(ended, "node").join(told.withColumnRenamed("root", "end"), "end", "left")
    out = out.select("module", "name", F.coalesce("found", F.lit(0)).alias("found"), "target", F.coalesce("circle", F.lit(False)).alias("circle"))
    out = out.unionByName(of.join(chains.circular, "node", "left_semi").select("module", "name", F.lit(0).cast("long").alias("found"), F.lit(None).cast("string").alias("target"), F.lit(True).alias("circle")))
    status = F.when(F.col("found") > 1, F.lit("ambiguous")).when(F.col("found") == 1, F.lit("resolved")).when(F.col("circle"), F.lit("circular")).otherwise(F.lit("not-found"))
    return out.select("module", "name", status.alias("status"), F.when(F.col("found") == 1, F.col("target")).alias("target"))
