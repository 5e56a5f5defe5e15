"""The feature model: what belongs to a feature, what it is called, how features lead to one another, what no feature has.

Members of a feature are rows (feature_id, kind, ref), never lists, so a feature of any size is no group in one task. Where
"the first" counts, rows carry the place that says so, and an aggregation picks it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.names import filled
from tracelake.functions.routes import bindings, identity_parts, segments, structure_key, title_of
from tracelake.functions.text import normal_space, stable_hash
from tracelake.functions.urls import normal_route

from .graph import closure
from .matching import first_match
from .storage import cut

#: Where names come from, the best first.
SOURCES = ["navigation-label", "primary-action", "static-heading", "runtime-heading", "runtime-navigation-label", "component", "route-identity", "route-segment", "runtime-name"]
#: Kinds of nodes that a user sees.
USER_FACING = ["route", "navigation", "component", "ui-element", "ui-event"]
#: Why evidence of a kind belongs to no feature.
REASONS = {
    "static-edge": "edge-not-contained-by-feature-context", "runtime-state": "runtime-state-without-meaningful-user-facing-root",
    "runtime-transition": "transition-not-associated-with-feature",
}


#: Fixed value: features and nodes of one component meet in cells of about this many of either.
CELL = 1024


def _step(rows: DataFrame, edges: DataFrame, *types: str) -> DataFrame:
    """rows (of, node), one edge of these types further."""
    of = rows.columns[0]
    return rows.join(edges.filter(F.col("type").isin(*types)), F.col("node") == F.col("src")).select(of, F.col("dst").alias("node")).distinct()


def _union(parts: dict[str, DataFrame]) -> DataFrame:
    rows = [df.select(df.columns[0], F.lit(part).alias("part"), "node") for part, df in parts.items()]
    out = rows[0]
    for df in rows[1:]:
        out = out.union(df)
    return out


def _below(components: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, part, node): what is below components (component), each told once however many features have it."""
    ui = _step(components.select("component", F.col("component").alias("node")), edges, "CONTAINS_ELEMENT")
    event = _step(ui, edges, "HAS_EVENT")
    bound = _step(event, edges, "BINDS_TO").select(F.col("component").alias("root"), "node")
    called = closure(edges.filter("type = 'CALLS'").select("src", "dst"), bound).withColumnRenamed("root", "component")
    http = _step(called, edges, "PERFORMS_HTTP_REQUEST")
    execution = _step(called, edges, "PERFORMS_GRAPHQL_EXECUTION")
    graphql = execution.union(_step(execution, edges, "USES_DOCUMENT", "EXECUTES_OPERATION")).distinct()
    return cut(_union({"ui": ui, "event": event, "callable": called, "http": http, "graphql": graphql}), "below")


def _parts(seeds: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The features' own nodes (feature_id, part, node) with their components, the components by themselves (feature_id,
    component) and what is below these (component, part, node)."""
    route = seeds.filter("route_id is not null").select("feature_id", F.col("route_id").alias("node")).distinct()
    leads = edges.filter("type = 'NAVIGATES_TO'").select(F.col("dst").alias("node"), F.col("src").alias("from"))
    has = seeds.filter("navigation_id is not null")
    navigation = has.select("feature_id", F.col("navigation_id").alias("node")).union(route.join(has, "feature_id", "left_anti").join(leads, "node").select("feature_id", F.col("from").alias("node"))).distinct()
    component = cut(_step(route, edges, "ROUTE_RENDERS_COMPONENT"), "components")
    members = component.withColumnRenamed("node", "component")
    return _union({"route": route, "navigation": navigation, "component": component}), members, _below(members.select("component").distinct(), edges)


def _spread(members: DataFrame, below: DataFrame) -> DataFrame:
    """(feature_id, part, node): members (feature_id, component) with all that is below their components. The features and the
    nodes of a component are dealt into slices and meet in cells, a slice of either, so no task has a component as a whole and
    what is shuffled is a small part of what comes out."""
    spark = members.sparkSession
    features, nodes = members.groupBy("component").agg(F.count(F.lit(1)).alias("n")), below.groupBy("component").agg(F.count(F.lit(1)).alias("m"))
    slices = [F.ceil(F.col(n) / CELL).cast("int").alias(k) for n, k in (("n", "rows"), ("m", "columns"))]
    cells = cut(features.join(nodes, "component").select("component", (F.col("n") * F.col("m")).alias("out"), *slices), "cells")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), (cells.agg(F.sum("out")).first()[0] or 0) // CELL**2)
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = members.join(cells, "component").select("feature_id", "component", deal("feature_id", "rows").alias("row"), every("columns").alias("column"))
    right = below.join(cells, "component").select("part", "node", "component", every("rows").alias("row"), deal("node", "columns").alias("column"))
    cell = ["component", "row", "column"]
    return left.repartition(parts, *cell).join(right.repartition(parts, *cell), cell).select("feature_id", "part", "node")


def feature_nodes(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(feature_id, part, node): the nodes of features (feature_id, route_id, navigation_id) over edges (type, src, dst): route,
    navigation, component, ui, event, callable (with all that it calls), http and graphql. What is below a component is found
    once; a feature of one component takes that over as it is, only features of several drop what these have in common."""
    own, members, below = _parts(seeds, edges)
    several = members.groupBy(F.col("feature_id").alias("__of")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__of")
    one, more = (members.join(several, F.col("feature_id").eqNullSafe(F.col("__of")), how) for how in ("left_anti", "left_semi"))
    return own.union(_spread(one, below)).union(_spread(more, below).distinct())


def leading_nodes(seeds: DataFrame, edges: DataFrame, features: DataFrame) -> DataFrame:
    """As feature_nodes, but what is below a component only for the first feature (feature_id, place) that has it: enough to
    tell the first feature of every node."""
    own, members, below = _parts(seeds, edges)
    first = members.join(features.select("feature_id", "place"), "feature_id").groupBy("component").agg(F.min_by("feature_id", "place").alias("feature_id"))
    return own.union(first.join(below, "component").select("feature_id", "part", "node"))


def relevant_results(results: DataFrame, references: DataFrame, members: DataFrame) -> DataFrame:
    """(feature_id, result_id): results (result_id, status), ambiguous ones left out, one of whose references (result_id, kind,
    ref) is a member (feature_id, kind, ref) of the feature."""
    sure = references.join(results.filter("status <> 'ambiguous'"), "result_id", "left_semi")
    return sure.join(members, ["kind", "ref"]).select("feature_id", "result_id").distinct()


def route_identities(seeds: DataFrame, states: DataFrame, selected: DataFrame) -> DataFrame:
    """(feature_id, result_id, pattern, identity_key, name, source) of the features (feature_id, route_id, pattern) all of whose
    states (feature_id, state_id, place) have a selected route result (result_id, route_id, state_id, path); result_id is the
    least of these. The name is made of the literal segments and of the readable values of parameters, in the order of the
    states; of more than two the first and the last."""
    pattern = normal_route(F.col("pattern"))
    rows = seeds.filter("route_id is not null").withColumn("pattern", pattern).join(states, "feature_id").join(selected, ["route_id", "state_id"], "left")
    key = F.min_by(structure_key(F.col("pattern"), F.col("path")), "place")
    whole = rows.groupBy("feature_id").agg(F.min("result_id").alias("result_id"), F.first("pattern").alias("pattern"), key.alias("identity_key"), F.bool_and(F.col("result_id").isNotNull()).alias("all"))
    literals = F.filter(segments(F.col("pattern")), lambda s: ~F.startswith(s, F.lit(":")) & (s != "*") & (s != ""))
    values = rows.filter("path is not null").select("feature_id", "pattern", "place", F.posexplode(bindings(F.col("pattern"), F.col("path"))).alias("at", "b")).filter("b.value is not null")
    firsts = values.groupBy("feature_id", "pattern", F.col("b.value").alias("value")).agg(F.min(F.struct("place", "at")).alias("at"))
    new = ~F.array_contains(literals, F.col("value"))
    ends = firsts.groupBy("feature_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("value", "at").alias("first"), F.max_by("value", F.when(new, F.col("at"))).alias("last_new"), F.max_by("value", "at").alias("last"))
    out = whole.filter("all").join(ends, "feature_id", "left").withColumn("literals", F.array_distinct(literals))
    n, words = F.coalesce("n", F.lit(0)), F.size("literals")
    parts = F.when(words > 0, F.when(F.col("last_new").isNotNull(), F.array_append("literals", F.col("last_new"))).otherwise(F.col("literals"))).otherwise(F.array("first", "last"))
    name = F.array_join(F.transform(identity_parts(parts), title_of), " / ")
    name = F.when(F.col("pattern") == "/", F.lit("Root")).when((words == 0) & (n == 0), F.col("pattern")).otherwise(name)
    source = F.when((F.col("pattern") == "/") | ((words > 0) & (n == 0)), F.lit("route-literal")).when(n == 0, F.lit("route-pattern")).when((words == 0) & (n > 1), F.lit("runtime-route-structure")).otherwise(F.lit("route-bound-value"))
    return out.select("feature_id", "result_id", "pattern", "identity_key", name.alias("name"), source.alias("source"))


def only_label(observed: DataFrame) -> DataFrame:
    """(feature_id, name, evidence_id) of the features all of whose observed rows (feature_id, place, label, evidence_id) have
    one label; the evidence is the first row."""
    one = observed.withColumn("label", normal_space(filled(F.col("label")))).groupBy("feature_id").agg((F.min("label") == F.max("label")).alias("same"), F.min("label").alias("name"), F.min_by("evidence_id", "place").alias("evidence_id"))
    return one.filter("same and name <> ''").select("feature_id", "name", "evidence_id")


def choose_names(candidates: DataFrame) -> DataFrame:
    """(feature_id, name, source, evidence_id): the candidate (feature_id, source, place, name, evidence_id, detail) of the best
    source, the first of it; empty names don't count. A route identity names its own source as detail."""
    rank = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    best = first_match(candidates.filter(filled(F.col("name")) != ""), ["feature_id"], [rank, F.col("place"), F.col("evidence_id")])
    return best.select("feature_id", F.trim("name").alias("name"), F.coalesce("detail", "source").alias("source"), "evidence_id")


def route_name(pattern: Column) -> Column:
    """The last segment of a route as a name; Root if there is none."""
    parts = F.filter(segments(normal_route(pattern)), lambda s: s != "")
    return F.when(F.size(parts) == 0, F.lit("Root")).otherwise(title_of(F.element_at(parts, -1)))


def relationships(navigates: DataFrame, transitions: DataFrame, features: DataFrame, nodes: DataFrame, states: DataFrame) -> DataFrame:
    """(id, type, from_feature, to_feature, edge_id, transition_id) between different features. features: (feature_id, place), the
    order in which the first one is taken; nodes: (feature_id, part, node), of which leading_nodes has enough; states: (feature_id,
    state_id).

    An edge (id, src, dst) leads to the feature with the route dst, the last one of several, from the first feature with the
    node src, or else from the first one that a transition leads from to a state of the target. A transition (id, src, dst)
    leads between the first features with its states."""
    place = features.select("feature_id", "place")
    first_node = nodes.join(place, "feature_id").groupBy("node").agg(F.min_by("feature_id", "place").alias("f"))
    last_route = nodes.filter("part = 'route'").join(place, "feature_id").groupBy("node").agg(F.max_by("feature_id", "place").alias("t"))
    first_state = states.join(place, "feature_id").groupBy("state_id").agg(F.min_by("feature_id", "place").alias("f"))
    moves = transitions.filter("dst is not null")
    of_state = states.join(place, "feature_id")
    reached = moves.join(of_state.select(F.col("state_id").alias("src"), F.col("feature_id").alias("f"), "place"), "src").join(states.select(F.col("state_id").alias("dst"), F.col("feature_id").alias("t")), "dst").groupBy("t").agg(F.min_by("f", "place").alias("came"))
    static = navigates.join(last_route.withColumnRenamed("node", "dst"), "dst").join(first_node.withColumnRenamed("node", "src"), "src", "left").join(reached, "t", "left")
    static = static.select(F.lit("navigation-to").alias("type"), F.coalesce("f", "came").alias("from_feature"), F.col("t").alias("to_feature"), F.col("id").alias("edge_id"), F.lit(None).cast("string").alias("transition_id"))
    seen = moves.join(first_state.select(F.col("state_id").alias("src"), F.col("f").alias("from_feature")), "src").join(first_state.select(F.col("state_id").alias("dst"), F.col("f").alias("to_feature")), "dst")
    seen = seen.select(F.lit("runtime-transition-to").alias("type"), "from_feature", "to_feature", F.lit(None).cast("string").alias("edge_id"), F.col("id").alias("transition_id"))
    rows = static.union(seen).filter("from_feature <> to_feature").distinct()
    parts = F.concat_ws("|", "type", "from_feature", "to_feature", F.coalesce("edge_id", F.lit("")), F.coalesce("transition_id", F.lit("")))
    return rows.select(F.concat(F.lit("feature-relationship:"), stable_hash(parts)).alias("id"), *rows.columns)


def entry_points(navigation: DataFrame, transitions: DataFrame, states: DataFrame) -> DataFrame:
    """(feature_id, id, label, destination): the navigation nodes (feature_id, node_id, label, node_label, destination) of a
    feature and the labelled transitions (id, dst, label, after_url) into its states (feature_id, state_id)."""
    static = navigation.select("feature_id", F.concat(F.lit("entry:"), "node_id").alias("id"), filled(F.col("label"), F.col("node_label")).alias("label"), "destination")
    moves = transitions.filter(filled(F.col("label")) != "").join(states.select("feature_id", F.col("state_id").alias("dst")), "dst")
    return static.union(moves.select("feature_id", F.concat(F.lit("entry:"), "id").alias("id"), "label", F.col("after_url").alias("destination"))).dropDuplicates(["feature_id", "id"])


def sibling_scope(items: DataFrame) -> DataFrame:
    """items (feature_id, route_id, pattern, key) with scope: shared-shell if another feature of the same route, whose pattern
    has a parameter, shows the key too, else feature-specific."""
    spread = items.groupBy("route_id", "key").agg((F.min("feature_id") != F.max("feature_id")).alias("shared"))
    shared = F.contains(normal_route(F.col("pattern")), F.lit(":")) & F.coalesce("shared", F.lit(False))
    return items.join(spread, ["route_id", "key"], "left").select(*items.columns, F.when(shared, F.lit("shared-shell")).otherwise(F.lit("feature-specific")).alias("scope"))


def unassigned(items: DataFrame, used: DataFrame) -> DataFrame:
    """(id, kind, evidence_id, reason) of the items (kind, evidence_id, detail) that no feature uses (kind, evidence_id). detail:
    the type of a static node, the status of a reconciliation."""
    lost = items.join(used, ["kind", "evidence_id"], "left_anti")
    reason = F.when(F.col("kind") == "static-node", F.when(F.col("detail").isin(*USER_FACING), F.lit("no-deterministic-feature-context")).otherwise(F.lit("internal-evidence-without-feature-root")))
    for kind, why in REASONS.items():
        reason = reason.when(F.col("kind") == kind, F.lit(why))
    reason = reason.otherwise(F.when(F.col("detail") == "ambiguous", F.lit("ambiguous-evidence-not-force-assigned")).otherwise(F.lit("evidence-not-related-to-feature")))
    rows = lost.withColumn("reason", reason)
    return rows.select(F.concat(F.lit("unassigned:"), stable_hash(F.concat_ws("|", "kind", "evidence_id", "reason"))).alias("id"), "kind", "evidence_id", "reason")


def issues(features: DataFrame, references: DataFrame, known: DataFrame) -> DataFrame:
    """(rule, subject): features (feature_id, name) that stand twice or have no name, and references (feature_id, kind, ref) to
    what is not known (kind, ref)."""
    twice = features.groupBy("feature_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("duplicate-feature").alias("rule"), F.col("feature_id").alias("subject"))
    unnamed = features.filter(F.trim(filled(F.col("name"))) == "").select(F.lit("invalid-name").alias("rule"), F.col("feature_id").alias("subject"))
    lost = references.join(known, ["kind", "ref"], "left_anti").select(F.concat(F.lit("unknown-"), "kind").alias("rule"), F.col("ref").alias("subject")).distinct()
    return twice.union(unnamed).union(lost)


def report(features: DataFrame, items: DataFrame) -> DataFrame:
    """(feature_id, place, section, line): the lines of a report on features (feature_id, name, route), those without a route
    last. items: (feature_id, section, label, status)."""
    order = F.struct(F.coalesce("route", F.lit("~")).alias("route"), "name", "feature_id")
    head = features.select("feature_id", order.alias("at"), F.lit("FEATURE").alias("section"), F.col("name").alias("line"))
    body = items.join(features.select("feature_id", order.alias("at")), "feature_id").select("feature_id", "at", "section", F.concat_ws(" - ", "label", "status").alias("line"))
    return head.union(body)
