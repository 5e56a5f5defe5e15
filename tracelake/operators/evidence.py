"""Static evidence held against what was observed: requests, transports, elements, navigation; summaries of the results.

A result row has domain, status, strength, static (identifiers of the code, sorted), runtime (one observation or transition,
or null) and reasons. Several observations of one result are several rows, so a busy endpoint is never one list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.names import RESOURCE_TYPES, filled, folded, tag_reason
from tracelake.functions.text import stable_hash
from tracelake.functions.urls import request_path as http_path

DOMAINS = ["route", "ui", "navigation", "http", "graphql"]
STATUSES = ["corroborated", "static-only", "runtime-only", "ambiguous"]
RESULT = ["domain", "status", "strength", "static", "runtime", "reasons"]


def _rows(df: DataFrame, domain: str, status: Column | str, static: Column | None, runtime: Column | None, reasons: Column | list[str], strength: Column | str | None = None) -> DataFrame:
    lit = lambda x: F.lit(x) if x is None or isinstance(x, str) else x
    none = F.expr("cast(array() as array<string>)")
    columns = (F.lit(domain), lit(status), lit(strength).cast("string"), none if static is None else static, lit(None).cast("string") if runtime is None else runtime, F.array(*map(F.lit, reasons)) if isinstance(reasons, list) else reasons)
    return df.select(*[c.alias(n) for c, n in zip(columns, RESULT)])


def result_id(row: Column | None = None) -> Column:
    """The identity of a result row: a hash of its domain, status, references and sorted reasons."""
    return F.concat(F.lit("reconciliation-result:"), stable_hash(F.to_json(F.struct("domain", "status", "static", F.coalesce("runtime", F.lit("")).alias("runtime"), F.array_sort("reasons").alias("reasons")))))


def http_results(requests: DataFrame, network: DataFrame) -> DataFrame:
    """requests (node_id, method, url; null where the code does not fix them) against network (ref, method, url,
    resource_type), by method and path. Observations are counted before they meet the requests of their key."""
    static = requests.select("node_id", F.upper("method").alias("m"), F.nullif("url", F.lit("")).alias("url"))
    fixed = static.filter("m <> '' and url is not null").select("node_id", "m", http_path(F.col("url")).alias("path"))
    seen = network.filter(~F.col("resource_type").isin(RESOURCE_TYPES)).select("ref", F.upper("method").alias("m"), http_path(F.col("url")).alias("path"))
    nodes = fixed.groupBy("m", "path").agg(F.array_sort(F.collect_set("node_id")).alias("nodes"))  # places in the code with one request
    counted = seen.groupBy("m", "path").agg(F.count(F.lit(1)).alias("r"))
    met = nodes.join(counted, ["m", "path"])
    dynamic = _rows(static.filter("m is null or m = '' or url is null"), "http", "ambiguous", F.array("node_id"), None, ["dynamic-static-evidence"])
    unseen = fixed.join(counted, ["m", "path"], "left_anti")
    only = _rows(unseen, "http", "static-only", F.array("node_id"), None, ["static-request-not-observed", "runtime-coverage-bounded"])
    pairs = seen.join(met, ["m", "path"])
    many = F.size("nodes") > 1
    reasons = F.when(many, F.array(*map(F.lit, ["duplicate-static-request-ambiguous", "http-method-match", "http-path-match"]))).otherwise(F.array(F.lit("http-method-match"), F.lit("http-path-match")))
    strength = F.when(~many, F.when(F.col("r") == 1, F.lit("exact")).otherwise(F.lit("strong")))
    both = _rows(pairs, "http", F.when(many, F.lit("ambiguous")).otherwise(F.lit("corroborated")), F.col("nodes"), F.col("ref"), reasons, strength)
    new = _rows(seen.join(nodes, ["m", "path"], "left_anti"), "http", "runtime-only", None, F.col("ref"), ["network-request-not-in-static-manifest"])
    return dynamic.unionByName(only).unionByName(both).unionByName(new)


def graphql_results(executions: DataFrame, network: DataFrame) -> DataFrame:
    """executions (node_id, endpoint; null where unresolved) against network by the path of the endpoint. An endpoint seen
    proves the transport, no named operation."""
    seen = network.filter(~F.col("resource_type").isin(RESOURCE_TYPES)).select("ref", http_path(F.col("url")).alias("path"))
    fixed = executions.filter("endpoint <> ''").select("node_id", http_path(F.col("endpoint")).alias("path"))
    open_ = _rows(executions.filter("endpoint is null or endpoint = ''"), "graphql", "static-only", F.array("node_id"), None, ["graphql-endpoint-unresolved"])
    nodes = fixed.groupBy("path").agg(F.array_sort(F.collect_set("node_id")).alias("nodes"))  # executions in the code of one endpoint
    only = _rows(nodes.join(seen, "path", "left_anti"), "graphql", "static-only", F.col("nodes"), None, ["graphql-endpoint-not-observed", "runtime-coverage-bounded"])
    both = _rows(seen.join(nodes, "path"), "graphql", "corroborated", F.col("nodes"), F.col("ref"), ["graphql-endpoint-match", "named-operation-not-proven"], "strong")
    return open_.unionByName(only).unionByName(both)


def navigation_results(navigations: DataFrame, transitions: DataFrame) -> DataFrame:
    """navigations (node_id, destination, label) of fixed destinations against transitions (ref, path, label, kind) that led
    there; where several did, the one with the label counts."""
    static = navigations.select("node_id", F.nullif("destination", F.lit("")).alias("path"), folded(F.col("label")).alias("label"))
    moved = transitions.select("ref", "path", folded(F.col("label")).alias("said"), "kind")
    dynamic = _rows(static.filter("path is null"), "navigation", "ambiguous", F.array("node_id"), None, ["dynamic-static-evidence"])
    pairs = static.join(moved, "path").withColumn("same", F.col("said") == F.col("label"))
    found = pairs.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("same").alias("n_same"), F.max("label").alias("label"), F.min_by("ref", "ref").alias("one"), F.min(F.when(F.col("same"), F.col("ref"))).alias("labelled"))
    chosen = F.when((F.col("n") > 1) & (F.col("label") == ""), F.lit(None)).when(F.col("n_same") == 1, F.col("labelled")).when(F.col("n") == 1, F.col("one"))
    found = found.withColumn("chosen", chosen)
    named = (F.col("label") != "") & (F.col("n_same") > 0)
    reasons = F.when(named, F.array(F.lit("navigation-destination-match"), F.lit("navigation-label-match"))).otherwise(F.array(F.lit("navigation-destination-match")))
    sure = _rows(found.filter("chosen is not null"), "navigation", "corroborated", F.array("node_id"), F.col("chosen"), reasons, F.when(named, F.lit("exact")).otherwise(F.lit("strong")))
    unsure = _rows(pairs.join(found.filter("chosen is null"), "node_id", "left_semi"), "navigation", "ambiguous", F.array("node_id"), F.col("ref"), ["duplicate-navigation-ambiguous", "navigation-destination-match"])
    only = _rows(static.filter("path is not null").join(moved, "path", "left_anti"), "navigation", "static-only", F.array("node_id"), None, ["no-runtime-transition-match", "runtime-coverage-bounded"])
    why = F.when(F.col("kind") == "same-url", F.lit("same-url-transition-no-static-navigation")).otherwise(F.lit("no-static-navigation-match"))
    used = found.filter("chosen is not null").select(F.col("chosen").alias("ref"))
    new = _rows(moved.join(used, "ref", "left_anti"), "navigation", "runtime-only", None, F.col("ref"), F.array(why))
    return dynamic.unionByName(sure).unionByName(unsure).unionByName(only).unionByName(new)


def ui_reasons() -> Column:
    """Why an element of the code (s_*) and one of a page (r_*) are the same; null if they cannot be."""
    text, name, shown = folded(F.col("s_text")), folded(F.col("r_name")), folded(F.col("r_text"))
    given = lambda c: folded(F.col(c)) != ""
    types = F.lower(filled(F.col("s_type"))), F.lower(filled(F.col("r_type")))
    typed = (types[0] != "") & (types[1] != "")
    aria, hint = given("s_aria") & (folded(F.col("s_aria")) == name), given("s_hint") & (folded(F.col("s_hint")) == folded(F.col("r_hint")))
    when = lambda cond, *reasons: F.when(cond, F.array(*map(F.lit, reasons))).otherwise(F.expr("cast(array() as array<string>)"))
    labels = (given("s_label") & (folded(F.col("s_label")) == name)) | (given("s_title") & (folded(F.col("s_title")) == name))
    parts = [
        F.array(tag_reason(F.col("s_tag"), F.col("r_tag"), F.col("r_role")), F.lit("element-type-match")),
        when(aria, "exact-accessible-name", "accessible-name-exact", "aria-label-match"), when((text != "") & (text == shown), "exact-text", "element-text-exact"),
        when((text != "") & (text == name), "exact-accessible-name", "accessible-name-exact"), when(labels, "exact-label"), when(hint, "exact-placeholder", "placeholder-match"),
        when(typed & (types[0] == types[1]), "input-type-match"), when(F.col("s_event") & F.col("r_strong"), "event-compatible", "interaction-evidence-match"),
    ]
    found = F.array_distinct(F.concat(*parts))
    fits = tag_reason(F.col("s_tag"), F.col("r_tag"), F.col("r_role")).isNotNull() & ~(typed & (types[0] != types[1]))
    return F.when(fits & F.exists(found, lambda r: F.startswith(r, F.lit("exact-"))), found)


def ui_results(static_ui: DataFrame, runtime_ui: DataFrame, contexts: DataFrame, scopes: DataFrame) -> DataFrame:
    """static_ui (node_id, s_*) against runtime_ui (ref, state_id, r_*): contexts (state_id, route_id, ambiguous) names the
    route that was selected for a state, scopes (route_id, node_id) the elements below a route. Only elements of the route
    are compared."""
    placed = runtime_ui.join(contexts, "state_id", "left")
    sized = placed.join(scopes.groupBy("route_id").agg(F.count(F.lit(1)).alias("evaluated")), "route_id", "left")
    context = F.when(F.coalesce("ambiguous", F.lit(False)), F.lit("ambiguous-route-context")).when(F.col("evaluated") > 0, F.lit("eligible")).otherwise(F.lit("insufficient-static-ui-context"))
    sized = sized.withColumn("context", context)
    pairs = sized.filter("context = 'eligible'").join(scopes, "route_id").join(static_ui, "node_id").withColumn("why", ui_reasons()).filter("why is not null")
    found = pairs.groupBy("ref").agg(F.array_sort(F.collect_set("node_id")).alias("nodes"), F.first("why").alias("why"))  # elements of one route
    all_ = sized.join(found, "ref", "left").withColumn("n", F.coalesce(F.size("nodes"), F.lit(0)))
    status = F.when(F.col("n") == 0, F.lit("runtime-only")).when(F.col("n") > 1, F.lit("ambiguous")).otherwise(F.lit("corroborated"))
    alone = F.array(F.when(F.col("context") == "eligible", F.lit("no-compatible-static-ui")).otherwise(F.col("context")))
    several = F.array(*map(F.lit, ["multiple-compatible-static-ui", "duplicate-label-ambiguous", "selected-route-context", "route-context-match"]))
    one = F.concat(F.array(F.lit("selected-route-context"), F.lit("route-context-match")), F.col("why"))
    reasons = F.when(F.col("n") == 0, alone).when(F.col("n") > 1, several).otherwise(one)
    strength = F.when(F.col("n") == 1, F.when(F.array_contains("why", "exact-text"), F.lit("exact")).otherwise(F.lit("strong")))
    observed = _rows(all_, "ui", status, F.coalesce("nodes", F.expr("cast(array() as array<string>)")), F.col("ref"), reasons, strength)
    rest = static_ui.join(pairs.select("node_id").distinct(), "node_id", "left_anti").join(scopes.select("node_id", F.lit(True).alias("scoped")).distinct(), "node_id", "left")
    named = F.concat(*[folded(F.col(c)) for c in ("s_text", "s_aria", "s_label", "s_title", "s_hint")]) != ""
    why = F.when(~named, F.lit("dynamic-static-identity")).when(F.col("scoped"), F.lit("no-runtime-element-match")).otherwise(F.lit("insufficient-runtime-route-context"))
    return observed.unionByName(_rows(rest, "ui", "static-only", F.array("node_id"), None, F.array(why, F.lit("runtime-coverage-bounded"))))


def summarise(results: DataFrame) -> DataFrame:
    """How many results a domain has of each status, 0 where none."""
    spine = results.sparkSession.createDataFrame([(d,) for d in DOMAINS], "domain string")
    counts = results.groupBy("domain").agg(*[F.count_if(F.col("status") == s).alias(s.replace("-", "_")) for s in STATUSES])
    return spine.join(counts, "domain", "left").na.fill(0)


def evidence_status(statuses: Column) -> Column:
    """The strongest of the statuses of some results."""
    found = F.lit("static")
    for s in ("static-only", "runtime-only", "ambiguous", "corroborated"):
        found = F.when(F.array_contains(statuses, s), F.lit(s)).otherwise(found)
    return found
