"""Declared route patterns against observed URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.routes import WILD, dominates, route_fit, segments, varies
from tracelake.functions.urls import application_path, fragment, normal_route


def compatible_routes(states: DataFrame, routes: DataFrame) -> DataFrame:
    """(state_id, path, route_id, fit) of the patterns that fit a state's path.

    The join is on the first segment, where a pattern fixes it, and on the number of segments, where that is fixed. So a path
    goes out under four keys, and meets patterns that leave both open, of which a configuration has few, or that agree in
    what they fix; no pair is made that the key rules out."""
    parts = segments(normal_route(F.col("path")))
    size, head = F.size(parts).cast("string"), F.concat(F.lit("/"), F.get(parts, F.lit(0)))
    keys = F.array_compact(F.array(F.concat(head, F.lit("|"), size), F.concat(head, F.lit("|any")), F.concat(F.lit("|"), size), F.lit("|any")))
    paths = states.select("state_id", "path", F.explode(keys).alias("key"))
    parts = segments(normal_route(F.col("pattern")))
    first = F.get(parts, F.lit(0))
    fixed = first.isNotNull() & ~F.startswith(first, F.lit(":")) & ~F.regexp_like(first, F.lit(WILD))
    count = F.when(varies(F.col("pattern")), F.lit("any")).otherwise(F.size(parts).cast("string"))
    key = F.concat(F.when(fixed, F.concat(F.lit("/"), first)).otherwise(F.lit("")), F.lit("|"), count)
    keyed = routes.select("route_id", "pattern", key.alias("key"))
    both = paths.join(keyed, "key").withColumn("fit", route_fit(F.col("pattern"), F.col("path")))
    return both.filter("fit is not null").select("state_id", "path", "route_id", "fit")


def undominated(candidates: Column) -> Column:
    return F.filter(candidates, lambda x: ~F.exists(candidates, lambda y: (y["route_id"] != x["route_id"]) & dominates(y["fit"], x["fit"])))


def reconcile_routes(states: DataFrame, routes: DataFrame) -> DataFrame:
    """(status, state_id, path, route_ids, reason) from states (state_id, url) and routes (route_id, pattern; null: dynamic).

    A state with one undominated pattern is corroborated, with several ambiguous, with none runtime-only; a pattern that
    fits no state is static-only, a dynamic one ambiguous. A state's candidates are at most the patterns, so gathering
    them in an array is bounded by the configuration, not by the data."""
    states = states.withColumn("path", application_path(F.col("url")))
    static = routes.filter("pattern is not null")
    paths = states.select("path").distinct().select(F.col("path").alias("state_id"), "path")  # each path is matched once
    fits = compatible_routes(paths, static)
    best = fits.groupBy("path").agg(undominated(F.collect_list(F.struct("route_id", "fit"))).alias("best"), F.count(F.lit(1)).alias("n"))
    found = states.join(best, "path", "left")
    n_best = F.size("best")
    exact = F.col("best")[0]["fit"]["exact"]
    status = F.when(F.col("best").isNull(), "runtime-only").when(n_best == 1, "corroborated").otherwise("ambiguous")
    how = F.when(exact & F.startswith(fragment(F.col("url")), F.lit("#/")), "hash-route-match").when(exact, "route-path-exact").otherwise("route-parameter-match")
    reason = F.when(F.col("best").isNull(), "no-static-route-match").when(n_best == 1, how).otherwise("multiple-equally-specific-routes")
    ids = F.array_join(F.array_sort(F.transform(F.coalesce("best", F.array().cast(best.schema["best"].dataType)), lambda x: x["route_id"])), "|")
    seen = found.select(status.alias("status"), F.col("state_id").cast("string").alias("state_id"), "path", ids.alias("route_ids"), reason.alias("reason"))
    none = F.lit(None).cast("string")
    unseen = static.join(fits.select("route_id").distinct(), "route_id", "left_anti")
    unseen = unseen.select(F.lit("static-only"), none, none, "route_id", F.lit("no-runtime-state-for-route"))
    dynamic = routes.filter("pattern is null").select(F.lit("ambiguous"), none, none, "route_id", F.lit("dynamic-static-evidence"))
    return seen.union(unseen).union(dynamic)
