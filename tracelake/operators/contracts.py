"""Documented contracts against what is there: arguments, variants, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.names import graphql_type
from tracelake.functions.urls import normal_route, origin, url_path


def argument_diff(contract: DataFrame, product: DataFrame) -> DataFrame:
    """(operation, argument, dimension, status) from two sides of (operation, argument, type, required, default_value):
    whether an argument is on both sides, and if so whether type, need and (if both have one) default agree."""
    keys, rest = ["operation", "argument"], ["type", "required", "default_value"]
    a = contract.select(*keys, F.struct(*rest).alias("c"))
    b = product.select(*keys, F.struct(*rest).alias("p"))
    both = a.join(b, keys, "full")
    there = F.col("c").isNotNull() & F.col("p").isNotNull()
    agree = lambda name: F.when(F.col(f"c.{name}").eqNullSafe(F.col(f"p.{name}")), "match").otherwise("conflict")
    part = lambda name, status: F.struct(F.lit(name).alias("dimension"), status.alias("status"))
    default = F.col("c.default_value").isNotNull() & F.col("p.default_value").isNotNull()
    rows = F.array(
        part("presence", F.when(there, "match").otherwise("conflict")), part("type", F.when(there, agree("type"))),
        part("required", F.when(there, agree("required"))), part("default", F.when(there & default, agree("default_value"))),
    )
    return both.select(*keys, F.explode(rows).alias("x")).select(*keys, "x.dimension", "x.status").filter("status is not null")


def operation_variants(rows: DataFrame, keys: list[str], signature: list[str]) -> DataFrame:
    """(keys, n_rows, n_variants, conflict): how many signatures an operation is documented with."""
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.struct(*signature)).alias("n_variants"))
    return found.withColumn("conflict", F.col("n_variants") > 1)


def domain_summary(results: DataFrame) -> DataFrame:
    """(domain, status, results): counts for each domain and status, and for each status over all (domain 'all')."""
    rolled = results.groupingSets([["domain", "status"], ["status"]], "domain", "status").agg(F.count(F.lit(1)).alias("results"))
    return rolled.select(F.coalesce("domain", F.lit("all")).alias("domain"), "status", "results")


def signature_dimensions(documented: DataFrame, product: DataFrame, arguments: DataFrame, variables: DataFrame) -> DataFrame:
    """(operation_id, node_id, dimension, key, status) for matched pairs of documented (operation_id, name, type, n_variants,
    return_type) and product operations (node_id, name, type, return_type, has_variables). arguments (operation_id, key, type,
    required, default_value) and variables (node_id, key, type, required, default_value) are compared by a full outer join."""
    pairs = documented.alias("d").join(product.alias("p"), ["name", "type"]).select("operation_id", "node_id", "n_variants", "has_variables", F.col("d.return_type").alias("a"), F.col("p.return_type").alias("b"))
    whole = pairs.filter("n_variants = 1 and has_variables").select("operation_id", "node_id")
    left = whole.join(arguments.select("operation_id", "key", F.struct("type", "required", "default_value").alias("c")), "operation_id")
    right = whole.join(variables.select("node_id", "key", F.struct("type", "required", "default_value").alias("v")), "node_id")
    both = left.join(right, ["operation_id", "node_id", "key"], "full")
    there = F.col("c").isNotNull() & F.col("v").isNotNull()
    same = lambda x, y: F.when(x == y, F.lit("match")).otherwise(F.lit("conflict"))
    part = lambda name, status: F.struct(F.lit(name).alias("dimension"), status.alias("status"))
    need = F.when(F.col("v.required").isNull(), F.lit("insufficient")).otherwise(same(F.col("c.required"), F.col("v.required")))
    default = F.col("c.default_value").isNotNull() & F.col("v.default_value").isNotNull()
    per_argument = F.array(
        part("argument-presence", F.when(~there, F.lit("conflict"))), part("argument-name", F.when(there, F.lit("match"))),
        part("argument-type", F.when(there, same(graphql_type(F.col("c.type")), graphql_type(F.col("v.type"))))),
        part("argument-requiredness", F.when(there, need)), part("argument-default", F.when(there & default, same(F.col("c.default_value"), F.col("v.default_value")))),
    )
    rows = both.select("operation_id", "node_id", "key", F.explode(per_argument).alias("x")).filter("x.status is not null")
    rows = rows.select("operation_id", "node_id", "x.dimension", "key", "x.status")
    vague = ~((F.col("n_variants") == 1) & F.col("has_variables"))
    returned = F.when((F.col("a") == "") | (F.col("b") == "") | F.col("a").isNull() | F.col("b").isNull(), F.lit("insufficient")).otherwise(same(graphql_type(F.col("a")), graphql_type(F.col("b"))))
    per_pair = F.array(
        part("operation-name", F.lit("match")), part("operation-type", F.lit("match")), part("argument-presence", F.when(vague, F.lit("insufficient"))),
        part("return-type", F.when(F.col("n_variants") == 1, returned)),
    )
    plain = pairs.select("operation_id", "node_id", F.explode(per_pair).alias("x")).filter("x.status is not null")
    return rows.unionByName(plain.select("operation_id", "node_id", "x.dimension", F.lit(None).cast("string").alias("key"), "x.status"))


def operation_results(documented: DataFrame, product: DataFrame, dimensions: DataFrame) -> DataFrame:
    """(operation_id, node_id, status, reason) for each documented operation with its candidates, and for each product
    operation that no documented one names: by name and type, else by name alone."""
    named = documented.filter("type <> 'unknown'").select("operation_id", "name", "type")
    pairs = named.join(product.select("node_id", "name", F.col("type").alias("product_type")), "name")
    counts = pairs.groupBy("operation_id").agg(F.count_if(F.col("type") == F.col("product_type")).alias("n_exact"), F.count(F.lit(1)).alias("n_name"))
    wrong = dimensions.filter("status = 'conflict'").select("operation_id").distinct().withColumn("conflict", F.lit(True))
    found = pairs.join(counts, "operation_id").filter("n_exact = 0 or type = product_type").join(wrong, "operation_id", "left")
    n = F.when(F.col("n_exact") > 0, F.col("n_exact")).otherwise(F.col("n_name"))
    bad = (F.col("n_exact") == 0) | F.coalesce("conflict", F.lit(False))
    status = F.when(n > 1, F.lit("ambiguous")).when(bad, F.lit("conflicting")).otherwise(F.lit("corroborated"))
    reason = F.when(n > 1, F.lit("multiple-static-operation-candidates")).when(F.col("n_exact") == 0, F.lit("operation-type-conflict")).otherwise(F.lit("operation-type-match"))
    met = found.select("operation_id", "node_id", status.alias("status"), reason.alias("reason"))
    lost = named.join(pairs.select("operation_id").distinct(), "operation_id", "left_anti").select("operation_id", F.lit(None).cast("string").alias("node_id"), F.lit("contract-only").alias("status"), F.lit("no-static-operation-match").alias("reason"))
    new = product.select("node_id").join(met.select("node_id").distinct(), "node_id", "left_anti")
    return met.unionByName(lost).unionByName(new.select(F.lit(None).cast("string").alias("operation_id"), "node_id", F.lit("product-only").alias("status"), F.lit("no-contract-operation-match").alias("reason")))


def endpoint_results(documented: DataFrame, static: DataFrame, observed: DataFrame, origins: DataFrame) -> DataFrame:
    """(endpoint_id, node_id, ref, status, reason) for documented endpoints (endpoint_id, value), endpoints of the code
    (node_id, value) and observed ones (ref, value), by origin and path. A path of the code counts on an origin that some
    page or request was seen on (origins)."""
    keyed = lambda df, key: df.select(key, origin(F.col("value")).alias("origin"), normal_route(url_path(F.col("value"))).alias("path"))
    contract = keyed(documented, "endpoint_id")
    relative = static.filter(F.startswith("value", F.lit("/"))).select("node_id", normal_route(F.col("value")).alias("path"))
    whole = keyed(static.filter(~F.startswith("value", F.lit("/"))), "node_id")
    exact = contract.join(whole, ["origin", "path"]).select("endpoint_id", "node_id", F.lit("endpoint-exact").alias("reason"))
    by_path = contract.join(origins.select("origin").distinct(), "origin", "left_semi").join(relative, "path").select("endpoint_id", "node_id", F.lit("endpoint-path-match").alias("reason"))
    none = F.lit(None).cast("string")
    of_code = exact.unionByName(by_path).select("endpoint_id", "node_id", none.alias("ref"), F.lit("corroborated").alias("status"), "reason")
    seen = contract.join(keyed(observed, "ref"), ["origin", "path"]).select("endpoint_id", none.alias("node_id"), "ref", F.lit("corroborated").alias("status"), F.lit("endpoint-runtime-observed").alias("reason"))
    met = of_code.unionByName(seen)
    lost = contract.join(met.select("endpoint_id").distinct(), "endpoint_id", "left_anti").select("endpoint_id", none.alias("node_id"), none.alias("ref"), F.lit("contract-only").alias("status"), F.lit("documented-endpoint-not-observed").alias("reason"))
    new = static.join(of_code.select("node_id").distinct(), "node_id", "left_anti").select(none.alias("endpoint_id"), "node_id", none.alias("ref"), F.lit("product-only").alias("status"), F.lit("no-contract-endpoint-match").alias("reason"))
    return met.unionByName(lost).unionByName(new)


def type_results(documented: DataFrame, product: DataFrame, documented_fields: DataFrame, product_fields: DataFrame) -> DataFrame:
    """(name, status, n_fields, n_conflicts) for documented types (name) and types of the code (node_id, name) with fields
    (name, field, type; node_id, field, type). Fields of one side only say nothing."""
    counts = product.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("node_id"))
    met = documented.select("name").join(counts, "name", "left")
    fields = met.filter("n = 1").join(documented_fields, "name").join(product_fields.select("node_id", "field", F.col("type").alias("other")), ["node_id", "field"])
    fields = fields.groupBy("name").agg(F.count(F.lit(1)).alias("n_fields"), F.count_if(graphql_type(F.col("type")) != graphql_type(F.col("other"))).alias("n_conflicts"))
    rows = met.join(fields, "name", "left").na.fill(0, ["n_fields", "n_conflicts"])
    status = F.when(F.col("n").isNull(), F.lit("contract-only")).when(F.col("n") > 1, F.lit("ambiguous")).when(F.col("n_conflicts") > 0, F.lit("conflicting")).otherwise(F.lit("corroborated"))
    rows = rows.select("name", status.alias("status"), "n_fields", "n_conflicts")
    new = product.join(documented.select("name").distinct(), "name", "left_anti").select("name", F.lit("product-only").alias("status"), F.lit(0).cast("long").alias("n_fields"), F.lit(0).cast("long").alias("n_conflicts"))
    return rows.unionByName(new)


def feature_links(results: DataFrame, features: DataFrame) -> DataFrame:
    """(feature_id, node_id, operation_id): documented operations of the features (feature_id, node_id) whose code they name."""
    sure = results.filter("status in ('corroborated', 'conflicting') and operation_id is not null and node_id is not null")
    return sure.join(features, "node_id").select("feature_id", "node_id", "operation_id").distinct()


def with_transport(results: DataFrame, executes: DataFrame, transports: DataFrame) -> DataFrame:
    """(operation_id, node_id, ref): the observations of the transport by which an operation's executions travel. executes
    (execution_id, node_id), transports (execution_id, ref)."""
    return results.filter("node_id is not null").join(executes, "node_id").join(transports, "execution_id").select("operation_id", "node_id", "ref").distinct()
