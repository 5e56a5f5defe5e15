"""Typed projections of open data: operations, endpoints and types of graph nodes, network observations of runtime states.

Nodes are (id, type, data) with data a VARIANT. Entries of another shape are passed over, and counted: every projection gives
its rows and (node_id, part, n) for what it left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.variants import boolean_at, canonical_json, is_list, is_object, text_at

#: What an operation may be.
OPERATION_TYPES = ["query", "mutation", "subscription"]


def entries(rows: DataFrame, value: Column, keep: list[str]) -> DataFrame:
    """(keep, place, entry): the entries of a VARIANT list, one row each."""
    listed = rows.select(*keep, value.alias("__list"))
    tvf = rows.sparkSession.tvf.variant_explode(F.col("__list").outer())
    return listed.lateralJoin(tvf).filter("key is null").select(*keep, F.col("pos").alias("place"), F.col("value").alias("entry"))


def _skipped(rows: DataFrame, part: str, wrong: Column) -> DataFrame:
    return rows.filter(wrong).groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).select("node_id", F.lit(part).alias("part"), "n")


def read_operations(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Operations (node_id, name, type, return_type, has_variables), their variables (node_id, place, key, type, required,
    default_value), and what was passed over (node_id, part, n)."""
    data = F.col("data")
    rows = nodes.filter("type = 'graphql-operation'").select(F.col("id").alias("node_id"), "data")
    kind, name = text_at(data, "$.operationType"), text_at(data, "$.name")
    good = F.coalesce(kind.isin(OPERATION_TYPES) & name.isNotNull(), F.lit(False))
    held = rows.filter(good)
    operations = held.select("node_id", name.alias("name"), kind.alias("type"), text_at(data, "$.returnType").alias("return_type"), is_list(data, "$.variables").alias("has_variables"))
    listed = entries(held.filter(is_list(data, "$.variables")), F.try_variant_get(data, "$.variables", "variant"), ["node_id"])
    entry = F.col("entry")
    named = is_object(entry) & text_at(entry, "$.name").isNotNull() & text_at(entry, "$.type").isNotNull()
    variables = listed.filter(named).select("node_id", "place", text_at(entry, "$.name").alias("key"), text_at(entry, "$.type").alias("type"), boolean_at(entry, "$.required").alias("required"), text_at(entry, "$.defaultValue").alias("default_value"))
    return operations, variables, _skipped(rows, "operation", ~good).unionByName(_skipped(listed, "variable", ~named))


def read_endpoints(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Static endpoints (node_id, value) of executions, and the executions without one."""
    data = F.col("data")
    rows = nodes.filter("type = 'graphql-execution'").select(F.col("id").alias("node_id"), "data")
    value = F.when(text_at(data, "$.transport.endpoint.kind") == "static", text_at(data, "$.transport.endpoint.value"))
    return rows.select("node_id", value.alias("value")).filter("value is not null"), _skipped(rows, "endpoint", value.isNull())


def read_types(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Schema types (node_id, place, name), their fields (node_id, place, at, field, type), and what was passed over."""
    data, entry = F.col("data"), F.col("entry")
    rows = nodes.filter("type = 'graphql-document'").select(F.col("id").alias("node_id"), "data")
    listed = entries(rows.filter(is_list(data, "$.schemaTypes")), F.try_variant_get(data, "$.schemaTypes", "variant"), ["node_id"])
    good = is_object(entry) & text_at(entry, "$.name").isNotNull() & is_list(entry, "$.fields")
    held = listed.filter(good)
    types = held.select("node_id", "place", text_at(entry, "$.name").alias("name"))
    inner = entries(held.select("node_id", F.col("place").alias("of"), F.col("entry").alias("owner")), F.try_variant_get(F.col("owner"), "$.fields", "variant"), ["node_id", "of"])
    inner = inner.select("node_id", F.col("of").alias("place"), F.col("place").alias("at"), "entry")
    named = is_object(entry) & text_at(entry, "$.name").isNotNull() & text_at(entry, "$.type").isNotNull()
    fields = inner.filter(named).select("node_id", "place", "at", text_at(entry, "$.name").alias("field"), text_at(entry, "$.type").alias("type"))
    return types, fields, _skipped(listed, "type", ~good).unionByName(_skipped(inner, "field", ~named))


def read_network(states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Network observations (state_id, place, at, observation_id, method, url) of states (state_id, data), flattened from
    data.networkObservations[].network[], and (node_id, part, n) for sets and observations of another shape."""
    data, entry = F.col("data"), F.col("entry")
    rows = states.select(F.col("state_id").alias("node_id"), "data")
    sets = entries(rows.filter(is_list(data, "$.networkObservations")), F.try_variant_get(data, "$.networkObservations", "variant"), ["node_id"])
    good = is_object(entry) & is_list(entry, "$.network")
    inner = entries(sets.filter(good).select("node_id", F.col("place").alias("of"), F.col("entry").alias("owner")), F.try_variant_get(F.col("owner"), "$.network", "variant"), ["node_id", "of"])
    named = is_object(entry) & text_at(entry, "$.id").isNotNull() & text_at(entry, "$.url").isNotNull()
    found = inner.filter(named).select(F.col("node_id").alias("state_id"), F.col("of").alias("place"), F.col("place").alias("at"), text_at(entry, "$.id").alias("observation_id"), text_at(entry, "$.method").alias("method"), text_at(entry, "$.url").alias("url"))
    return found, _skipped(sets, "set", ~good).unionByName(_skipped(inner, "observation", ~named))


def runtime_endpoints(observations: DataFrame, references: DataFrame) -> DataFrame:
    """The observations (observation_id, state_id, transition_id, method, url) that a corroborated result refers to: references
    (observation_id, state_id, transition_id), whose state or transition may be left open. An observation of a state is held
    against the state of a reference, one of a transition against the transition."""
    of_state, named = F.col("state_id").isNotNull(), ["observation_id", "state_id", "transition_id"]
    refs = references.select(*[F.col(c).alias(f"r_{c}") for c in named]).distinct()
    open_state, open_move = (refs.filter(f"r_{c} is null").select("r_observation_id").distinct() for c in ("state_id", "transition_id"))
    same = F.col("observation_id") == F.col("r_observation_id")
    parts = [
        observations.filter(of_state).join(open_state, same, "left_semi"),
        observations.filter(of_state).join(open_state, same, "left_anti").join(refs, same & (F.col("state_id") == F.col("r_state_id")), "left_semi"),
        observations.filter(~of_state).join(open_move, same, "left_semi"),
        observations.filter(~of_state).join(open_move, same, "left_anti").join(refs, same & (F.col("transition_id") == F.col("r_transition_id")), "left_semi"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def retained_observations(rows: DataFrame, keys: list[str], observation: str, order: list[str]) -> DataFrame:
    """(keys, n, n_values, status, observation): the first observation (JSON text) of each key in the given order, how often the
    key was seen and with how many values. Repeats of one value are duplicates however their keys are ordered or numbers
    written; several values are a conflict. What is no JSON counts as the text it is."""
    value = F.coalesce(canonical_json(F.col(observation)), F.concat(F.lit("?"), F.col(observation)), F.lit("null"))
    rows = rows.select(*keys, *order, F.col(observation).alias("__seen"), value.alias("__value"))
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("__value").alias("n_values"), F.min_by("__seen", F.struct(*order)).alias("observation"))
    status = F.when(F.col("n_values") > 1, F.lit("conflict")).when(F.col("n") > 1, F.lit("duplicate")).otherwise(F.lit("single"))
    return found.withColumn("status", status)

