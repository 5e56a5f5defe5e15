"""Summaries and coverage of results, runtime graphs and contracts, each from one aggregation over its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rules import CONTRACT_STATUSES


def ui_context(results: DataFrame) -> DataFrame:
    """One row for results (status, context, evaluated) of elements: how many had a context, how many pairs were tried, how
    many found one or several."""
    eligible = F.col("context") == "eligible"
    return results.agg(
        F.count_if(eligible).alias("with_context"), F.count_if(~F.coalesce(eligible, F.lit(False))).alias("without_context"), F.coalesce(F.sum("evaluated"), F.lit(0)).cast("long").alias("pairs_evaluated"),
        F.count_if(F.col("status") == "corroborated").alias("unique_matches"), F.count_if(F.col("status") == "ambiguous").alias("ambiguous_matches"),
    )


def runtime_coverage(states: DataFrame, transitions: DataFrame) -> DataFrame:
    """One row for states (state_id, boundary, stops, readiness) and transitions."""
    of_states = states.agg(
        F.count(F.lit(1)).alias("states_observed"), F.count_if("boundary").alias("origin_boundaries"), F.count_if(F.array_contains("stops", "mutation-observed")).alias("mutation_stops"),
        F.count_if(F.col("readiness") == "partial").alias("partial_states"), F.count_if(F.size("stops") > 0).alias("branch_stops"),
    )
    return of_states.crossJoin(transitions.agg(F.count(F.lit(1)).alias("transitions_observed")))  # one row each


def discovery_summary(states: DataFrame, transitions: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row for states (boundary, stops, depth), transitions (status) and skipped targets (decision)."""
    a = states.agg(F.count(F.lit(1)).alias("states_discovered"), F.count_if("boundary").alias("boundary_states"), F.count_if(F.array_contains("stops", "mutation-observed")).alias("mutation_stop_branches"), F.greatest(F.lit(0), F.coalesce(F.max("depth"), F.lit(0))).alias("max_depth_reached"))
    b = transitions.agg(F.count_if(F.col("status") == "observed").alias("transitions_observed"), F.count_if(F.col("status") == "failed").alias("failed_transitions"))
    c = skipped.agg(F.count(F.lit(1)).alias("targets_skipped"), F.count_if(F.col("decision") == "blocked").alias("blocked"), F.count_if(F.col("decision") == "unknown").alias("unknown"))
    return a.crossJoin(b).crossJoin(c)  # one row each


def contract_coverage(results: DataFrame) -> DataFrame:
    """(domain, results, compared) for contract results (domain, has_contract, has_product)."""
    return results.groupBy("domain").agg(F.count(F.lit(1)).alias("results"), F.count_if(F.col("has_contract") & F.col("has_product")).alias("compared"))


def contract_totals(results: DataFrame, domains: list[str]) -> DataFrame:
    """(domain, status, results) for every domain and 'total', with a zero for each status that does not occur."""
    spark = results.sparkSession
    spine = spark.createDataFrame([(d, s) for d in [*domains, "total"] for s in CONTRACT_STATUSES], "domain string, status string")
    counts = results.groupBy("domain", "status").agg(F.count(F.lit(1)).alias("n"))
    both = counts.unionByName(counts.groupBy("status").agg(F.sum("n").alias("n")).withColumn("domain", F.lit("total")))
    return spine.join(both, ["domain", "status"], "left").select("domain", "status", F.coalesce("n", F.lit(0).cast("long")).alias("results"))


def endpoint_regions(endpoints: DataFrame) -> DataFrame:
    """(value, region, mentions, first_line) of endpoints (value, region, line): one endpoint for each address and region."""
    return endpoints.groupBy("value", "region").agg(F.count(F.lit(1)).alias("mentions"), F.min("line").alias("first_line"))
