"""Claims, their statements and pictures, and the review of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.functions.names import box_issue, claim_allowed, mapping_status
from tracelake.functions.text import redacted, stable_hash

#: The order of claims by kind, and the steps that a document may take.
KINDS = ["goal", "route", "action", "input", "outcome", "limitation"]
STEPS = {"created": ["draft"], "edited": ["needs-review", "draft", "approved"], "approved": ["needs-review"], "reopened": ["approved"]}


def publishable(claims: DataFrame, runtime_only: bool = True, static_only: bool = False) -> DataFrame:
    """The claims with publishable and kind_rank, by which they are ordered."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), F.lit(0)), F.lit(9)).cast("int")
    return claims.withColumn("publishable", F.coalesce(claim_allowed(F.col("status"), runtime_only, static_only), F.lit(False))).withColumn("kind_rank", rank)


def claim_targets(claims: DataFrame, targets: DataFrame, screenshots: DataFrame, page: tuple[int, int] = (800, 600)) -> DataFrame:
    """(claim_id, path, issue): where a claim can be pointed at in a picture of its state, or why not. The targets of a claim
    are counted before the join, so a claim stays one row."""
    known = targets.groupBy("state_id", "target_id").agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in "xywh"])
    rows = claims.join(known, ["state_id", "target_id"], "left").join(screenshots, "state_id", "left")
    box = box_issue(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(page[0]), F.lit(page[1]))
    issue = F.when(F.col("target_id").isNull(), F.lit("no-visual-target")).when(F.col("status") == "ambiguous", F.lit("claim-ineligible")).when(F.col("n").isNull(), F.lit("no-visual-target"))
    issue = issue.when(F.col("n") > 1, F.lit("ambiguous-runtime-target")).when(F.col("path").isNull(), F.lit("screenshot-unavailable")).otherwise(box)
    return rows.select("claim_id", "feature_id", "path", issue.alias("issue"))


def step_status(mapped: DataFrame) -> DataFrame:
    """(feature_id, callouts, claims, status): how far the claims of a step are shown."""
    rows = mapped.groupBy("feature_id").agg(F.count_if(F.col("issue").isNull()).alias("callouts"), F.count(F.lit(1)).alias("claims"), F.array_sort(F.collect_set("issue")).alias("issues"))  # kinds of issues
    return rows.select("feature_id", "callouts", "claims", mapping_status(F.col("callouts"), F.col("claims"), F.col("issues")).alias("status"))


def status_counts(mapped: DataFrame, statuses: list[str]) -> DataFrame:
    return mapped.agg(*[F.count_if(F.col("status") == s).alias(s.replace("-", "_")) for s in statuses])


def supports_procedure(claims: DataFrame) -> DataFrame:
    """(feature_id, supported): an action with a transition and an outcome are there."""
    action = (F.col("kind") == "action") & F.col("transition_id").isNotNull()
    return claims.groupBy("feature_id").agg((F.coalesce(F.bool_or(action), F.lit(False)) & F.coalesce(F.bool_or(F.col("kind") == "outcome"), F.lit(False))).alias("supported"))


def statement_issues(statements: DataFrame, claims: DataFrame) -> DataFrame:
    """(section, idx, claim_id, issue): statements without a claim, with an unknown one, or with one that may not be published."""
    none = statements.filter(F.size("claim_ids") == 0).select("section", "idx", F.lit(None).cast("string").alias("claim_id"), F.lit("statement-without-claim").alias("issue"))
    used = statements.select("section", "idx", F.explode("claim_ids").alias("claim_id")).join(publishable(claims).select("claim_id", "publishable"), "claim_id", "left")
    issue = F.when(F.col("publishable").isNull(), F.lit("unknown-claim")).when(~F.col("publishable"), F.lit("claim-not-publishable"))
    return none.unionByName(used.withColumn("issue", issue).filter("issue is not null").select("section", "idx", "claim_id", "issue"))


def unused_claims(statements: DataFrame, claims: DataFrame) -> DataFrame:
    """Publishable claims that no statement uses."""
    used = statements.select(F.explode("claim_ids").alias("claim_id")).distinct()
    return publishable(claims).filter("publishable").join(used, "claim_id", "left_anti").select("claim_id")


def catalog(claims: DataFrame, statements: DataFrame) -> DataFrame:
    """(feature_id, claims, publishable, limitations)."""
    return publishable(claims).groupBy("feature_id").agg(F.count(F.lit(1)).alias("claims"), F.count_if("publishable").alias("publishable"), F.count_if(F.col("kind") == "limitation").alias("limitations"))


def review(audits: DataFrame) -> DataFrame:
    """audits (doc_id, number, action, status, warnings) with state and legal: what a document is after each entry, and whether
    the entry may follow the one before."""
    before = F.lag("action").over(W.partitionBy("doc_id").orderBy("number"))  # the entries of a document
    after = F.when(F.col("action") == "approved", F.lit("approved")).when(F.col("action") == "created", F.lit("draft")).otherwise(F.lit("needs-review"))
    legal = F.when(F.col("action") == "created", before.isNull()).otherwise(before.isNotNull()) & F.when(F.col("action") == "approved", F.coalesce(before == "edited", F.lit(False))).otherwise(F.lit(True))
    return audits.withColumn("state", after).withColumn("legal", legal)


def export_gate(audits: DataFrame) -> DataFrame:
    """(doc_id, number, refusal): the last entry of each document, and the first reason why it may not be exported."""
    last = audits.groupBy("doc_id").agg(F.max_by(F.struct("number", "action", "status", "warnings"), "number").alias("x")).select("doc_id", "x.*")
    refusal = F.when(F.col("action") != "approved", F.lit("not-approved")).when(F.col("status") != "passed", F.lit("validation-failed")).when(F.col("warnings") > 0, F.lit("open-warnings"))
    return last.select("doc_id", "number", refusal.alias("refusal"))


def revision_checksum(*parts: Column) -> Column:
    """The SHA-256 of the parts, each on a line of its own."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def annotation_sets(callouts: DataFrame) -> DataFrame:
    """(id, state_id, path, n_callouts, callouts): the distinct callouts (callout_id, state_id, path, number) of each picture in
    the order of their numbers. The callouts of one picture are one row: a picture has as many as a reader can tell apart."""
    first = callouts.groupBy("state_id", "path", "callout_id").agg(F.min("number").alias("number"))
    sets = first.groupBy("state_id", "path").agg(F.array_sort(F.collect_list(F.struct("number", "callout_id"))).alias("x"))
    ids = F.array_join("x.callout_id", "|")
    return sets.select(F.concat(F.lit("screenshot-annotation-set:"), stable_hash(F.concat_ws("|", "state_id", "path", ids))).alias("id"), "state_id", "path", F.size("x").cast("long").alias("n_callouts"), F.array_join("x.callout_id", ",").alias("callouts"))


def mapping_issues(steps: DataFrame, callouts: DataFrame, pictures: DataFrame) -> DataFrame:
    """(rule, subject): callouts (callout_id, step, state_id, path, number) that stand twice, show a picture that their state
    (state_id, path) does not have, or leave a gap in the numbers of a picture; steps (step, status) that are mapped without a
    callout, or have one without a target."""
    twice = callouts.groupBy("callout_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("duplicate-callout").alias("rule"), F.col("callout_id").alias("subject"))
    lost = callouts.join(pictures, ["state_id", "path"], "left_anti").select(F.lit("screenshot-mismatch").alias("rule"), F.col("callout_id").alias("subject"))
    gap = callouts.groupBy("state_id", "path").agg(F.count_distinct("number").alias("n"), F.min("number").alias("low"), F.max("number").alias("high")).filter("low <> 1 or high <> n").select(F.lit("callout-numbering").alias("rule"), F.concat_ws("|", "state_id", "path").alias("subject"))
    counted = steps.join(callouts.groupBy("step").agg(F.count(F.lit(1)).alias("n")), "step", "left")
    empty = counted.filter("status = 'mapped' and n is null").select(F.lit("mapped-without-callout").alias("rule"), F.col("step").cast("string").alias("subject"))
    full = counted.filter("status = 'no-visual-target' and n > 0").select(F.lit("callout-without-target").alias("rule"), F.col("step").cast("string").alias("subject"))
    return twice.union(lost).union(gap).union(empty).union(full)


def latest_packages(entries: DataFrame) -> DataFrame:
    """Of the entries (feature_id, package_id, path, updated) of a feature and package the one with the last path."""
    best = entries.groupBy("feature_id", "package_id").agg(F.max_by(F.struct("path", "updated"), "path").alias("x"))
    return best.select("feature_id", "package_id", "x.*")


def merged_warnings(detected: DataFrame, redacted: DataFrame) -> DataFrame:
    """The detected warnings (warning_id, state) and the redacted ones that are detected no more."""
    return detected.unionByName(redacted.join(detected, "warning_id", "left_anti"))


def internal_evidence(items: DataFrame, links: DataFrame, operations: DataFrame, results: DataFrame) -> DataFrame:
    """(id, feature_id, kind, label, node_id, contract_id, result_id): what a feature rests on without showing it: its requests
    and executions, items (feature_id, kind: http or graphql, item_id, label, node_id, result_id), and the documented operations
    that links (link_id, feature_id, node_id, operation_id, result_id) name, if operation (operation_id, type, name) and result
    (result_id) are there. One row for each identity and feature."""
    key = lambda kind, of: F.concat(F.lit("knowledge-internal:"), stable_hash(F.concat_ws("|", F.lit(kind) if isinstance(kind, str) else kind, of)))
    none = F.lit(None).cast("string")
    own = items.filter("kind in ('http', 'graphql')").select(key(F.col("kind"), F.col("item_id")).alias("id"), "feature_id", "kind", redacted(F.col("label")).alias("label"), "node_id", none.alias("contract_id"), "result_id")
    known = links.join(operations.select("operation_id", "type", "name"), "operation_id").join(results.select("result_id").distinct(), "result_id", "left_semi")
    named = known.select(key("contract", F.col("link_id")).alias("id"), "feature_id", F.lit("contract-operation").alias("kind"), F.concat_ws(" ", "type", redacted(F.col("name"))).alias("label"), "node_id", F.col("operation_id").alias("contract_id"), "result_id")
    rows = own.unionByName(named)
    first = rows.groupBy("feature_id", "id").agg(F.min(F.struct("kind", "label", "node_id", "contract_id", "result_id")).alias("x"))
    return first.select("id", "feature_id", "x.*")


def limitations(claims: DataFrame, bounded: bool = True) -> DataFrame:
    """(feature_id, kind, claim_id, message): what the claims (claim_id, feature_id, kind, status) of a feature do not show:
    no outcome was seen, a claim's evidence is ambiguous or in conflict, and runtime coverage is bounded."""
    outcome = F.col("kind").isin("visible-outcome", "validation-message")
    seen = claims.groupBy("feature_id").agg(F.coalesce(F.bool_or(outcome), F.lit(False)).alias("seen"))
    none = F.lit(None).cast("string").alias("claim_id")
    missing = seen.filter("not seen").select("feature_id", F.lit("missing-evidence").alias("kind"), none, F.lit("Success or error outcome was not observed in runtime evidence.").alias("message"))
    unsure = claims.filter("status in ('ambiguous', 'conflicting')")
    kind = F.when(F.col("status") == "ambiguous", F.lit("evidence-ambiguity")).otherwise(F.lit("evidence-conflict"))
    doubt = unsure.select("feature_id", kind.alias("kind"), "claim_id", F.concat("kind", F.lit(" evidence is "), "status", F.lit(" and is not publishable.")).alias("message"))
    out = missing.unionByName(doubt)
    return out.unionByName(seen.select("feature_id", F.lit("bounded-runtime").alias("kind"), none, F.lit("Runtime evidence was collected with bounded coverage.").alias("message"))) if bounded else out


def ui_claim_status(items: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """items (item_id, status, refs) with status ambiguous where an ambiguous result about elements refers to one of their refs:
    ambiguous (ref)."""
    hit = items.select("item_id", F.explode("refs").alias("ref")).join(ambiguous.select("ref").distinct(), "ref", "left_semi").select("item_id", F.lit(True).alias("__hit")).distinct()
    rows = items.join(hit, "item_id", "left")
    return rows.select(*[F.when(F.col("__hit"), F.lit("ambiguous")).otherwise(F.col("status")).alias("status") if c == "status" else F.col(c) for c in items.columns])
