"""Validators as registries of rules: what a row must hold is tried in one scan, what it refers to by anti joins.

A validator gives its violations as (rule, subject) rows, none where everything holds. `strict` raises at the first of them in
the order of the rules. The numbers of violations of a scan can be had without a second one, by an Observation."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tracelake.functions.names import unsafe_secret

from .evidence import DOMAINS, STATUSES

ISSUE = "rule string, subject string"
#: Statuses of contract results, strengths, types of operations, states of documents.
CONTRACT_STATUSES = ["corroborated", "contract-only", "product-only", "ambiguous", "conflicting"]
STRENGTHS = ["exact", "strong", "supporting"]
OPERATION_TYPES = ["query", "mutation", "subscription", "unknown"]
GENERATION = ["generating", "succeeded", "failed"]
REVIEW = ["draft", "needs-review", "approved"]


class RowRule(NamedTuple):
    """A name, and when a row breaks it; a condition that is null is not broken."""

    name: str
    broken: Column


class Reference(NamedTuple):
    """A name, references (subject, ref), and the known identifiers (ref)."""

    name: str
    references: DataFrame
    known: DataFrame


def row_issues(rows: DataFrame, subject: str, rules: list[RowRule], watch: Observation | None = None) -> DataFrame:
    """(rule, subject) for every rule that a row breaks: one pass, no shuffle. watch gets the number of each rule."""
    found = F.filter(F.array(*[F.when(F.coalesce(r.broken, F.lit(False)), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    rows = rows.select(found.alias("__rules"), F.col(subject).cast("string").alias("subject"))
    if watch is not None:
        rows = rows.observe(watch, *[F.count_if(F.array_contains("__rules", r.name)).alias(r.name) for r in rules])
    return rows.select(F.explode("__rules").alias("rule"), "subject")


def reference_issues(references: list[Reference]) -> DataFrame | None:
    """(rule, subject) for the references that nothing known answers."""
    out = None
    for name, rows, known in references:
        lost = rows.filter("ref is not null").join(known.select("ref").distinct(), "ref", "left_anti")
        part = lost.select(F.lit(name).alias("rule"), F.col("subject").cast("string").alias("subject"))
        out = part if out is None else out.unionByName(part)
    return out


def repeats(rows: DataFrame, column: str, rule: str) -> DataFrame:
    found = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return found.select(F.lit(rule).alias("rule"), F.col(column).cast("string").alias("subject"))


def union(*parts: DataFrame | None) -> DataFrame:
    held = [p for p in parts if p is not None]
    out = held[0]
    for part in held[1:]:
        out = out.unionByName(part)
    return out


def strict(issues: DataFrame, order: list[str] | None = None) -> None:
    """Raise the first violation: by the given order of rules, then by subject."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), F.col("rule")), F.lit(0)), F.lit(len(order) + 1)) if order else F.lit(0)
    first = issues.orderBy(place, "rule", "subject").first()
    if first is not None:
        raise ValueError(f"{first.rule}: {first.subject}")


def _refs(rows: DataFrame, subject: str, ref: Column) -> DataFrame:
    return rows.select(F.col(subject).alias("subject"), ref.alias("ref"))


def reconciliation_issues(results: DataFrame, nodes: DataFrame, observed: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """results (id, domain, status, strength, static, runtime, reasons), nodes (ref) of the code, observed (ref), and for
    routes and elements the candidates (id, node, selection) that were compared."""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) == 0
    given = F.coalesce(F.col("runtime"), F.lit("")) != ""
    rules = [
        RowRule("no-reasons", none("reasons")), RowRule("unknown-status", ~F.col("status").isin(STATUSES)), RowRule("unknown-domain", ~F.col("domain").isin(DOMAINS)),
        RowRule("corroborated-incomplete", (F.col("status") == "corroborated") & (F.col("strength").isNull() | none("static") | ~given)),
        RowRule("static-only-references", (F.col("status") == "static-only") & (none("static") | given)),
        RowRule("runtime-only-references", (F.col("status") == "runtime-only") & (~none("static") | ~given)),
    ]
    static = results.select(F.col("id").alias("subject"), F.explode("static").alias("ref"))
    exact = results.filter("strength = 'exact' and domain not in ('route', 'ui')").select("domain", F.explode("static").alias("ref"))
    twice = exact.groupBy("domain", "ref").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("duplicate-exact-match").alias("rule"), F.col("ref").alias("subject"))
    parts = [row_issues(results, "id", rules), repeats(results, "id", "duplicate-result"), twice]
    refs = [Reference("missing-static-reference", static, nodes), Reference("missing-runtime-reference", _refs(results, "id", F.nullif(F.col("runtime"), F.lit(""))), observed)]
    if candidates is not None:
        refs.append(Reference("missing-candidate", _refs(candidates, "id", F.col("node")), nodes))
        counted = candidates.groupBy("id").agg(F.count_if(F.col("selection") == "selected").alias("selected"), F.count_if(F.col("selection") == "equally-specific").alias("tied"))
        rows = results.join(counted, "id")
        parts.append(row_issues(rows, "id", [RowRule("corroborated-selection", (F.col("status") == "corroborated") & (F.col("selected") != 1)), RowRule("ambiguous-selection", (F.col("domain") == "route") & (F.col("status") == "ambiguous") & given & (F.col("tied") < 2))]))
    return union(*parts, reference_issues(refs))


def contract_issues(items: DataFrame, provenance: DataFrame, references: DataFrame) -> DataFrame:
    """items (id, part, type, value, style) of a documented contract: operations have a type, endpoints a value, the api a
    style; provenance (id, source_url, section, location, source_text); references (subject, ref) from items to it."""
    url = F.regexp_like("value", F.lit(r"^https?://[^/?#\s]+[^\s]*$"))
    rules = [
        RowRule("invalid-operation-type", (F.col("part") == "operation") & ~F.coalesce(F.col("type").isin(OPERATION_TYPES), F.lit(False))),
        RowRule("invalid-endpoint", (F.col("part") == "endpoint") & ~F.coalesce(url, F.lit(False))),
    ]
    empty = lambda *names: ~F.least(*[F.coalesce(F.col(n), F.lit("")) != "" for n in names])
    told = [RowRule("invalid-provenance", empty("source_url", "section", "location", "source_text")), RowRule("unsafe-secret", unsafe_secret(F.col("source_text")))]
    style = items.agg(F.max(F.when(F.col("part") == "api", F.col("style"))).alias("style"), F.count_if(F.col("part") == "operation").alias("n"))
    odd = style.filter("style = 'unknown' and n > 0").select(F.lit("style-without-operations").alias("rule"), F.lit("api").alias("subject"))
    return union(row_issues(items, "id", rules), repeats(items, "id", "duplicate-contract-id"), row_issues(provenance, "id", told), reference_issues([Reference("missing-provenance", references, provenance.select(F.col("id").alias("ref")))]), odd)


def contract_reconciliation_issues(results: DataFrame, contract: DataFrame, product: DataFrame, dimensions: DataFrame, links: DataFrame, known: DataFrame) -> DataFrame:
    """results (id, status, strength); contract and product references (id, kind, ref) of results; dimensions (id, status,
    contract_value, product_value); feature links (id, feature_id, node_id, result_id, operation_id); known (kind, ref): all
    that may be referred to, by kind, feature among them."""
    rules = [RowRule("unsupported-status", ~F.coalesce(F.col("status").isin(CONTRACT_STATUSES), F.lit(False))), RowRule("unsupported-strength", ~F.col("strength").isin(STRENGTHS))]
    clash = [RowRule("impossible-conflict", (F.col("status") == "conflict") & (F.col("contract_value").isNull() | F.col("product_value").isNull()))]
    kinds = known.select("kind", "ref").distinct()

    def lost(rows: DataFrame, rule: str) -> DataFrame:
        return rows.filter("ref is not null").join(kinds, ["kind", "ref"], "left_anti").select(F.lit(rule).alias("rule"), F.col("id").alias("subject"))

    features = links.select("id", F.lit("feature").alias("kind"), F.col("feature_id").alias("ref"))
    nodes = links.select("id", F.lit("node").alias("kind"), F.col("node_id").alias("ref"))
    through = contract.filter("kind = 'operation'").select(F.col("id").alias("result_id"), F.col("ref").alias("operation_id")).join(product.filter("kind = 'node'").select(F.col("id").alias("result_id"), F.col("ref").alias("node_id")), "result_id")
    broken = links.join(through, ["result_id", "operation_id", "node_id"], "left_anti").select(F.lit("invalid-feature-path").alias("rule"), F.col("id").alias("subject"))
    parts = [row_issues(results, "id", rules), row_issues(dimensions, "id", clash), repeats(results, "id", "duplicate-result"), repeats(links, "id", "duplicate-link")]
    return union(*parts, lost(contract, "invalid-contract-reference"), lost(product, "invalid-product-reference"), lost(features, "invalid-feature-reference"), lost(nodes, "invalid-static-reference"), broken)


def writer_issues(claims: DataFrame, classes: DataFrame, prose: DataFrame, plan: DataFrame, duplicates: DataFrame, intents: DataFrame) -> DataFrame:
    """(code, place, claim_id) for the output of a writer: claims (claim_id, kind); classes (claim_id, class: selected, context
    or excluded, reason); prose (part, idx, claim_ids), parts being step, prerequisite, expected and others; plan (idx,
    claim_id); duplicates (idx, claim_id, retained); intents (idx, step, claim_ids)."""
    told = lambda code, place, claim: (F.lit(code).alias("code"), place.alias("place"), claim.cast("string").alias("claim_id"))
    none, selection = F.lit(None).cast("string"), F.lit("selection")
    known = claims.select("claim_id", "kind").distinct()
    sorted_ = classes.select("claim_id", "class").distinct().groupBy("claim_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("class") == "excluded", F.lit(True))).alias("out"))
    marked = known.join(sorted_, "claim_id", "full").select("claim_id", "kind", "n", "out")
    parts = [
        classes.select("claim_id").join(known, "claim_id", "left_anti").select(*told("unknown-claim", selection, F.col("claim_id"))),
        marked.filter("kind is not null and n is null").select(*told("unclassified-claim", selection, F.col("claim_id"))),
        marked.filter("kind is not null and n > 1").select(*told("duplicate-classification", selection, F.col("claim_id"))),
        prose.filter("size(claim_ids) = 0").select(*told("missing-citation", F.concat_ws(":", "part", "idx"), none)),
    ]
    cited = prose.select("part", "idx", F.explode("claim_ids").alias("claim_id")).join(marked, "claim_id", "left")
    code = F.when(F.col("kind").isNull(), F.lit("unknown-claim")).when(F.col("out"), F.lit("excluded-claim-used")).when(F.col("n").isNull(), F.lit("unselected-claim-used"))
    parts.append(cited.withColumn("code", code).filter("code is not null").select("code", F.concat_ws(":", "part", "idx").alias("place"), F.col("claim_id").cast("string").alias("claim_id")))
    for part, kinds, name in (("prerequisite", ["runtime-observation"], "unsupported-prerequisite"), ("expected", ["visible-outcome", "validation-message", "navigation-outcome"], "unsupported-outcome")):
        good = cited.filter(F.col("part") == part).filter(F.col("kind").isin(kinds)).select("idx").distinct()
        parts.append(prose.filter(F.col("part") == part).join(good, "idx", "left_anti").select(*told(name, F.concat_ws(":", "part", "idx"), none)))
    gone = classes.filter("class = 'excluded' and reason = 'duplicate'").select("claim_id").distinct()
    stays = classes.filter("class in ('selected', 'context')").select(F.col("claim_id").alias("retained")).distinct()
    fine = duplicates.join(gone, "claim_id", "left_semi").join(stays, "retained", "left_semi").select("idx")
    parts.append(duplicates.join(fine, "idx", "left_anti").select(*told("invalid-deduplication", F.concat_ws(":", F.lit("duplicate"), "idx"), F.col("claim_id"))))
    planned = plan.join(marked, "claim_id", "left")
    code = F.when(F.col("kind").isNull(), F.lit("unknown-claim")).when(F.col("out"), F.lit("excluded-claim-used"))
    parts.append(planned.withColumn("code", code).filter("code is not null").select("code", F.concat_ws(":", F.lit("plan"), "idx").alias("place"), F.col("claim_id").cast("string").alias("claim_id")))
    steps = prose.filter("part = 'step'").select(F.col("idx").alias("step"), F.col("claim_ids").alias("cited"))
    shown = intents.join(steps, "step", "left").filter(F.col("cited").isNull() | (F.size(F.array_except("claim_ids", "cited")) > 0))
    parts.append(shown.select(*told("invalid-screenshot-intent", F.concat_ws(":", F.lit("intent"), "idx"), none)))
    return union(*parts)


def document_issues(documents: DataFrame, revisions: DataFrame) -> DataFrame:
    """documents (id, generation, review, has_article, current_revision, failure, checksum), revisions (document_id, id)."""
    rules = [
        RowRule("invalid-document-id", ~F.coalesce(F.regexp_like("id", F.lit("^[a-z0-9][a-z0-9-]{0,127}$")), F.lit(False))), RowRule("invalid-generation-status", ~F.coalesce(F.col("generation").isin(GENERATION), F.lit(False))),
        RowRule("invalid-review-status", ~F.coalesce(F.col("review").isin(REVIEW), F.lit(False))), RowRule("succeeded-without-article", (F.col("generation") == "succeeded") & ~F.col("has_article")),
        RowRule("failed-without-diagnostic", (F.col("generation") == "failed") & (F.coalesce("failure", F.lit("")) == "")), RowRule("invalid-checksum", ~F.coalesce(F.regexp_like("checksum", F.lit("^[a-f0-9]{64}$")), F.lit(False))),
    ]
    named = documents.filter("current_revision is not null").select("id", F.col("current_revision").alias("revision"))
    lost = named.join(revisions.select(F.col("document_id").alias("id"), F.col("id").alias("revision")), ["id", "revision"], "left_anti")
    return union(row_issues(documents, "id", rules), lost.select(F.lit("missing-revision").alias("rule"), F.col("id").alias("subject")))
