"""The workspace of documents: signals of tenants, revisions, reviews of pictures, and the orders in which things are listed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.names import quoted_label
from tracelake.functions.variants import text_at

from .documents import blocks
from .ordering import collated, numbers_within, total_order

#: Signs that a text speaks of one tenant, with the pattern of each; hosts of examples are no sign.
SIGNALS = [
    ("email-address", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"), ("tenant-hostname", r"(?i)https?://(?!example\.(?:com|test)|localhost)[^\s/]+"),
    ("customer-identifier", r"(?i)\b(?:customer|client|tenant)\s+(?:id|name)\b"),
]
#: Methods that change data, and what a claim of a kind may be called by.
MUTATING = ["POST", "PUT", "PATCH", "DELETE"]
IDENTITY = {"feature-name": "internal-feature", "entry-point": "entry-point", "navigation-outcome": "navigation-outcome", "visible-ui": "visible-ui"}


def tenant_signals(text: Column) -> Column:
    """The signs of a tenant in a text, in their order."""
    return F.array_compact(F.array(*[F.when(F.regexp_like(text, F.lit(p)), F.lit(name)) for name, p in SIGNALS]))


def package_signals(claims: DataFrame) -> DataFrame:
    """(package_id, tenant_specific, signals) for claims (package_id, text, visible): what the visible ones show."""
    rows = claims.select("package_id", F.when(F.col("visible"), tenant_signals(F.coalesce("text", F.lit("")))).alias("s"))
    found = rows.groupBy("package_id").agg(*[F.coalesce(F.bool_or(F.array_contains("s", name)), F.lit(False)).alias(name) for name, _ in SIGNALS])
    signals = F.array_compact(F.array(*[F.when(F.col(f"`{name}`"), F.lit(name)) for name, _ in SIGNALS]))
    return found.select("package_id", (F.size(signals) > 0).alias("tenant_specific"), signals.alias("signals"))


def picture_reviews(pictures: DataFrame, claims: DataFrame) -> DataFrame:
    """(package_id, state_id, path, safety, signals, related) for pictures (package_id, state_id, path): the signs in the visible
    claims (package_id, state_id, text, visible) of their state. What shows none is unknown, not safe."""
    keyed = claims.filter("visible").select(F.struct("package_id", "state_id").alias("package_id"), "text", "visible")
    found = package_signals(keyed).select("package_id.*", "signals")
    counts = claims.filter("visible").groupBy("package_id", "state_id").agg(F.count(F.lit(1)).alias("related"))
    rows = pictures.join(found, ["package_id", "state_id"], "left").join(counts, ["package_id", "state_id"], "left")
    none = F.expr("cast(array() as array<string>)")
    signals = F.coalesce("signals", none)
    safety = F.when(F.size(signals) > 0, F.lit("known-tenant-information")).otherwise(F.lit("unknown"))
    return rows.select("package_id", "state_id", "path", safety.alias("safety"), signals.alias("signals"), F.coalesce("related", F.lit(0).cast("long")).alias("related"))


def safe_reviewer(name: Column) -> Column:
    """A reviewer's name if it has up to 80 plain signs, else a stand-in."""
    name = F.trim(name)
    return F.when(F.regexp_like(name, F.lit(r"^[A-Za-z0-9_ \t.@-]{1,80}$")), name).otherwise(F.lit("Local reviewer"))


def normal_markdown(text: Column) -> Column:
    """Unix line ends, no space around, and a line end at the end."""
    plain = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    return F.concat(F.regexp_replace(plain, r"^\s+|\s+$", ""), F.lit("\n"))


def replaced_in_block(markdown: Column, index: Column, value: Column, put: Column) -> Column:
    """A text in which the first occurrence of a value is replaced, if the block of that number (from 0) holds it; else null."""
    held = F.contains(F.get(blocks(markdown), index)["text"], value)
    at = F.call_function("instr", markdown, value)
    swapped = F.concat(F.substring(markdown, F.lit(1), at - 1), put, F.substring(markdown, at + F.length(value), F.length(markdown)))
    return F.when(F.coalesce(held, F.lit(False)), normal_markdown(swapped))


def numbered_revisions(revisions: DataFrame) -> DataFrame:
    """revisions (document_id, revision_id, created_at) with number, each one more than the one before, and current, the last."""
    rows = numbers_within(revisions, ["document_id"], [F.col("created_at"), F.col("revision_id")])
    last = rows.groupBy("document_id").agg(F.max("number").alias("__last"))
    return rows.join(last, "document_id").select(*rows.columns, (F.col("number") == F.col("__last")).alias("current"))


def meaningful_states(elements: DataFrame) -> DataFrame:
    """(state_id, meaningful): whether anything in a state has a name or a text. elements: (state_id, name, text)."""
    said = (F.coalesce("name", F.lit("")) != "") | (F.coalesce("text", F.lit("")) != "")
    return elements.groupBy("state_id").agg(F.bool_or(said).alias("meaningful"))


def new_mutations(before: DataFrame, after: DataFrame) -> DataFrame:
    """(probe_id, method): changing methods seen after a probe's click and not before it. Both sides: (probe_id, method)."""
    seen = lambda df: df.select("probe_id", F.upper("method").alias("method")).filter(F.col("method").isin(MUTATING)).distinct()
    return seen(after).join(seen(before), ["probe_id", "method"], "left_anti")


def static_descriptors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The elements of a graph as ui_results takes them: (node_id, component_id, s_tag, s_text, s_aria, s_label, s_title, s_hint,
    s_type, s_event) for nodes (id, type, label, data) and edges (id, type, src, dst). Properties are those of data.props that are
    texts; of several of a name the first counts."""
    props = F.expr("try_variant_get(data, '$.props', 'array<variant>')")
    texts = F.filter(props, lambda p: text_at(p, "$.valueType") == "string")
    named = lambda name: F.coalesce(text_at(F.get(F.filter(texts, lambda p: text_at(p, "$.name") == name), F.lit(0)), "$.value"), F.lit(""))
    owners = edges.filter("type = 'CONTAINS_ELEMENT'").groupBy(F.col("dst").alias("node_id")).agg(F.min_by("src", "id").alias("component_id"))
    events = edges.filter("type = 'HAS_EVENT'").select(F.col("src").alias("node_id"), F.lit(True).alias("event")).distinct()
    rows = nodes.filter("type = 'ui-element'").withColumnRenamed("id", "node_id").join(owners, "node_id", "left").join(events, "node_id", "left")
    return rows.select(
        "node_id", "component_id", F.lower(F.coalesce(text_at(F.col("data"), "$.name"), F.lit(""))).alias("s_tag"), quoted_label(F.col("label")).alias("s_text"), named("aria-label").alias("s_aria"), named("label").alias("s_label"),
        named("title").alias("s_title"), named("placeholder").alias("s_hint"), named("type").alias("s_type"), F.coalesce("event", F.lit(False)).alias("s_event"),
    )


def identity_candidates(claims: DataFrame) -> DataFrame:
    """(claim_id, source, text): the claims (claim_id, kind, text, feature_name) by which a feature may be called."""
    source = F.lit(None).cast("string")
    for kind, name in IDENTITY.items():
        source = F.when(F.col("kind") == kind, F.lit(name)).otherwise(source)
    return claims.select("claim_id", source.alias("source"), F.coalesce(F.nullif("text", F.lit("")), "feature_name").alias("text")).filter("source is not null")


def same_reference(a: Column, b: Column, fields: list[str]) -> Column:
    """Whether two references name the same, missing fields being equal."""
    same = F.lit(True)
    for f in fields:
        same = same & a[f].eqNullSafe(b[f])
    return same


def documentation_summary(operations: DataFrame, parts: DataFrame) -> DataFrame:
    """One row for the operations (type) and other parts (part) of a documented contract."""
    a = operations.agg(*[F.count_if(F.col("type") == t).alias(n) for t, n in (("query", "queries"), ("mutation", "mutations"), ("subscription", "subscriptions"), ("unknown", "unknown_operations"))])
    b = parts.agg(*[F.count_if(F.col("part") == p).alias(n) for p, n in (("endpoint", "endpoints"), ("type", "types"), ("authentication", "authentication_requirements"), ("pagination", "pagination_evidence"), ("unresolved", "unresolved_evidence"))])
    return a.crossJoin(b)  # one row each


def ordered_results(results: DataFrame) -> DataFrame:
    """results (id, domain, status) with their place by domain, status and identifier as people sort."""
    return total_order(results, [collated(F.concat_ws("|", "domain", "status", "id")), F.col("id")])


def ordered_features(features: DataFrame) -> DataFrame:
    """features (feature_id, name, route) with their place by route, those without one last, name and identifier."""
    return total_order(features, [F.coalesce("route", F.lit("~")), F.col("name"), F.col("feature_id")])


def ordered_documents(documents: DataFrame) -> DataFrame:
    """documents (id, updated_at) with their place, the latest first."""
    return total_order(documents, [-F.unix_micros(F.col("updated_at").cast("timestamp")), F.col("id")])
