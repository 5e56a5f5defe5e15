"""Text blocks, values that give a tenant away, and statements against claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.text import masked, stable_hash, supported_form

#: Patterns of sensitive values (kind, pattern, group).
SENSITIVE = [
    ("email-address", r"(?i)(?<![A-Za-z0-9_])[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}(?![A-Za-z0-9_])", 0),
    ("customer-identifier", r"(?i)(?<![A-Za-z0-9_])(?:customer|client|tenant)[ \t]+(?:id|name)[ \t]*[:=-][ \t]*([^,.;\n]+)", 1),
]


def blocks(text: Column) -> Column:
    """array of (kind, text): headings, list items, and paragraphs of the lines between them, joined by a space."""
    lines = F.transform(F.split(text, "\r?\n", -1), lambda x: F.regexp_replace(x, r"^[ \t\r\f\x0B]+|[ \t\r\f\x0B]+$", ""))
    none = F.expr("cast(array() as array<struct<kind:string,text:string>>)")
    block = lambda kind, t: F.struct(F.lit(kind).alias("kind"), t.alias("text"))

    def step(s: Column, line: Column) -> Column:
        flushed = F.when(s["open"] != "", F.array_append(s["done"], block("paragraph", s["open"]))).otherwise(s["done"])
        heading = F.regexp_extract(line, r"^#{1,6}[ \t]+(.+)$", 1)
        item = F.regexp_extract(line, r"^(?:[-*+] |[0-9]+[.)] )(.+)$", 1)
        done = F.when(line == "", flushed).when(heading != "", F.array_append(flushed, block("heading", F.trim(heading)))).when(item != "", F.array_append(flushed, block("list-item", F.trim(item)))).otherwise(s["done"])
        rest = F.when((line == "") | (heading != "") | (item != ""), F.lit("")).when(s["open"] == "", line).otherwise(F.concat(s["open"], F.lit(" "), line))
        return F.struct(done.alias("done"), rest.alias("open"))

    last = F.aggregate(lines, F.struct(none.alias("done"), F.lit("").alias("open")), step)
    return F.when(last["open"] != "", F.array_append(last["done"], block("paragraph", last["open"]))).otherwise(last["done"])


def tenant_warnings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, kind, value, masked_value, warning_id) of the sensitive values of each text, one row for each occurrence."""
    def of_kind(kind: str, pattern: str, group: int) -> Column:
        return F.transform(F.regexp_extract_all(text_col, F.lit(pattern), F.lit(group)), lambda v: F.struct(F.lit(kind).alias("kind"), F.trim(v).alias("value")))

    found = F.flatten(F.array(*[of_kind(*x) for x in SENSITIVE]))
    rows = docs.filter(F.col(text_col).isNotNull()).select(id_col, F.explode(found).alias("x")).select(id_col, "x.kind", "x.value")
    key = F.concat_ws("|", "kind", F.lower("value"), F.col(id_col).cast("string"))
    return rows.withColumn("masked_value", masked(F.col("value"))).withColumn("warning_id", F.concat(F.lit("tenant-warning-"), stable_hash(key)))


def revalidated(blocks: DataFrame, ledger: DataFrame, claims: DataFrame, limitations: DataFrame, screenshots: DataFrame) -> DataFrame:
    """(document_id, block, source, claim_ids, status, issue) for the blocks (document_id, block, kind, text) of edited documents
    but their headings. A block is held by the first ledger entry (document_id, place, text, claim_ids) that says the same; then
    by the first claim (document_id, claim_id, place, text, status, publishable); then by a limitation (document_id, message); then
    by a screenshot (document_id, path), in this order. What a ledger entry says is invalid if one of its claims is ambiguous or
    conflicting. A document in which nothing is left to hold gives one row with block null.

    Entries are reduced to one for each form of a document before they meet the blocks."""
    form = lambda c: supported_form(F.col(c))
    rows = blocks.filter("kind <> 'heading'").select("document_id", "block", "text", form("text").alias("form"))
    unsure = F.coalesce(F.col("status").isin("ambiguous", "conflicting"), F.lit(False))
    bad = claims.filter(unsure).select("document_id", F.col("claim_id").alias("c"), F.lit(True).alias("unsure")).distinct()
    told = ledger.select("document_id", form("text").alias("form"), "place", "claim_ids").groupBy("document_id", "form").agg(F.min_by("claim_ids", "place").alias("ledger_ids"))
    doubted = told.select("document_id", "form", F.explode("ledger_ids").alias("c")).join(bad, ["document_id", "c"]).select("document_id", "form", "unsure").distinct()
    told = told.join(doubted, ["document_id", "form"], "left")
    good = claims.filter(F.coalesce("publishable", F.lit(False)) & ~unsure).select("document_id", form("text").alias("form"), "place", "claim_id")
    good = good.groupBy("document_id", "form").agg(F.min_by("claim_id", "place").alias("claim"))
    limits = limitations.select("document_id", form("message").alias("form"), F.lit(True).alias("limit")).distinct()
    shown = screenshots.select("document_id", F.col("path").alias("text"), F.lit(True).alias("shot")).distinct()
    rows = rows.join(told, ["document_id", "form"], "left").join(good, ["document_id", "form"], "left").join(limits, ["document_id", "form"], "left").join(shown, ["document_id", "text"], "left")
    source = F.when(F.col("ledger_ids").isNotNull(), "ledger").when(F.col("claim").isNotNull(), "claim").when(F.col("limit"), "limitation").when(F.col("shot"), "screenshot")
    ids = F.when(F.col("ledger_ids").isNotNull(), F.col("ledger_ids")).when(F.col("claim").isNotNull(), F.array("claim")).otherwise(F.expr("cast(array() as array<string>)"))
    issue = F.when(source.isNull(), "unsupported-statement").when((source == "ledger") & F.col("unsure"), "ambiguous-statement")
    out = rows.select("document_id", "block", source.alias("source"), ids.alias("claim_ids"), F.when(issue.isNull(), "valid").otherwise("invalid").alias("status"), issue.alias("issue"))
    empty = blocks.select("document_id").distinct().join(rows.select("document_id").distinct(), "document_id", "left_anti")
    none = F.lit(None).cast("string")
    return out.unionByName(empty.select("document_id", F.lit(None).cast(blocks.schema["block"].dataType).alias("block"), none.alias("source"), F.expr("cast(array() as array<string>)").alias("claim_ids"), F.lit("invalid").alias("status"), F.lit("uncited-statement").alias("issue")))
