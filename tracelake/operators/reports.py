"""Text reports as rows (report_id, place, line): each section is a table of lines, joined to nothing but its own report, and
the lines are numbered by the total order of sections. No task holds a report, however long it is. `write` is the text sink.

The parts of a report come with their place in it (`place`, from 1); places must be distinct within a report and part. Null
texts are empty lines; parts whose report_id is null, or has no report, are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .evidence import DOMAINS
from .ordering import numbers_within, split_off
from .rules import CONTRACT_STATUSES

#: The domains in the order of a report, and the statuses it counts.
COUNTED = ["corroborated", "static-only", "runtime-only", "ambiguous"]
WHERE = ["section", "item", "sub", "detail"]
#: Lines before an operation's features, and of one that nothing proves.
_FEATURES = ["", "FEATURES"]
_UNPROVEN = ["", "RUNTIME", "Transport endpoint observed", "Named operation execution unproven"]


def _at(rows: DataFrame, section: int, item: Column, line: Column, sub: Column | int = 0, detail: Column | int = 0) -> DataFrame:
    def number(x: Column | int) -> Column:
        return (x if isinstance(x, Column) else F.lit(x)).cast("long")

    return rows.select("report_id", F.lit(section).alias("section"), number(item).alias("item"), number(sub).alias("sub"), number(detail).alias("detail"), F.coalesce(line.cast("string"), F.lit("")).alias("line"))


def _texts(rows: DataFrame, section: int, texts: list[Column | str], item: Column | int = 0, sub: int = 0) -> DataFrame:
    """The same lines for every row, one after the other; a text that is a Column is one of the row."""
    lines = F.array(*[F.coalesce(t.cast("string"), F.lit("")) if isinstance(t, Column) else F.lit(t) for t in texts])
    at = item if isinstance(item, Column) else F.lit(item)
    return _at(rows.select("report_id", at.alias("__at"), F.posexplode(lines).alias("__n", "__line")), section, F.col("__at"), F.col("__line"), sub, F.col("__n"))


def _section(reports: DataFrame, section: int, heading: list[str], rows: DataFrame, line: Column, none: str | None = None) -> list[DataFrame]:
    """The heading and the lines of rows (report_id, place, ...). Without rows a report has `none` as its only line, or, where
    that is not given, not even the heading."""
    body = _at(rows, section, F.col("place"), line)
    having = rows.select("report_id").distinct()
    if none is None:
        return [_texts(reports.join(having, "report_id", "left_semi"), section, heading), body]
    lost = reports.join(having, "report_id", "left_anti")
    return [_texts(reports, section, heading), _texts(lost, section, [none], item=1), body]


def _placed(reports: DataFrame, parts: list[DataFrame]) -> DataFrame:
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    lines = lines.join(reports.select("report_id").distinct(), "report_id", "left_semi")
    placed = numbers_within(lines, ["report_id"], [F.col(c) for c in [*WHERE, "line"]], "place")
    return placed.select("report_id", "place", "line")


def reconciliation_report(results: DataFrame, coverage: DataFrame) -> DataFrame:
    """Of results (report_id, domain, status) and one row of coverage (report_id, states, max_depth, mutation_stops,
    origin_boundaries) for each report: a line for every domain, with zeros where it has no result."""
    counts = [F.count_if((F.col("domain") == d) & (F.col("status") == s)).alias(f"{d}|{s}") for d in DOMAINS for s in COUNTED]
    rows = coverage.join(results.groupBy("report_id").agg(*counts), "report_id", "left")

    def told(domain: str) -> Column:
        parts = [F.concat(F.coalesce(F.col(f"`{domain}|{s}`"), F.lit(0)).cast("string"), F.lit(f" {s}")) for s in COUNTED]
        return F.concat(F.lit(f"{domain.upper()} "), F.concat_ws(", ", *parts))

    depth = F.format_string("RUNTIME COVERAGE %d states / depth %d", "states", "max_depth")
    stops = F.format_string("%d mutation stops, %d origin boundaries", "mutation_stops", "origin_boundaries")
    return _placed(coverage, [_texts(rows, 0, ["RECONCILIATION", *map(told, DOMAINS), depth, stops])])


def contract_report(contracts: DataFrame, endpoints: DataFrame, authentication: DataFrame, operations: DataFrame) -> DataFrame:
    """Of contracts (report_id, final_url, title, retrieval, style, n_types, paginated, n_unresolved) and their parts: endpoints
    (report_id, place, region, value), authentication (.., header, scheme, purpose), operations (.., type, name)."""
    region = F.when(F.col("region") != "", F.concat("region", F.lit(" "))).otherwise(F.lit(""))
    scheme = F.when(F.col("scheme") != "", F.concat(F.lit(" ("), "scheme", F.lit(")"))).otherwise(F.lit(""))
    operation = F.concat(F.upper(F.substring("type", 1, 1)), F.expr("substring(type, 2)"), F.lit(": "), "name")
    head = ["PRODUCT CONTRACT", "", "SOURCE", F.col("final_url"), F.col("title"), F.col("retrieval"), "", "API STYLE", F.upper("style")]
    tail = ["", "TYPES", F.col("n_types"), "", "PAGINATION", F.when(F.col("paginated"), "documented").otherwise("none"), "", "UNRESOLVED", F.col("n_unresolved")]
    return _placed(contracts, [
        _texts(contracts, 0, head), *_section(contracts, 1, ["", "ENDPOINTS"], endpoints, F.concat(region, "value"), "none"),
        *_section(contracts, 2, ["", "AUTHENTICATION"], authentication, F.concat("header", scheme, F.lit(": "), "purpose"), "none"),
        *_section(contracts, 3, ["", "OPERATIONS"], operations, operation, "none"), _texts(contracts, 4, tail),
    ])


def _operation() -> list[Column | str]:
    return ["", "OPERATION", F.col("subject"), "", "DOCUMENTED", F.coalesce("documented", "subject"), "", "STATIC", F.coalesce("static", F.lit("not available")), "", "RESULT", F.upper("status")]


def contract_reconciliation_report(reports: DataFrame, results: DataFrame, links: DataFrame, features: DataFrame | None = None, totals: DataFrame | None = None, large: DataFrame | None = None) -> DataFrame:
    """Of the operations' results (report_id, place, result_id, subject, status, documented, static, unproven) with their links
    (report_id, place, result_id, feature_id), features (report_id, feature_id, name), and totals (report_id, status, results).
    documented and static are what either side says, null where it says nothing. A link to an unknown feature shows its id. A
    result_id stands for one result of its report. Without features, links have a name; without totals, results are counted.

    large: the reports (report_id) that no task should hold, where that is known (then without features and totals). Only they
    are laid out line by line; all others move as results and links, and become lines when their places are known."""
    if large is not None:
        if large.isEmpty():
            return _reconciled(reports, results, links)
        few, many = zip(*[split_off(df, large) for df in (reports, results, links)])
        return _reconciled(*few).unionByName(contract_reconciliation_report(*many))
    at = results.select("report_id", "result_id", F.col("place").alias("__at"))
    linked = links.join(at, ["report_id", "result_id"])
    linked = linked if features is None else linked.join(features, ["report_id", "feature_id"], "left")
    totals = results.groupBy("report_id", "status").agg(F.count(F.lit(1)).alias("results")) if totals is None else totals
    unproven = results.filter("unproven")
    counts = F.map_from_entries(F.collect_list(F.struct("status", "results")))  # a row for each of five statuses
    total = reports.join(totals.filter(F.col("status").isin(CONTRACT_STATUSES)).groupBy("report_id").agg(counts.alias("n")), "report_id", "left")
    return _placed(reports, [
        _texts(reports, 0, ["CONTRACT RECONCILIATION"]), _texts(results, 1, _operation(), F.col("place")),
        _texts(linked.select("report_id", "__at").distinct(), 1, _FEATURES, F.col("__at"), 1),
        _at(linked, 1, F.col("__at"), F.coalesce("name", "feature_id"), 2, F.col("place")),
        _texts(unproven, 1, _UNPROVEN, F.col("place"), 3),
        _texts(total, 2, ["", "SUMMARY", *[F.concat(F.lit(f"{s}: "), F.coalesce(F.col("n")[s], F.lit(0)).cast("string")) for s in CONTRACT_STATUSES]]),
    ])


def _reconciled(reports: DataFrame, results: DataFrame, links: DataFrame) -> DataFrame:
    """The lines of reports that each fit in a task: heads, results and links meet by report and are never shuffled as lines.
    The first link of a result brings the heading, the last row of a result what is unproven, that of a report the summary."""
    said = {c: results.schema[c].dataType for c in ("subject", "status", "documented", "static", "unproven")} | {c: links.schema[c].dataType for c in ("feature_id", "name")}

    def rows(df: DataFrame, kind: int) -> DataFrame:
        told = {"report_id", "result_id", "place"} & set(df.columns) if kind else {"report_id"}
        key = [F.col(c) if c in told else F.lit(None).cast(results.schema[c].dataType).alias(c) for c in ("report_id", "result_id", "place")]
        return df.select(*key, F.lit(kind).alias("kind"), *[(F.col(c) if c in df.columns and kind else F.lit(None)).cast(t).alias(c) for c, t in said.items()])

    head, result, link = (F.col("kind") == k for k in range(3))
    both = rows(reports.select("report_id").filter("report_id is not null").distinct(), 0).unionByName(rows(results, 1)).unionByName(rows(links.filter("result_id is not null"), 2))
    of = W.partitionBy("report_id", "result_id", F.when(F.col("result_id").isNull() & result, F.col("place"))).orderBy("kind", "place", "name", "feature_id")
    whole = W.partitionBy("report_id")
    both = both.select(
        "*", F.when(result, F.col("place")).otherwise(F.first(F.when(result, F.col("place")), ignorenulls=True).over(of)).alias("at"), (F.lag("kind").over(of) == 1).alias("opens"),
        (F.lead("kind").over(of).isNull() & F.coalesce(F.first(F.when(result, F.col("unproven")), ignorenulls=True).over(of), F.lit(False))).alias("doubts"),
    ).filter(head | F.col("at").isNotNull())
    line = F.coalesce("name", "feature_id")
    order = whole.orderBy(F.col("at").asc_nulls_first(), "kind", "place", F.coalesce(line, F.lit("")))
    both = both.select("*", F.max(head).over(whole).alias("known"), F.lead("kind").over(order).isNull().alias("ends"), *[F.count_if(result & (F.col("status") == s)).over(whole).alias(s) for s in CONTRACT_STATUSES])
    opens = link & F.coalesce("opens", F.lit(False))
    parts = [
        (head, ["CONTRACT RECONCILIATION"]), (result, _operation()), (opens, _FEATURES), (link, [line]), (F.col("doubts"), _UNPROVEN),
        (F.col("ends"), ["", "SUMMARY", *[F.concat(F.lit(f"{s}: "), F.col(f"`{s}`").cast("string")) for s in CONTRACT_STATUSES]]),
    ]
    size = sum((F.when(there, len(texts)).otherwise(0) for there, texts in parts), F.lit(0))
    both = both.withColumn("last", F.sum(size).over(order.rowsBetween(W.unboundedPreceding, 0))).filter("known")
    lines = F.concat(*[F.when(there, F.array(*[F.coalesce(t.cast("string"), F.lit("")) if isinstance(t, Column) else F.lit(t) for t in texts])).otherwise(F.array().cast("array<string>")) for there, texts in parts])
    out = both.select("report_id", (F.col("last") - size).alias("before"), F.posexplode(lines).alias("n", "line"))
    return out.select("report_id", (F.col("before") + F.col("n") + 1).alias("place"), "line")


def _said(items: DataFrame, kind: str) -> DataFrame:
    return items.filter(F.col("kind") == kind)


def article_report(articles: DataFrame, items: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """Of articles (report_id, title, summary, expected) and their items (report_id, kind, place, text), whose kind is
    prerequisite, step, note, writer-limitation, screenshot or limitation. evidence (report_id, place, section, index, text,
    claim_ids, refs), where given, is listed at the end; steps and evidence are headed even where there is none."""
    bullet, numbered = F.concat(F.lit("- "), "text"), F.concat(F.col("place").cast("string"), F.lit(". "), "text")
    expected = articles.filter("expected <> ''")
    parts = [
        _texts(articles, 0, [F.concat(F.lit("# "), "title"), "", F.col("summary")]),
        *_section(articles, 1, ["", "## Prerequisites", ""], _said(items, "prerequisite"), bullet),
        _texts(articles, 2, ["", "## Steps", ""]), _at(_said(items, "step"), 2, F.col("place"), numbered),
        _texts(expected, 3, ["", "## Expected result", "", F.col("expected")]),
    ]
    headings = [("note", "Notes"), ("writer-limitation", "Limitations"), ("screenshot", "Screenshots"), ("limitation", "Evidence limitations")]
    for section, (kind, heading) in enumerate(headings, 4):
        parts += _section(articles, section, ["", f"## {heading}", ""], _said(items, kind), bullet)
    if evidence is not None:
        head = F.concat(F.upper("section"), F.lit(" "), (F.col("index") + 1).cast("string"), F.lit(": "), "text")
        told = [head, F.concat(F.lit("Claims: "), F.array_join("claim_ids", ", ")), F.concat(F.lit("Evidence: "), F.array_join("refs", ", "))]
        later = evidence.join(evidence.groupBy("report_id").agg(F.min("place").alias("__first")), "report_id").filter("place > __first")
        parts += [_texts(articles, 9, ["", "## Evidence / Review"]), _texts(articles.join(evidence, "report_id", "left_semi"), 9, [""], sub=1)]
        parts += [_texts(later, 9, [""], F.col("place"), -1), _texts(evidence, 9, told, F.col("place"))]
    return _placed(articles, parts)


def visual_article_report(articles: DataFrame, steps: DataFrame, visuals: DataFrame, callouts: DataFrame, limitations: DataFrame) -> DataFrame:
    """Of articles as above with steps (report_id, place, text), their visuals (report_id, step, place, path, callout_ids),
    callouts (report_id, step, callout_id, number, label) and limitations (report_id, place, text). A picture lists those of
    its callouts that its step has, in its own order."""
    wanted = visuals.select("report_id", "step", "place", F.posexplode("callout_ids").alias("nth", "callout_id"))
    held = wanted.join(callouts, ["report_id", "step", "callout_id"])
    numbered = F.concat(F.col("place").cast("string"), F.lit(". "), "text")
    return _placed(articles, [
        _texts(articles, 0, [F.concat(F.lit("# "), "title"), "", F.col("summary"), "", "## Steps", ""]), _at(steps, 1, F.col("place"), numbered),
        _at(visuals, 1, F.col("step"), F.concat(F.lit("   Screenshot: "), "path"), F.col("place")),
        _at(held, 1, F.col("step"), F.concat(F.lit("   Callout: "), F.col("number").cast("string"), F.lit(" - "), "label"), F.col("place"), F.col("nth") + 1),
        _texts(articles.filter("expected <> ''"), 2, ["", "## Expected result", "", F.col("expected")]),
        *_section(articles, 3, ["", "## Limitations", ""], limitations, F.concat(F.lit("- "), "text")),
    ])


def write(report: DataFrame, path: str, parts: int = 200) -> None:
    """The lines as text files in folders by report, sorted by place over ranges of it: the files of a folder, by their names,
    make up its report."""
    ranged = report.repartitionByRange(parts, "report_id", "place").sortWithinPartitions("report_id", "place")
    ranged.select("report_id", F.col("line").alias("value")).write.partitionBy("report_id").mode("error").text(path)
