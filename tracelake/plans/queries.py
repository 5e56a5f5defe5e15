"""The queries of the evidence operators, and SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import routes as R
from tracelake.functions import text as X
from tracelake.functions import urls as U
from tracelake.operators import contracts, documents, graph, matching, routes, sequences
from tracelake.plans.projected import Projected
from tracelake.sources.tables import containment, links, table

PATTERNS = [("r0", "/en/:id"), ("r1", "/de/:docId"), ("r2", "/de/:id"), ("r3", "/fr/*"), ("r4", "/fr/825"), ("r5", "/en/*"), ("r6", "/admin"), ("r7", None)]
DECLARED = ["click", "click", "view", "purchase", "refund", None]
PREFIXES = ["STANDARD", "STANDARD ANODIZED", "PROMO", "PROMO BURNISHED", "ECONOMY", "SMALL", "LARGE BRUSHED"]
#: Arguments of operations on two sides, as projections of customers and parts.
ARGUMENTS = Projected({
    "contract": ("operation string, argument string, type string, required boolean, default_value string", "SELECT 'op' || c_custkey, 'k' || (c_nationkey % 4), CASE WHEN c_acctbal > 5000 THEN 'Int' ELSE 'Int!' END, c_acctbal > 2000, CASE WHEN c_nationkey > 8 THEN '' || (c_nationkey % 3) END FROM {customer}"),
    "product": ("operation string, argument string, type string, required boolean, default_value string", "SELECT 'op' || p_partkey, 'k' || (p_size % 4), CASE WHEN p_size > 25 THEN 'Int' ELSE 'Int!' END, p_size > 10, CASE WHEN p_size > 15 THEN '' || (p_size % 3) END FROM {part}"),
})


def _states(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(F.col("page_id").alias("state_id"), "url")


def _routes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PATTERNS, "route_id string, pattern string")


def route_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    return routes.reconcile_routes(_states(spark, d), _routes(spark))


_VALUES = ", ".join(f"('{i}', {'NULL' if p is None else repr(p)})" for i, p in PATTERNS)
_RECONCILED = rf"""
WITH r(route_id, pattern) AS (VALUES {_VALUES}),
s AS (SELECT page_id::VARCHAR AS state_id, url, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '(.)/+$', '\1') AS p FROM pages),
paths AS (SELECT state_id, url, CASE WHEN p = '' THEN '/' ELSE p END AS path FROM s),
fit AS (
  SELECT state_id, path, route_id, pattern = path AS exact,
    CASE WHEN pattern LIKE '%*' THEN [2] || list_transform(range(len(string_split(path, '/')) - 2), lambda x: 0)
         WHEN pattern LIKE '%:%' THEN [2, 1] ELSE list_transform(string_split(path, '/')[2:], lambda x: 2) END AS ranks
  FROM paths, r
  WHERE CASE WHEN pattern LIKE '%*' THEN path = replace(pattern, '/*', '') OR starts_with(path, replace(pattern, '*', ''))
             WHEN pattern LIKE '%:%' THEN regexp_full_match(path, '/' || string_split(pattern, '/')[2] || '/[^/]+') ELSE path = pattern END),
best AS (
  SELECT * FROM fit a WHERE NOT EXISTS (
    SELECT 1 FROM fit b WHERE b.state_id = a.state_id AND b.route_id <> a.route_id AND CASE WHEN a.exact <> b.exact THEN b.exact ELSE
      list_bool_and(list_transform(range(1, greatest(len(a.ranks), len(b.ranks)) + 1), lambda i: coalesce(b.ranks[i], 0) >= coalesce(a.ranks[i], 0)))
      AND list_bool_or(list_transform(range(1, greatest(len(a.ranks), len(b.ranks)) + 1), lambda i: coalesce(b.ranks[i], 0) > coalesce(a.ranks[i], 0))) END)),
w AS (SELECT state_id, count(*) AS n, string_agg(route_id, '|' ORDER BY route_id) AS route_ids, bool_or(exact) AS exact FROM best GROUP BY state_id),
results AS (
  SELECT CASE WHEN n IS NULL THEN 'runtime-only' WHEN n = 1 THEN 'corroborated' ELSE 'ambiguous' END AS status, state_id, path,
    coalesce(route_ids, '') AS route_ids, CASE WHEN n IS NULL THEN 'no-static-route-match' WHEN n > 1 THEN 'multiple-equally-specific-routes' WHEN exact THEN 'route-path-exact' ELSE 'route-parameter-match' END AS reason
  FROM paths LEFT JOIN w USING (state_id)
  UNION ALL SELECT 'static-only', NULL, NULL, route_id, 'no-runtime-state-for-route' FROM r WHERE pattern IS NOT NULL AND route_id NOT IN (SELECT route_id FROM fit)
  UNION ALL SELECT 'ambiguous', NULL, NULL, route_id, 'dynamic-static-evidence' FROM r WHERE pattern IS NULL)
"""
STATUSES = ["corroborated", "static-only", "runtime-only", "ambiguous", "conflict"]


def route_status_summary(spark: SparkSession, d: str) -> DataFrame:
    return matching.status_summary(route_reconciliation(spark, d), STATUSES)


def route_static_only(spark: SparkSession, d: str) -> DataFrame:
    return route_reconciliation(spark, d).filter("status = 'static-only'").select("route_ids", "reason")


def url_application_path(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", U.application_path(url).alias("path"), U.origin(url).alias("origin"), U.request_path(url).alias("request"), U.sanitized_url(F.concat(url, F.lit("&token=abc&x=1"))).alias("sanitized"))


def route_value_classes(spark: SparkSession, d: str) -> DataFrame:
    values = table(spark, d, "pages").select(F.explode(R.segments(U.application_path(F.col("url")))).alias("value"))
    return values.groupBy("value").agg(F.count(F.lit(1)).alias("n")).select("value", "n", R.value_class(F.col("value")).alias("class"), R.title_of(F.col("value")).alias("title"))


def route_identity_groups(spark: SparkSession, d: str) -> DataFrame:
    key = F.transform(R.segments(U.application_path(F.col("url"))), lambda v: F.when(R.value_class(v) == "stable-slug", v).otherwise(F.lit(":opaque")))
    rows = table(spark, d, "pages").select("page_id", F.concat(F.lit("/"), F.array_join(key, "/")).alias("identity"))
    return rows.groupBy("identity").agg(F.count(F.lit(1)).alias("states"), F.min("page_id").alias("first_state"))


def http_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    declared = spark.createDataFrame([(x,) for x in DECLARED], "key string")
    return matching.reconcile(declared, table(spark, d, "events").select(F.col("event_type").alias("key")), "key")


def network_occurrence_ids(spark: SparkSession, d: str) -> DataFrame:
    return sequences.occurrence_ids(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "occurrence", "occurrence_id")


def transition_edges(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").withColumn("walk", F.col("page_id") % 50)
    return sequences.transitions(rows, "walk", ["page_id"], "url").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def readiness_islands(spark: SparkSession, d: str) -> DataFrame:
    runs = sequences.stable_runs(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")
    return runs.groupBy("user_id", "run").agg(F.max("stable_polls").alias("polls"), F.min("event_id").alias("first_event")).filter("polls >= 2")


def nav_links(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select("page_id", F.explode(links(F.col("html"))).alias("x"))
    return rows.select("page_id", "x.href", F.col("x.label"))


def nav_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct menu target against the pages whose path has it as its language: one, none or several."""
    targets = nav_links(spark, d).select(F.lower("href").alias("path")).distinct()
    pages = table(spark, d, "pages").select(F.concat(F.lit("/"), R.segments(U.application_path(F.col("url")))[0]).alias("path"), "page_id")
    rows = matching.unique_left_join(targets, pages, ["path"], "page_id", "target")
    reason = F.when(F.col("n_target") == 1, "resolved").when(F.col("n_target") == 0, "no-route").otherwise("several-routes")
    return rows.select("path", "target", "n_target", reason.alias("reason"))


def page_titles(spark: SparkSession, d: str) -> DataFrame:
    html = F.col("html")
    return table(spark, d, "pages").select("page_id", X.plain_html(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), X.plain_html(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)).alias("heading"))


_BUTTON = "concat(case p_size % 6 when 0 then 'Delete ' when 1 then 'Cancel  subscription: ' when 2 then 'Undelete ' when 3 then 'BUY-' when 4 then 'Pay and remove ' else 'Show ' end, p_name)"


def probe_safety(spark: SparkSession, d: str) -> DataFrame:
    """Buttons that name parts, by the first changing action that they name."""
    rows = table(spark, d, "part").select(X.mutation_term(F.expr(_BUTTON)).alias("term"))
    return rows.groupBy(F.coalesce("term", F.lit("none")).alias("term")).agg(F.count(F.lit(1)).alias("n"))


def graph_summary(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = containment(spark, d)
    return nodes.select(F.lit("node").alias("part"), "type").unionByName(edges.select(F.lit("edge").alias("part"), "type")).groupBy("part", "type").agg(F.count(F.lit(1)).alias("n"))


def trace_from_region(spark: SparkSession, d: str) -> DataFrame:
    """What each region leads to, level by level: its nations, their customers, their orders."""
    _, edges = containment(spark, d)
    roots = table(spark, d, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("node"))
    found = graph.trace(graph.cut(edges.select("src", "dst"), "edges"), roots)
    return found.groupBy("root", "depth").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first_node"))


def feature_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Nations as features: what each holds, through its customers."""
    nations, customers, orders = (table(spark, d, t) for t in ("nation", "customer", "orders"))
    held = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("items"))
    rows = customers.join(held, "c_custkey", "left").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("elements"), F.sum(F.coalesce("items", F.lit(0))).alias("items"))
    return nations.join(rows, "n_nationkey", "left").select("n_name", F.coalesce("elements", F.lit(0)).alias("elements"), F.coalesce("items", F.lit(0)).alias("items"))


def unassigned_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Orders that no line item belongs to."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(lines, "o_orderkey", "left_anti").select("o_orderkey")


def contract_argument_diff(spark: SparkSession, d: str) -> DataFrame:
    return contracts.argument_diff(ARGUMENTS.frame(spark, d, "contract"), ARGUMENTS.frame(spark, d, "product"))


def contract_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("domain"), F.col("o_orderstatus").alias("status"))
    return contracts.domain_summary(rows)


def operation_variants_conflict(spark: SparkSession, d: str) -> DataFrame:
    return contracts.operation_variants(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_discount", "l_tax"])


def tenant_warnings(spark: SparkSession, d: str) -> DataFrame:
    return documents.tenant_warnings(table(spark, d, "documents"), "doc_id", "text")


def secret_redaction(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.col("text"), X.redacted(F.col("text")).alias("clean"))
    return rows.filter("text <> clean").select("doc_id", F.sha2("clean", 256).alias("clean_sha256"))


def markdown_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Turns as parts of an article: a heading, their text, and a list of their role and place."""
    told = F.concat(F.lit("## "), "role", F.lit("\n"), "text", F.lit("\n- turn "), F.col("turn").cast("string"), F.lit("\n2) of "), F.col("conv_id").cast("string"), F.lit("\n\nlast"))
    rows = table(spark, d, "conversations").select(documents.blocks(told).alias("b")).select(F.explode("b").alias("x"))
    return rows.groupBy("x.kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("x.text")).alias("chars"))


def statement_support(spark: SparkSession, d: str) -> DataFrame:
    """Documents' lines that say what a benchmark item says, whatever tenant values differ; the first item of each
    tenth document is written into it, with an address of its own."""
    claims = table(spark, d, "benchmark").select("item_id", X.supported_form(F.concat("text", F.lit(" TO [some name]!"))).alias("form"))
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    planted = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 40).alias("item_id")).join(table(spark, d, "benchmark").select("item_id", "text"), "item_id")
    planted = planted.select("doc_id", F.concat(F.lit("  "), "text", F.lit("  to a"), F.col("doc_id").cast("string"), F.lit("@mail.test.")).alias("line"))
    lines = lines.unionByName(planted).select("doc_id", X.supported_form(F.col("line")).alias("form")).filter("form <> ''")
    return lines.join(claims, "form").groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"))


def grounding_issues(spark: SparkSession, d: str) -> DataFrame:
    """Labels of unknown documents (their identifiers are spread), and documents that no label uses."""
    labels, known = table(spark, d, "labels").select((F.col("doc_id") * 3).alias("doc_id")), table(spark, d, "documents")
    found = matching.missing_references(labels, "doc_id", known, "doc_id", "unknown-claim").unionByName(matching.missing_references(known, "doc_id", labels, "doc_id", "unused-claim"))
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("issues"), F.count_distinct("subject").alias("subjects"))


def callout_numbering(spark: SparkSession, d: str) -> DataFrame:
    return matching.numbered(table(spark, d, "conversations"), ["conv_id"], ["role", "turn"], "number").select("conv_id", "turn", "role", "number")


def latest_revision(spark: SparkSession, d: str) -> DataFrame:
    best = matching.first_match(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), ["o_custkey"], [-F.unix_micros(F.col("o_orderdate").cast("timestamp")), -F.col("o_orderkey")])
    return best.select("o_custkey", "o_orderkey", "o_orderstatus")


def dedupe_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return sequences.conflicting_repeats(table(spark, d, "events"), ["user_id", "event_type"], ["props"])


def name_priority(spark: SparkSession, d: str) -> DataFrame:
    best = matching.first_match(table(spark, d, "part").select("p_brand", "p_size", "p_name", "p_partkey"), ["p_brand"], [-F.col("p_size"), F.col("p_partkey")])
    return best.select("p_brand", "p_partkey", "p_name")


def longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    rows = matching.longest_prefix(table(spark, d, "part"), "p_type", PREFIXES, "prefix")
    return rows.groupBy(F.coalesce("prefix", F.lit("none")).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


_NAV = r"""SELECT page_id, regexp_extract(a, '<a href="([^"]*)"', 1) AS href, regexp_extract(a, '<a href="[^"]*"[^>]*>(.*?)</a>', 1, 's') AS label
  FROM (SELECT page_id, unnest(regexp_extract_all(m, '<a href="[^"]*"[^>]*>.*?</a>', 0, 's')) AS a FROM (SELECT page_id, unnest(regexp_extract_all(html, '<nav[^>]*>(.*?)</nav>', 1, 's')) AS m FROM pages))"""
_PATHS = r"SELECT page_id, url, CASE WHEN p = '' THEN '/' ELSE p END AS path FROM (SELECT page_id, url, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '(.)/+$', '\1') AS p FROM pages)"
_CLASS = r"""CASE WHEN regexp_matches(value, '(?i)redact|masked|hidden|^\*+$') OR regexp_matches(value, '^\[[^\]]+\]$') THEN 'redacted'
  WHEN regexp_matches(value, '^[0-9]+$') OR regexp_matches(value, '(?i)^[0-9a-f]{16,}$') OR (length(value) >= 20 AND regexp_matches(value, '[A-Za-z]') AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '^[A-Za-z0-9_-]+$')) THEN 'opaque-identifier'
  WHEN regexp_matches(value, '^[A-Za-z][A-Za-z0-9]*([-_][A-Za-z0-9]+)*$') AND length(value) <= 64 THEN 'stable-slug' ELSE 'opaque-identifier' END"""
_PLAIN = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace({0}, '(?i)<br[ \t\r\n]*/?>', chr(10), 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '[ \t\r\n\f\v]+', ' ', 'g'))"""
_FORM = r"""regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '\[[a-z][a-z0-9 -]{{2,80}}\]', '[tenant-value]', 'g'), '[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{{2,}}', '[tenant-value]', 'g'), 'https?://[^ \t\r\n)]+', '[tenant-value]', 'g'), '[ \t\r\n\f\v]+', ' ', 'g')), '[.!?]+$', '')"""
_TERMS = ", ".join(f"('{t}', {i})" for i, t in enumerate(X.MUTATIONS))

SQL = {
    "route_reconciliation": _RECONCILED + "SELECT * FROM results",
    "route_status_summary": _RECONCILED + f"SELECT s.status, count(results.status) AS results FROM (VALUES {', '.join(f'({x!r})' for x in STATUSES)}) s(status) LEFT JOIN results USING (status) GROUP BY s.status",
    "route_static_only": _RECONCILED + "SELECT route_ids, reason FROM results WHERE status = 'static-only'",
    "url_application_path": rf"""SELECT page_id, path, lower(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)) AS origin,
      CASE WHEN starts_with(q, '/') THEN q ELSE '/' || q END AS request,
      CASE WHEN contains(url, '#') OR NOT contains(url, '?') THEN url || '&token=abc&x=1' ELSE url || '&token=%5BREDACTED%5D&x=1' END AS sanitized
      FROM (SELECT *, regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) AS q FROM ({_PATHS}))""",
    "route_value_classes": f"SELECT value, count(*) AS n, {_CLASS} AS class, (SELECT string_agg(CASE WHEN i = 1 OR NOT regexp_matches(v[i - 1], '[A-Za-z0-9_]') THEN upper(v[i]) ELSE v[i] END, '' ORDER BY i) FROM (SELECT regexp_replace(value, '[-_]+', ' ', 'g') AS v, unnest(range(1, length(regexp_replace(value, '[-_]+', ' ', 'g')) + 1)) AS i)) AS title FROM (SELECT unnest(string_split(path[2:], '/')) AS value FROM ({_PATHS}) WHERE path <> '/') GROUP BY value",
    "route_identity_groups": f"SELECT identity, count(*) AS states, min(page_id) AS first_state FROM (SELECT page_id, '/' || coalesce(string_agg(CASE WHEN {_CLASS} = 'stable-slug' THEN value ELSE ':opaque' END, '/' ORDER BY i), '') AS identity FROM (SELECT page_id, unnest(string_split(path[2:], '/')) AS value, generate_subscripts(string_split(path[2:], '/'), 1) AS i FROM ({_PATHS})) GROUP BY page_id) GROUP BY identity",
    "http_reconciliation": f"""WITH s AS (SELECT key, count(*) AS n_static FROM (VALUES {", ".join("(NULL)" if x is None else f"('{x}')" for x in DECLARED)}) v(key) GROUP BY key),
      r AS (SELECT event_type AS key, count(*) AS n_runtime FROM events GROUP BY key),
      b AS (SELECT coalesce(s.key, r.key) AS key, coalesce(n_static, 0) AS n_static, coalesce(n_runtime, 0) AS n_runtime FROM s FULL JOIN r ON s.key = r.key)
      SELECT *, CASE WHEN key IS NULL THEN 'ambiguous' WHEN n_static = 0 THEN 'runtime-only' WHEN n_runtime = 0 THEN 'static-only' WHEN n_static > 1 THEN 'ambiguous' ELSE 'corroborated' END AS status,
        CASE WHEN key IS NULL OR n_runtime = 0 THEN n_static WHEN n_static = 1 THEN 1 ELSE n_runtime END AS results FROM b""",
    "network_occurrence_ids": "SELECT event_id, n AS occurrence, substr(sha256(user_id || '|' || event_type || '|' || n), 1, 16) AS occurrence_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events)",
    "transition_edges": r"""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_extract(a, '^[a-z]+://[^/?#]*') <> regexp_extract(b, '^[a-z]+://[^/?#]*') THEN 'cross-origin-attempt' WHEN a = b THEN 'same-url'
      WHEN regexp_extract(a, '^[^#]*') = regexp_extract(b, '^[^#]*') THEN 'hash-change' ELSE 'same-origin-url-change' END AS kind
      FROM (SELECT lag(url) OVER (PARTITION BY page_id % 50 ORDER BY page_id) AS a, url AS b FROM pages) WHERE a IS NOT NULL) GROUP BY kind""",
    "readiness_islands": """SELECT user_id, run::BIGINT AS run, count(*) AS polls, min(event_id) AS first_event FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run
      FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS c FROM events)) GROUP BY user_id, run HAVING count(*) >= 2""",
    "nav_links": _NAV,
    "nav_resolution": f"""WITH t AS (SELECT DISTINCT lower(href) AS path FROM ({_NAV})), p AS (SELECT '/' || string_split(path, '/')[2] AS path, count(*) AS n, min(page_id) AS one FROM ({_PATHS}) GROUP BY 1)
      SELECT t.path, CASE WHEN n = 1 THEN one END AS target, coalesce(n, 0) AS n_target, CASE WHEN n = 1 THEN 'resolved' WHEN n IS NULL THEN 'no-route' ELSE 'several-routes' END AS reason FROM t LEFT JOIN p USING (path)""",
    "page_titles": "SELECT page_id, " + _PLAIN.format("regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 's')") + " AS title, " + _PLAIN.format("regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 's')") + " AS heading FROM pages",
    "probe_safety": f"""SELECT coalesce(term, 'none') AS term, count(*) AS n FROM (SELECT (SELECT t FROM (VALUES {_TERMS}) v(t, i) WHERE contains(' ' || trim(regexp_replace(lower({_BUTTON}), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || t || ' ') ORDER BY i LIMIT 1) AS term FROM part) GROUP BY 1""",
    "graph_summary": """SELECT 'node' AS part, 'region' AS type, count(*) AS n FROM region UNION ALL SELECT 'node', 'nation', count(*) FROM nation UNION ALL SELECT 'node', 'customer', count(*) FROM customer UNION ALL SELECT 'node', 'orders', count(*) FROM orders
      UNION ALL SELECT 'edge', 'CONTAINS', (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders)""",
    "trace_from_region": """WITH RECURSIVE e AS (SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst FROM nation UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer UNION ALL SELECT 'customer:' || o_custkey, 'orders:' || o_orderkey FROM orders),
      t AS (SELECT 'region:' || r_regionkey AS root, 'region:' || r_regionkey AS node, 0 AS depth FROM region UNION ALL SELECT root, dst, depth + 1 FROM t JOIN e ON node = src)
      SELECT root, depth, count(*) AS n, min(node) AS first_node FROM t GROUP BY root, depth""",
    "feature_rollup": "SELECT n_name, count(DISTINCT c_custkey) AS elements, count(o_orderkey) AS items FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name",
    "unassigned_evidence": "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "contract_argument_diff": ARGUMENTS.with_sql("contract", "product") + """, b AS (SELECT coalesce(c.operation, p.operation) AS operation, coalesce(c.argument, p.argument) AS argument, c.operation IS NOT NULL AND p.operation IS NOT NULL AS there, c.type = p.type AS t, c.required = p.required AS r, c.default_value = p.default_value AS d
      FROM contract c FULL JOIN product p ON c.operation = p.operation AND c.argument = p.argument)
      SELECT operation, argument, 'presence' AS dimension, CASE WHEN there THEN 'match' ELSE 'conflict' END AS status FROM b
      UNION ALL SELECT operation, argument, 'type', CASE WHEN t THEN 'match' ELSE 'conflict' END FROM b WHERE there
      UNION ALL SELECT operation, argument, 'required', CASE WHEN r THEN 'match' ELSE 'conflict' END FROM b WHERE there
      UNION ALL SELECT operation, argument, 'default', CASE WHEN d THEN 'match' ELSE 'conflict' END FROM b WHERE there AND d IS NOT NULL""",
    "contract_summary": "SELECT coalesce(o_orderpriority, 'all') AS domain, o_orderstatus AS status, count(*) AS results FROM orders GROUP BY GROUPING SETS ((o_orderpriority, o_orderstatus), (o_orderstatus))",
    "operation_variants_conflict": "SELECT l_returnflag, l_linestatus, count(*) AS n_rows, count(DISTINCT (l_discount, l_tax)) AS n_variants, count(DISTINCT (l_discount, l_tax)) > 1 AS conflict FROM lineitem GROUP BY ALL",
    "tenant_warnings": r"""WITH v AS (SELECT doc_id, 'email-address' AS kind, unnest(regexp_extract_all(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b')) AS value FROM documents
      UNION ALL SELECT doc_id, 'customer-identifier', trim(unnest(regexp_extract_all(text, '(?i)\b(?:customer|client|tenant)[ \t]+(?:id|name)[ \t]*[:=-][ \t]*([^,.;\n]+)', 1))) FROM documents)
      SELECT *, CASE WHEN contains(value, '@') THEN value[1] || '***@***.' || string_split(string_split(value, '@')[2], '.')[-1] WHEN contains(value, '.') THEN '***.' || string_split(value, '.')[-1] ELSE value[1] || '***' END AS masked_value,
        'tenant-warning-' || substr(sha256(kind || '|' || lower(value) || '|' || doc_id), 1, 16) AS warning_id FROM v""",
    "secret_redaction": r"""SELECT doc_id, sha256(clean) AS clean_sha256 FROM (SELECT doc_id, text, regexp_replace(regexp_replace(text, '(?i)(Authorization[ \t\r\n]*[:=][ \t\r\n]*Bearer[ \t\r\n]+)[^ \t\r\n,"''}]+', '\1[REDACTED]', 'g'),
      '(?i)(["'']?(?:token|api[_-]?key|password|secret)["'']?[ \t\r\n]*[:=][ \t\r\n]*["''])[^"'']+(["''])', '\1[REDACTED]\2', 'g') AS clean FROM documents) WHERE text <> clean""",
    "markdown_blocks": r"""WITH l AS (SELECT conv_id, turn, i, CASE WHEN v = '' THEN 'blank' WHEN regexp_matches(v, '^#{1,6}[ \t]+.+$') THEN 'heading' WHEN regexp_matches(v, '^([-*+] |[0-9]+[.)] ).+$') THEN 'list-item' ELSE 'paragraph' END AS kind, v
        FROM (SELECT conv_id, turn, i, regexp_replace(x, '^[ \t\r\f\v]+|[ \t\r\f\v]+$', '', 'g') AS v FROM (SELECT conv_id, turn, unnest(string_split_regex(t, '\r?\n')) AS x, generate_subscripts(string_split_regex(t, '\r?\n'), 1) AS i FROM (SELECT conv_id, turn, '## ' || role || chr(10) || text || chr(10) || '- turn ' || turn || chr(10) || '2) of ' || conv_id || chr(10) || chr(10) || 'last' AS t FROM conversations WHERE text IS NOT NULL)))),
      g AS (SELECT *, sum(CASE WHEN kind = 'paragraph' AND k = 'paragraph' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS b FROM (SELECT *, lag(kind) OVER (PARTITION BY conv_id, turn ORDER BY i) AS k FROM l)),
      t AS (SELECT min(kind) AS kind, CASE min(kind) WHEN 'heading' THEN trim(regexp_extract(min(v), '^#{1,6}[ \t]+(.+)$', 1)) WHEN 'list-item' THEN trim(regexp_extract(min(v), '^(?:[-*+] |[0-9]+[.)] )(.+)$', 1)) ELSE string_agg(v, ' ' ORDER BY i) END AS x FROM g WHERE kind <> 'blank' GROUP BY conv_id, turn, b)
      SELECT kind, count(*) AS n, sum(length(x))::BIGINT AS chars FROM t GROUP BY kind""",
    "statement_support": f"""SELECT item_id, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, {_FORM.format("line")} AS form FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents UNION ALL SELECT doc_id, '  ' || b.text || '  to a' || doc_id || '@mail.test.' FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40))
      JOIN (SELECT item_id, {_FORM.format("text || ' TO [some name]!'")} AS form FROM benchmark) USING (form) WHERE form <> '' GROUP BY item_id""",
    "grounding_issues": """WITH l AS (SELECT doc_id * 3 AS doc_id FROM labels) SELECT 'unknown-claim' AS rule, count(*) AS issues, count(DISTINCT doc_id) AS subjects FROM l WHERE doc_id NOT IN (SELECT doc_id FROM documents) HAVING count(*) > 0
      UNION ALL SELECT 'unused-claim', count(*), count(DISTINCT doc_id) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM l) HAVING count(*) > 0""",
    "callout_numbering": "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY role, turn) AS number FROM conversations",
    "latest_revision": "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "dedupe_conflicts": "SELECT user_id, event_type, count(*) AS n, count(DISTINCT props) AS n_values, CASE WHEN count(DISTINCT props) > 1 THEN 'conflict' ELSE 'duplicate' END AS status FROM events GROUP BY user_id, event_type HAVING count(*) > 1",
    "name_priority": "SELECT p_brand, p_partkey, p_name FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) = 1",
    "longest_prefix": f"""SELECT coalesce((SELECT p FROM (VALUES {", ".join(f"('{p}')" for p in PREFIXES)}) v(p) WHERE starts_with(p_type, p) ORDER BY length(p) DESC LIMIT 1), 'none') AS prefix, count(*) AS n FROM part GROUP BY 1""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in SQL}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
