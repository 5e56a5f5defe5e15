"""Queries of reconciliation, contracts, documentation, graph and knowledge over projections of the given tables, each with the
SQL that it is held against. Small tables that reach every branch stand in for the projections in the tests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import names as N
from tracelake.functions import routes as R
from tracelake.operators import apidocs, contracts, evidence, graph, knowledge, ordering
from tracelake.plans.projected import Projected

T = Projected({
    "requests": ("node_id string, method string, url string", "SELECT 'q' || c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL WHEN c_acctbal < 2000 THEN 'get' WHEN c_acctbal < 6000 THEN 'POST' ELSE 'Delete' END, CASE WHEN c_mktsegment = 'HOUSEHOLD' AND c_acctbal < 1000 THEN '' ELSE '/api/' || CAST(floor(c_custkey / 2) AS BIGINT) END FROM {customer}"),
    "network": ("ref string, method string, url string, resource_type string", "SELECT 'n' || event_id, CASE event_type WHEN 'click' THEN 'GET' WHEN 'view' THEN 'get' WHEN 'purchase' THEN 'POST' ELSE 'delete' END, 'https://app.test/api/' || user_id, CASE WHEN value > 60 THEN 'script' WHEN value > 40 THEN 'ping' ELSE 'fetch' END FROM {events}"),
    "executions": ("node_id string, endpoint string", "SELECT 'g' || s_suppkey, CASE WHEN s_acctbal < 0 THEN NULL WHEN s_acctbal < 3000 THEN '/api/' || s_nationkey WHEN s_acctbal < 6000 THEN 'https://app.test/api/' || s_suppkey ELSE '/other/' || s_suppkey END FROM {supplier}"),
    "navigations": ("node_id string, destination string, label string", "SELECT 'v' || c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE '/o/' || c_custkey END, CASE c_nationkey % 3 WHEN 0 THEN 'Go  F' WHEN 1 THEN 'go O ' ELSE NULL END FROM {customer}"),
    "transitions": ("ref string, path string, label string, kind string", "SELECT 't' || o_orderkey, '/o/' || CAST(floor(o_orderkey * 2 / 3) AS BIGINT), CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE 'Go ' || o_orderstatus END, CASE WHEN o_totalprice > 250000 THEN 'same-url' ELSE 'url-change' END FROM {orders}"),
    "static_ui": ("node_id string, s_tag string, s_text string, s_aria string, s_label string, s_title string, s_hint string, s_type string, s_event boolean", "SELECT 'u' || p_partkey, CASE p_size % 5 WHEN 0 THEN 'Button' WHEN 1 THEN 'a' WHEN 2 THEN 'input' WHEN 3 THEN 'h2' ELSE 'div' END, CASE WHEN p_size % 5 IN (0, 1, 3) THEN p_name END, CASE WHEN p_size % 7 = 0 THEN p_name END, CASE WHEN p_size % 11 = 0 THEN upper(p_name) END, CASE WHEN p_size % 13 = 0 THEN p_name ELSE '' END, CASE WHEN p_size % 5 = 2 THEN p_brand END, CASE WHEN p_size % 5 = 2 THEN 'text' END, p_size % 2 = 0 FROM {part}"),
    "runtime_ui": ("ref string, state_id string, r_tag string, r_role string, r_name string, r_text string, r_hint string, r_type string, r_strong boolean", "SELECT 'e' || p_partkey, 's' || CAST(floor(p_partkey / 50) AS BIGINT), CASE p_size % 5 WHEN 0 THEN 'button' WHEN 1 THEN 'div' WHEN 2 THEN 'input' WHEN 3 THEN 'span' ELSE 'div' END, CASE p_size % 5 WHEN 0 THEN 'button' WHEN 1 THEN 'link' WHEN 2 THEN 'textbox' WHEN 3 THEN 'heading' ELSE 'generic' END, p_name, CASE WHEN p_size % 3 = 0 THEN '' ELSE upper(p_name) END, CASE WHEN p_size % 2 = 0 THEN p_brand END, CASE WHEN p_size % 10 = 2 THEN 'email' WHEN p_size % 5 = 2 THEN 'TEXT' END, p_size % 4 = 0 FROM {part}"),
    "contexts": ("state_id string, route_id string, ambiguous boolean", "SELECT 's' || k, CASE WHEN k % 4 = 3 THEN NULL ELSE 'r' || CAST(floor(k / 2) AS BIGINT) END, k % 4 = 3 FROM (SELECT DISTINCT CAST(floor(p_partkey / 60) AS BIGINT) AS k FROM {part}) x"),
    "scopes": ("route_id string, node_id string", "SELECT 'r' || CAST(floor(p_partkey / 100) AS BIGINT), 'u' || p_partkey FROM {part} WHERE p_size <= 40"),
    "documented": ("operation_id string, name string, type string, n_variants int, return_type string", "SELECT 'o' || c_custkey, 'op' || c_custkey, CASE c_nationkey % 5 WHEN 0 THEN 'mutation' WHEN 1 THEN 'unknown' ELSE 'query' END, CASE WHEN c_nationkey % 7 = 0 THEN 2 ELSE 1 END, CASE c_nationkey % 3 WHEN 0 THEN 'Order' WHEN 1 THEN '[ Item ]' ELSE NULL END FROM {customer}"),
    "product": ("node_id string, name string, type string, return_type string, has_variables boolean", "SELECT 'p' || p_partkey, 'op' || CAST(floor(p_partkey * 9 / 10) AS BIGINT), CASE WHEN p_size % 4 = 0 THEN 'mutation' ELSE 'query' END, CASE p_size % 3 WHEN 0 THEN 'Order' WHEN 1 THEN '[Item]' ELSE '' END, p_size % 5 <> 0 FROM {part}"),
    "arguments": ("operation_id string, key string, type string, required boolean, default_value string", "SELECT 'o' || c_custkey, 'input', 'New Order!', true, CAST(NULL AS STRING) FROM {customer} UNION ALL SELECT 'o' || c_custkey, 'k' || (c_nationkey % 4), 'Int', c_acctbal > 3000, CASE WHEN c_acctbal > 2000 THEN '1' END FROM {customer}"),
    "variables": ("node_id string, key string, type string, required boolean, default_value string", "SELECT 'p' || p_partkey, 'input', CASE WHEN p_size > 30 THEN 'NewOrder' ELSE 'NewOrder!' END, CASE WHEN p_size % 6 = 0 THEN NULL ELSE true END, CAST(NULL AS STRING) FROM {part} UNION ALL SELECT 'p' || p_partkey, 'k' || (p_size % 4), 'Int', p_size > 20, CASE WHEN p_size > 25 THEN '1' ELSE '2' END FROM {part}"),
    "doc_endpoints": ("endpoint_id string, value string", "SELECT 'x' || s_suppkey, 'https://' || CASE WHEN s_nationkey < 12 THEN 'app.test' ELSE 'eu.test' END || '/v/' || s_suppkey || CASE WHEN s_acctbal > 5000 THEN '/' ELSE '' END FROM {supplier}"),
    "code_endpoints": ("node_id string, value string", "SELECT 'c' || p_partkey, CASE p_size % 3 WHEN 0 THEN '/v/' WHEN 1 THEN 'https://app.test/v/' ELSE 'https://eu.test/v/' END || p_partkey FROM {part}"),
    "seen_endpoints": ("ref string, value string", "SELECT 'w' || event_id, 'https://app.test/v/' || user_id || CASE WHEN value > 50 THEN '?x=1' ELSE '' END FROM {events}"),
    "origins": ("origin string", "SELECT DISTINCT CASE WHEN r_regionkey < 3 THEN 'https://app.test' ELSE 'https://other.test' END FROM {region}"),
    "doc_types": ("name string", "SELECT 'T' || s_suppkey FROM {supplier}"),
    "code_types": ("node_id string, name string", "SELECT 'k' || p_partkey, 'T' || CAST(floor(p_partkey * 9 / 10) AS BIGINT) FROM {part}"),
    "doc_fields": ("name string, field string, type string", "SELECT 'T' || s_suppkey, 'id', 'ID !' FROM {supplier} UNION ALL SELECT 'T' || s_suppkey, 'f' || (s_nationkey % 3), CASE WHEN s_acctbal > 4000 THEN 'Int' ELSE 'Float' END FROM {supplier}"),
    "code_fields": ("node_id string, field string, type string", "SELECT 'k' || p_partkey, 'id', CASE WHEN p_size > 40 THEN 'ID' ELSE 'ID!' END FROM {part} UNION ALL SELECT 'k' || p_partkey, 'f' || (p_size % 3), 'Int' FROM {part}"),
    "features": ("feature_id string, node_id string", "SELECT 'f' || p_size, 'p' || p_partkey FROM {part}"),
    "executes": ("execution_id string, node_id string", "SELECT 'g' || s_suppkey, 'p' || s_suppkey FROM {supplier}"),
    "transports": ("execution_id string, ref string", "SELECT 'g' || user_id, 'n' || event_id FROM {events}"),
    "docs": ("doc_id long, content string", """SELECT o_orderkey, CASE o_orderkey % 5
  WHEN 0 THEN 'Query:' || chr(10) || '  op' || o_orderkey || '(page: Int = ' || o_custkey || ', filter: F' || o_orderkey || '!): [Order!] - Lists  orders' || chr(10) || 'get /v1/orders/' || o_orderkey || ' and more'
  WHEN 1 THEN 'Mutation' || chr(10) || 'add(input: New!): Order' || chr(10) || 'Type T' || o_custkey || ' - A thing' || chr(10) || 'id: ID!' || chr(10) || 'total: ' || CASE o_orderstatus WHEN 'F' THEN 'Float' ELSE 'Int' END || chr(10) || chr(10) || 'stray: Text'
  WHEN 2 THEN '<section id="query-i' || o_orderkey || '"><h2 class="operation-heading">item &amp; more ' || o_orderkey || '</h2><div class="operation-response"><code>Item!</code></div><div class="operation-arguments"><table><tbody><tr><td class="property-name"><code>id</code></td><td class="property-type">Key <code>ID!</code></td></tr><tr><td>none</td></tr></tbody></table></div></section><section id="mutation-drop' || o_orderkey || '"><p>No heading</p></section>'
  WHEN 3 THEN 'EU and US endpoint https://us.shop.test/g' || o_orderkey || ', then' || chr(10) || 'Authorization: Bearer abc' || o_orderkey || chr(10) || 'Content-Type: application/json' || chr(10) || 'Results come with cursor pagination of ' || o_custkey || ' rows. Done'
  END FROM {orders}"""),
    "words": ("id long, a string, b string", """SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN 'static' WHEN 1 THEN './near' WHEN 2 THEN '@/alias' WHEN 3 THEN 'onClick' WHEN 4 THEN 'Panel' WHEN 5 THEN NULL WHEN 6 THEN 'ui-element' ELSE p_name END, CASE p_size % 7 WHEN 0 THEN 'button "' || p_name || '"' WHEN 1 THEN 'a b/c~(' || p_brand || ')!''é*' WHEN 2 THEN '' WHEN 3 THEN 'token: "' || p_brand || '"' WHEN 4 THEN 'Authorization: Bearer [REDACTED]' WHEN 5 THEN 'Authorization: Basic ' || p_size ELSE '<section> & [ ' || p_name || ' ! ]' END FROM {part}"""),
    "boxes": ("id long, x double, y double, w double, h double", "SELECT event_id, value, CAST(user_id AS DOUBLE) - 5, value * 0.7 - 10, CASE WHEN value > 90 THEN NULL ELSE 5.0 END FROM {events}"),
    "candidates": ("id long, signals array<string>, declared string, resolved string, context array<string>, callouts int, claims int, issues array<string>", "SELECT o_orderkey, CASE o_custkey % 4 WHEN 0 THEN {list}('focusable', 'pointer-listener') WHEN 1 THEN {list}('focusable') WHEN 2 THEN {list}('inline-click-handler') ELSE {list}('hover') END, CASE WHEN o_orderstatus = 'F' THEN '/x' || o_orderkey WHEN o_orderstatus = 'O' THEN '' END, CASE WHEN o_totalprice > 200000 THEN 'https://a.test/x' END, CASE WHEN o_orderpriority LIKE '1%' THEN {list}('nav') ELSE {list}('main', 'nav') END, CAST(o_custkey % 3 AS INT), CAST(1 + o_custkey % 2 AS INT), CASE o_orderkey % 6 WHEN 0 THEN {list}('screenshot-unavailable') WHEN 1 THEN {list}('bounding-box-invalid') WHEN 2 THEN {list}('claim-ineligible', 'x') ELSE {none} END FROM {orders}"),
    "patterns": ("id long, pattern string, path string", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/:lang/:id?' WHEN 1 THEN '/:a/:b' WHEN 2 THEN '/en' ELSE '/x/:token' END, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) FROM {pages}"),
    "usages": ("src string, name string, path string, line int", "SELECT 'm' || p_partkey, CASE WHEN p_size > 45 THEN 'None' ELSE 'C' || p_size END, p_brand || '.tsx', CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS INT) ELSE 0 END FROM {part}"),
    "components": ("id string, name string, path string, line int", "SELECT 'q' || p_partkey, 'C' || p_size, p_brand || '.tsx', CAST(p_partkey AS INT) FROM {part}"),
    "tree": ("id string, parent string, kind string", "SELECT 'r' || r_regionkey, CAST(NULL AS STRING), 'element' FROM {region} UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, CASE WHEN n_nationkey % 4 = 0 THEN 'fragment' ELSE 'element' END FROM {nation} UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'element' FROM {customer} UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'text' ELSE 'element' END FROM {orders}"),
    "edges": ("id string, type string, src string, dst string", "SELECT 'a' || n_nationkey, 'RENDERS_ROUTE', 'r' || n_regionkey, 'N' || n_nationkey FROM {nation} WHERE n_nationkey < 10 UNION ALL SELECT 'b' || n_nationkey, 'RENDERS', 'N' || n_nationkey, 'N' || (n_nationkey * 7 % 25) FROM {nation} UNION ALL SELECT 'c' || c_custkey, 'CONTAINS_ELEMENT', 'N' || c_nationkey, 'c' || c_custkey FROM {customer} UNION ALL SELECT 'o' || o_orderkey, 'CONTAINS_ELEMENT', 'c' || o_custkey, 'o' || o_orderkey FROM {orders} UNION ALL SELECT 's' || s_suppkey, 'CALLS', 'f' || s_suppkey, 'f' || (s_suppkey * 2 % 97) FROM {supplier}"),
    "call_roots": ("node string", "SELECT 'f' || s_suppkey FROM {supplier} WHERE s_nationkey < 5"),
    "route_ids": ("route_id string", "SELECT 'r' || r_regionkey FROM {region}"),
    "members": ("feature_id string, node string", "SELECT 'F' || c_nationkey, 'c' || c_custkey FROM {customer} UNION ALL SELECT 'F' || (o_orderkey % 25), 'o' || o_orderkey FROM {orders} UNION ALL SELECT 'F' || s_nationkey, 'f' || s_suppkey FROM {supplier}"),
    "shown": ("state_id string, route_id string, key string", "SELECT 's' || event_id, 'r' || user_id, event_type || ':' || CAST(floor(value * 20) AS BIGINT) FROM {events}"),
    "exports": ("module string, name string, target string, from_module string, from_name string", "SELECT 'm' || p_partkey, 'a', CASE WHEN p_size % 4 = 0 THEN 'd' || CAST(floor(p_partkey / 3) AS BIGINT) END, CASE WHEN p_size % 4 <> 0 THEN 'm' || (p_partkey + 1) END, CASE WHEN p_size % 4 <> 0 THEN 'a' END FROM {part} UNION ALL SELECT 'm' || p_partkey, 'a', CAST(NULL AS STRING), 'm' || CASE WHEN p_size % 3 = 0 THEN p_partkey - 1 ELSE CAST(floor(p_partkey / 2) AS BIGINT) END, 'a' FROM {part} WHERE p_size % 10 = 1"),
    "claims": ("claim_id string, feature_id string, kind string, text string, status string, state_id string, target_id string, transition_id string", "SELECT 'c' || o_orderkey, 'f' || o_custkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'goal' WHEN '2-HIGH' THEN 'action' WHEN '3-MEDIUM' THEN 'outcome' WHEN '4-NOT SPECIFIED' THEN 'limitation' ELSE 'route' END, o_orderpriority || ' ' || o_custkey, CASE WHEN o_totalprice > 400000 THEN 'ambiguous' WHEN o_orderstatus = 'F' THEN 'corroborated' WHEN o_orderstatus = 'O' THEN 'runtime-only' ELSE 'static-only' END, 's' || o_custkey, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'e' || CAST(floor(o_orderkey / 3) AS BIGINT) END, CASE WHEN o_totalprice > 100000 THEN 't' || o_orderkey END FROM {orders}"),
    "targets": ("state_id string, target_id string, x double, y double, w double, h double", "SELECT 's' || o_custkey, 'e' || CAST(floor(o_orderkey / 3) AS BIGINT), o_totalprice / 5000 - 5, CAST(1 AS DOUBLE), CAST(5 AS DOUBLE), CAST(o_orderkey % 7 AS DOUBLE) FROM {orders} WHERE o_orderkey % 5 <> 0"),
    "screenshots": ("state_id string, path string", "SELECT 's' || c_custkey, c_name || '.png' FROM {customer} WHERE c_acctbal > 500"),
    "statements": ("section string, idx int, text string, claim_ids array<string>", "SELECT role, CAST(conv_id * 100 + turn AS INT), text, CASE WHEN length(text) % 5 = 0 THEN {none} WHEN length(text) % 5 = 1 THEN {list}('c' || (conv_id * 7)) ELSE {list}('c' || (conv_id * 31 + turn), 'c' || (conv_id * 90)) END FROM {conversations}"),
    "audits": ("doc_id string, number int, action string, status string, warnings int", "SELECT 'd' || conv_id, CAST(turn + 1 AS INT), CASE WHEN turn = 0 AND conv_id % 4 <> 0 THEN 'created' WHEN length(text) % 3 = 0 OR (turn + conv_id) % 3 = 0 THEN 'approved' ELSE 'edited' END, CASE WHEN length(text) % 4 = 0 THEN 'failed' ELSE 'passed' END, CASE WHEN length(text) % 5 = 0 THEN 1 ELSE 0 END FROM {conversations}"),
    "titles": ("id long, title string", "SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'CON' WHEN 1 THEN '///' WHEN 2 THEN NULL WHEN 3 THEN 'Crème ' || p_name || '!' ELSE p_name || '  (' || p_size || ')' END FROM {part}"),
    "globs": ("id long, value string, pattern string", "SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), CASE page_id % 5 WHEN 0 THEN '/en/*' WHEN 1 THEN '/*5' WHEN 2 THEN '*/*' WHEN 3 THEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) ELSE '/*/' END FROM {pages}"),
})


_CLASS = r"""CASE WHEN regexp_matches(value, '(?i)redact|masked|hidden|^\*+$') OR regexp_matches(value, '^\[[^\]]+\]$') THEN 'redacted'
  WHEN regexp_matches(value, '^[0-9]+$') OR regexp_matches(value, '(?i)^[0-9a-f]{{16,}}$') OR (length(value) >= 20 AND regexp_matches(value, '[A-Za-z]') AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '^[A-Za-z0-9_-]+$')) THEN 'opaque-identifier'
  WHEN regexp_matches(value, '^[A-Za-z][A-Za-z0-9]*([-_][A-Za-z0-9]+)*$') AND length(value) <= 64 THEN 'stable-slug' ELSE 'opaque-identifier' END""".replace("{{", "{").replace("}}", "}")
Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, tuple[Query, str]] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def keep(function: Query) -> Query:
        FOUND[function.__name__] = (function, sql)
        return function

    return keep


def shown(results: DataFrame) -> DataFrame:
    """Result rows with their lists as text."""
    return results.select("domain", "status", F.coalesce("strength", F.lit("")).alias("strength"), F.array_join("static", ",").alias("static"), F.coalesce("runtime", F.lit("")).alias("runtime"), F.array_join(F.array_sort("reasons"), ",").alias("reasons"))


_PATH = "regexp_replace({0}, '^https?://[^/]*', '')"
_HTTP = T.with_sql("requests", "network") + f""",
s AS (SELECT node_id, upper(method) AS m, {_PATH.format("url")} AS path FROM requests WHERE method <> '' AND url <> ''),
k AS (SELECT m, path, string_agg(node_id, ',' ORDER BY node_id) AS nodes, count(*) AS n FROM s GROUP BY m, path),
r AS (SELECT ref, upper(method) AS m, {_PATH.format("url")} AS path FROM network WHERE resource_type NOT IN ('document', 'script', 'stylesheet', 'image', 'font', 'media')),
c AS (SELECT m, path, count(*) AS r FROM r GROUP BY m, path),
http AS (
SELECT 'http' AS domain, 'ambiguous' AS status, '' AS strength, node_id AS static, '' AS runtime, 'dynamic-static-evidence' AS reasons FROM requests WHERE method IS NULL OR coalesce(url, '') = ''
UNION ALL SELECT 'http', 'static-only', '', node_id, '', 'runtime-coverage-bounded,static-request-not-observed' FROM s WHERE (m, path) NOT IN (SELECT (m, path) FROM r)
UNION ALL SELECT 'http', CASE WHEN n > 1 THEN 'ambiguous' ELSE 'corroborated' END, CASE WHEN n > 1 THEN '' WHEN r = 1 THEN 'exact' ELSE 'strong' END, nodes, ref, CASE WHEN n > 1 THEN 'duplicate-static-request-ambiguous,' ELSE '' END || 'http-method-match,http-path-match' FROM r JOIN k USING (m, path) JOIN c USING (m, path)
UNION ALL SELECT 'http', 'runtime-only', '', '', ref, 'network-request-not-in-static-manifest' FROM r WHERE (m, path) NOT IN (SELECT (m, path) FROM k))
"""


@query(_HTTP + "SELECT * FROM http")
def http_results(spark: SparkSession, d: str) -> DataFrame:
    return shown(evidence.http_results(T.frame(spark, d, "requests"), T.frame(spark, d, "network")))


_GRAPHQL = T.with_sql("executions", "network") + f""",
r AS (SELECT ref, {_PATH.format("url")} AS path FROM network WHERE resource_type NOT IN ('document', 'script', 'stylesheet', 'image', 'font', 'media')),
k AS (SELECT {_PATH.format("endpoint")} AS path, string_agg(node_id, ',' ORDER BY node_id) AS nodes FROM executions WHERE endpoint <> '' GROUP BY 1)
SELECT 'graphql' AS domain, 'static-only' AS status, '' AS strength, node_id AS static, '' AS runtime, 'graphql-endpoint-unresolved' AS reasons FROM executions WHERE coalesce(endpoint, '') = ''
UNION ALL SELECT 'graphql', 'static-only', '', nodes, '', 'graphql-endpoint-not-observed,runtime-coverage-bounded' FROM k WHERE path NOT IN (SELECT path FROM r)
UNION ALL SELECT 'graphql', 'corroborated', 'strong', nodes, ref, 'graphql-endpoint-match,named-operation-not-proven' FROM k JOIN r USING (path)"""


@query(_GRAPHQL)
def graphql_results(spark: SparkSession, d: str) -> DataFrame:
    return shown(evidence.graphql_results(T.frame(spark, d, "executions"), T.frame(spark, d, "network")))


_FOLD = "lower(trim(regexp_replace(coalesce({0}, ''), '[ \\t\\r\\n]+', ' ', 'g')))"
_NAVIGATION = T.with_sql("navigations", "transitions") + f""",
p AS (SELECT node_id, ref, {_FOLD.format("n.label")} AS label, {_FOLD.format("n.label")} = {_FOLD.format("t.label")} AS same FROM navigations n JOIN transitions t ON destination = path WHERE destination <> ''),
g AS (SELECT node_id, label, count(*) AS n, count(*) FILTER (same) AS n_same, min(ref) AS one, min(ref) FILTER (same) AS labelled FROM p GROUP BY node_id, label),
c AS (SELECT *, CASE WHEN n > 1 AND label = '' THEN NULL WHEN n_same = 1 THEN labelled WHEN n = 1 THEN one END AS chosen, label <> '' AND n_same > 0 AS named FROM g)
SELECT 'navigation' AS domain, 'ambiguous' AS status, '' AS strength, node_id AS static, '' AS runtime, 'dynamic-static-evidence' AS reasons FROM navigations WHERE coalesce(destination, '') = ''
UNION ALL SELECT 'navigation', 'corroborated', CASE WHEN named THEN 'exact' ELSE 'strong' END, node_id, chosen, 'navigation-destination-match' || CASE WHEN named THEN ',navigation-label-match' ELSE '' END FROM c WHERE chosen IS NOT NULL
UNION ALL SELECT 'navigation', 'ambiguous', '', node_id, ref, 'duplicate-navigation-ambiguous,navigation-destination-match' FROM p WHERE node_id IN (SELECT node_id FROM c WHERE chosen IS NULL)
UNION ALL SELECT 'navigation', 'static-only', '', node_id, '', 'no-runtime-transition-match,runtime-coverage-bounded' FROM navigations WHERE destination <> '' AND destination NOT IN (SELECT path FROM transitions)
UNION ALL SELECT 'navigation', 'runtime-only', '', '', ref, CASE WHEN kind = 'same-url' THEN 'same-url-transition-no-static-navigation' ELSE 'no-static-navigation-match' END FROM transitions WHERE ref NOT IN (SELECT chosen FROM c WHERE chosen IS NOT NULL)"""


@query(_NAVIGATION)
def navigation_results(spark: SparkSession, d: str) -> DataFrame:
    return shown(evidence.navigation_results(T.frame(spark, d, "navigations"), T.frame(spark, d, "transitions")))


def _ui(spark: SparkSession, d: str) -> DataFrame:
    return evidence.ui_results(*(T.frame(spark, d, t) for t in ("static_ui", "runtime_ui", "contexts", "scopes")))


_UI = T.with_sql("static_ui", "runtime_ui", "contexts", "scopes") + f""",
pair AS (
  SELECT *, CASE WHEN lower(s_tag) = r_tag THEN 'compatible-element-kind'
    WHEN (lower(s_tag) = 'button' AND r_role = 'button') OR (lower(s_tag) IN ('a', 'link') AND r_role = 'link') OR (lower(s_tag) = 'input' AND r_role IN ('textbox', 'checkbox', 'radio', 'spinbutton', 'searchbox'))
      OR (lower(s_tag) = 'textarea' AND r_role = 'textbox') OR (lower(s_tag) = 'select' AND r_role = 'combobox') OR (regexp_matches(lower(s_tag), '^h[1-6]$') AND r_role = 'heading') THEN 'compatible-role' END AS kind,
    {_FOLD.format("s_text")} AS t, {_FOLD.format("s_aria")} AS a, {_FOLD.format("s_hint")} AS h, {_FOLD.format("r_name")} AS rn, {_FOLD.format("r_text")} AS rt, lower(coalesce(s_type, '')) AS sy, lower(coalesce(r_type, '')) AS ry
  FROM runtime_ui JOIN contexts USING (state_id) JOIN scopes USING (route_id) JOIN static_ui USING (node_id) WHERE NOT ambiguous),
why AS (
  SELECT ref, node_id, list_distinct(list_concat([kind, 'element-type-match'], CASE WHEN a <> '' AND a = rn THEN ['exact-accessible-name', 'accessible-name-exact', 'aria-label-match'] ELSE [] END,
    CASE WHEN t <> '' AND t = rt THEN ['exact-text', 'element-text-exact'] ELSE [] END, CASE WHEN t <> '' AND t = rn THEN ['exact-accessible-name', 'accessible-name-exact'] ELSE [] END,
    CASE WHEN ({_FOLD.format("s_label")} <> '' AND {_FOLD.format("s_label")} = rn) OR ({_FOLD.format("s_title")} <> '' AND {_FOLD.format("s_title")} = rn) THEN ['exact-label'] ELSE [] END,
    CASE WHEN h <> '' AND h = {_FOLD.format("r_hint")} THEN ['exact-placeholder', 'placeholder-match'] ELSE [] END, CASE WHEN sy <> '' AND sy = ry THEN ['input-type-match'] ELSE [] END,
    CASE WHEN s_event AND r_strong THEN ['event-compatible', 'interaction-evidence-match'] ELSE [] END)) AS why
  FROM pair WHERE kind IS NOT NULL AND NOT (sy <> '' AND ry <> '' AND sy <> ry)),
fit AS (SELECT * FROM why WHERE len(list_filter(why, lambda x: starts_with(x, 'exact-'))) > 0),
g AS (SELECT ref, count(*) AS n, string_agg(node_id, ',' ORDER BY node_id) AS nodes, any_value(why) AS why FROM fit GROUP BY ref),
o AS (SELECT u.ref, coalesce(n, 0) AS n, nodes, why, CASE WHEN coalesce(ambiguous, false) THEN 'ambiguous-route-context' WHEN route_id IN (SELECT route_id FROM scopes) THEN 'eligible' ELSE 'insufficient-static-ui-context' END AS context
  FROM runtime_ui u LEFT JOIN contexts USING (state_id) LEFT JOIN g ON g.ref = u.ref)
SELECT 'ui' AS domain, CASE WHEN n = 0 THEN 'runtime-only' WHEN n > 1 THEN 'ambiguous' ELSE 'corroborated' END AS status, CASE WHEN n = 1 THEN CASE WHEN list_contains(why, 'exact-text') THEN 'exact' ELSE 'strong' END ELSE '' END AS strength,
  coalesce(nodes, '') AS static, ref AS runtime, CASE WHEN n = 0 THEN CASE WHEN context = 'eligible' THEN 'no-compatible-static-ui' ELSE context END
    WHEN n > 1 THEN 'duplicate-label-ambiguous,multiple-compatible-static-ui,route-context-match,selected-route-context' ELSE array_to_string(list_sort(list_concat(why, ['selected-route-context', 'route-context-match'])), ',') END AS reasons FROM o
UNION ALL SELECT 'ui', 'static-only', '', node_id, '', CASE WHEN concat({", ".join(_FOLD.format(c) for c in ("s_text", "s_aria", "s_label", "s_title", "s_hint"))}) = '' THEN 'dynamic-static-identity'
  WHEN node_id IN (SELECT node_id FROM scopes) THEN 'no-runtime-element-match' ELSE 'insufficient-runtime-route-context' END || ',runtime-coverage-bounded' FROM static_ui WHERE node_id NOT IN (SELECT node_id FROM fit)"""


@query(_UI)
def ui_results(spark: SparkSession, d: str) -> DataFrame:
    return shown(_ui(spark, d))


@query(_HTTP + """, parts AS (SELECT unnest(['route', 'ui', 'navigation', 'http', 'graphql']) AS domain)
SELECT p.domain, count(*) FILTER (status = 'corroborated') AS corroborated, count(*) FILTER (status = 'static-only') AS static_only, count(*) FILTER (status = 'runtime-only') AS runtime_only, count(*) FILTER (status = 'ambiguous') AS ambiguous
FROM parts p LEFT JOIN http h ON h.domain = p.domain GROUP BY p.domain""")
def domain_statuses(spark: SparkSession, d: str) -> DataFrame:
    """Requests only: the other domains are there with zeros."""
    return evidence.summarise(evidence.http_results(T.frame(spark, d, "requests"), T.frame(spark, d, "network")))


@query(_HTTP + """SELECT 'reconciliation-result:' || substr(sha256('{"domain":"' || domain || '","status":"' || status || '","static":[' || CASE WHEN static = '' THEN '' ELSE '"' || replace(static, ',', '","') || '"' END || '],"runtime":"' || runtime || '","reasons":["' || replace(reasons, ',', '","') || '"]}'), 1, 16) AS id, status FROM http""")
def result_ids(spark: SparkSession, d: str) -> DataFrame:
    return evidence.http_results(T.frame(spark, d, "requests"), T.frame(spark, d, "network")).select(evidence.result_id().alias("id"), "status")


_STRIP = "regexp_replace({0}, '\\s+', '', 'g')"
_DIMENSIONS = T.with_sql("documented", "product", "arguments", "variables") + f""",
p AS (SELECT operation_id, node_id, n_variants, has_variables, d.return_type AS a, q.return_type AS b FROM documented d JOIN product q USING (name, type)),
w AS (SELECT * FROM p WHERE n_variants = 1 AND has_variables),
l AS (SELECT w.operation_id, node_id, key, x.type, required, default_value FROM w JOIN arguments x USING (operation_id)),
r AS (SELECT operation_id, w.node_id, key, x.type, required, default_value FROM w JOIN variables x ON x.node_id = w.node_id),
f AS (SELECT coalesce(l.operation_id, r.operation_id) AS operation_id, coalesce(l.node_id, r.node_id) AS node_id, coalesce(l.key, r.key) AS key, l.key IS NOT NULL AND r.key IS NOT NULL AS there, {_STRIP.format("l.type")} = {_STRIP.format("r.type")} AS t, l.required = r.required AS q, l.default_value = r.default_value AS v
  FROM l FULL JOIN r ON l.operation_id = r.operation_id AND l.node_id = r.node_id AND l.key = r.key),
dims AS (
SELECT operation_id, node_id, 'argument-presence' AS dimension, key, 'conflict' AS status FROM f WHERE NOT there
UNION ALL SELECT operation_id, node_id, 'argument-name', key, 'match' FROM f WHERE there
UNION ALL SELECT operation_id, node_id, 'argument-type', key, CASE WHEN t THEN 'match' ELSE 'conflict' END FROM f WHERE there
UNION ALL SELECT operation_id, node_id, 'argument-requiredness', key, CASE WHEN q IS NULL THEN 'insufficient' WHEN q THEN 'match' ELSE 'conflict' END FROM f WHERE there
UNION ALL SELECT operation_id, node_id, 'argument-default', key, CASE WHEN v THEN 'match' ELSE 'conflict' END FROM f WHERE there AND v IS NOT NULL
UNION ALL SELECT operation_id, node_id, unnest(['operation-name', 'operation-type']), NULL, 'match' FROM p
UNION ALL SELECT operation_id, node_id, 'argument-presence', NULL, 'insufficient' FROM p WHERE NOT (n_variants = 1 AND has_variables)
UNION ALL SELECT operation_id, node_id, 'return-type', NULL, CASE WHEN coalesce(a, '') = '' OR coalesce(b, '') = '' THEN 'insufficient' WHEN {_STRIP.format("a")} = {_STRIP.format("b")} THEN 'match' ELSE 'conflict' END FROM p WHERE n_variants = 1)
"""


def _dimensions(spark: SparkSession, d: str) -> DataFrame:
    return contracts.signature_dimensions(*(T.frame(spark, d, t) for t in ("documented", "product", "arguments", "variables")))


@query(_DIMENSIONS + "SELECT * FROM dims")
def signature_dimensions(spark: SparkSession, d: str) -> DataFrame:
    return _dimensions(spark, d)


_OPERATIONS = _DIMENSIONS + """,
o AS (SELECT operation_id, node_id, d.type = q.type AS exact FROM documented d JOIN product q USING (name) WHERE d.type <> 'unknown'),
n AS (SELECT operation_id, count(*) FILTER (exact) AS e, count(*) AS n FROM o GROUP BY operation_id),
res AS (SELECT operation_id, node_id, CASE WHEN CASE WHEN e > 0 THEN e ELSE n END > 1 THEN 'ambiguous' WHEN e = 0 OR operation_id IN (SELECT operation_id FROM dims WHERE status = 'conflict') THEN 'conflicting' ELSE 'corroborated' END AS status,
    CASE WHEN CASE WHEN e > 0 THEN e ELSE n END > 1 THEN 'multiple-static-operation-candidates' WHEN e = 0 THEN 'operation-type-conflict' ELSE 'operation-type-match' END AS reason FROM o JOIN n USING (operation_id) WHERE e = 0 OR exact),
ops AS (SELECT * FROM res UNION ALL SELECT operation_id, NULL, 'contract-only', 'no-static-operation-match' FROM documented WHERE type <> 'unknown' AND operation_id NOT IN (SELECT operation_id FROM o)
UNION ALL SELECT NULL, node_id, 'product-only', 'no-contract-operation-match' FROM product WHERE node_id NOT IN (SELECT node_id FROM res))
"""


def _operations(spark: SparkSession, d: str) -> DataFrame:
    return contracts.operation_results(T.frame(spark, d, "documented"), T.frame(spark, d, "product"), _dimensions(spark, d))


@query(_OPERATIONS + "SELECT * FROM ops")
def operation_results(spark: SparkSession, d: str) -> DataFrame:
    return _operations(spark, d)


@query(_OPERATIONS.replace("WITH ", "WITH " + T.with_sql("features")[5:] + ",\n", 1) + "SELECT DISTINCT feature_id, node_id, operation_id FROM ops JOIN features USING (node_id) WHERE status IN ('corroborated', 'conflicting') AND operation_id IS NOT NULL")
def feature_links(spark: SparkSession, d: str) -> DataFrame:
    return contracts.feature_links(_operations(spark, d), T.frame(spark, d, "features"))


@query(_OPERATIONS.replace("WITH ", "WITH " + T.with_sql("executes", "transports")[5:] + ",\n", 1) + "SELECT DISTINCT operation_id, node_id, ref FROM ops JOIN executes USING (node_id) JOIN transports USING (execution_id)")
def operation_transport(spark: SparkSession, d: str) -> DataFrame:
    return contracts.with_transport(_operations(spark, d), T.frame(spark, d, "executes"), T.frame(spark, d, "transports"))


@query(T.with_sql("doc_endpoints", "code_endpoints", "seen_endpoints", "origins") + r""",
c AS (SELECT endpoint_id, regexp_extract(value, '^https?://[^/?#]*') AS origin, rtrim(regexp_extract(value, '^https?://[^/?#]*([^?#]*)', 1), '/') AS path FROM doc_endpoints),
k AS (SELECT node_id, CASE WHEN value[1] = '/' THEN NULL ELSE regexp_extract(value, '^https?://[^/?#]*') END AS origin, rtrim(regexp_replace(value, '^https?://[^/?#]*', ''), '/') AS path FROM code_endpoints),
m AS (SELECT endpoint_id, node_id, NULL AS ref, 'corroborated' AS status, 'endpoint-exact' AS reason FROM c JOIN k USING (origin, path)
  UNION ALL SELECT endpoint_id, node_id, NULL, 'corroborated', 'endpoint-path-match' FROM c JOIN k ON k.origin IS NULL AND c.path = k.path WHERE c.origin IN (SELECT origin FROM origins)),
a AS (SELECT * FROM m UNION ALL SELECT endpoint_id, NULL, ref, 'corroborated', 'endpoint-runtime-observed' FROM c JOIN seen_endpoints s ON regexp_extract(value, '^https?://[^/?#]*') = origin AND regexp_extract(value, '^https?://[^/?#]*([^?#]*)', 1) = path)
SELECT * FROM a UNION ALL SELECT endpoint_id, NULL, NULL, 'contract-only', 'documented-endpoint-not-observed' FROM c WHERE endpoint_id NOT IN (SELECT endpoint_id FROM a)
UNION ALL SELECT NULL, node_id, NULL, 'product-only', 'no-contract-endpoint-match' FROM k WHERE node_id NOT IN (SELECT node_id FROM m)""")
def endpoint_results(spark: SparkSession, d: str) -> DataFrame:
    return contracts.endpoint_results(*(T.frame(spark, d, t) for t in ("doc_endpoints", "code_endpoints", "seen_endpoints", "origins")))


@query(T.with_sql("doc_types", "code_types", "doc_fields", "code_fields") + f""",
n AS (SELECT name, count(*) AS n, min(node_id) AS node_id FROM code_types GROUP BY name),
f AS (SELECT name, count(*) AS n_fields, count(*) FILTER ({_STRIP.format("x.type")} <> {_STRIP.format("y.type")}) AS n_conflicts FROM doc_types JOIN n USING (name) JOIN doc_fields x USING (name) JOIN code_fields y ON y.node_id = n.node_id AND y.field = x.field WHERE n = 1 GROUP BY name)
SELECT name, CASE WHEN n IS NULL THEN 'contract-only' WHEN n > 1 THEN 'ambiguous' WHEN n_conflicts > 0 THEN 'conflicting' ELSE 'corroborated' END AS status, coalesce(n_fields, 0) AS n_fields, coalesce(n_conflicts, 0) AS n_conflicts FROM doc_types LEFT JOIN n USING (name) LEFT JOIN f USING (name)
UNION ALL SELECT name, 'product-only', 0, 0 FROM code_types WHERE name NOT IN (SELECT name FROM doc_types)""")
def type_results(spark: SparkSession, d: str) -> DataFrame:
    return contracts.type_results(*(T.frame(spark, d, t) for t in ("doc_types", "code_types", "doc_fields", "code_fields")))


@query(T.with_sql("words") + r"""
SELECT id, CASE WHEN a = 'static' THEN nullif(b, '') END AS static, coalesce(a, '') || '|' || coalesce(b, '') AS key, regexp_extract(b, '"(.*)"$', 1) AS quoted,
  CASE WHEN regexp_extract(b, '["'']([^"'']+)["'']$', 1) <> '' THEN regexp_extract(b, '["'']([^"'']+)["'']$', 1) WHEN a = 'ui-element' THEN '' ELSE b END AS label,
  regexp_replace(b, '\s+', '', 'g') AS type, replace(replace(replace(replace(replace(b, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html,
  CASE WHEN regexp_matches(a, '^\.{1,2}/') THEN 'relative' WHEN regexp_matches(a, '^[@~]/') THEN 'unsupported-module-alias' WHEN a IS NOT NULL THEN 'external-module' END AS module,
  regexp_matches(a, '^[A-Z]') AS component, regexp_matches(a, '^on[A-Z]') AS event, CASE WHEN regexp_matches(b, '(?i)token|secret|password|bearer|api[_-]?key') THEN '[REDACTED]' ELSE b END AS safe,
  coalesce(regexp_matches(b, '(?i)(token|api[_-]?key|password|secret)["'']?\s*[:=]\s*["''][^"'']+') AND NOT contains(b, '[REDACTED]') OR (regexp_matches(b, '(?i)^authorization: [a-z]') AND NOT regexp_matches(b, '(?i)^authorization: bearer')), false) AS unsafe, CASE WHEN regexp_matches(b, '(?i)<(html|section|article)\b') THEN 'html' WHEN b IS NOT NULL THEN 'text' END AS content, sha256(coalesce(a, '') || chr(10) || coalesce(b, '')) AS checksum,
  replace(replace(replace(replace(replace(replace(url_encode(b), '%2F', '/'), '%21', '!'), '%28', '('), '%29', ')'), '%27', ''''), '%2A', '*') AS uri
FROM words""")
def value_names(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    none = F.lit(None).cast("string")
    module = F.when(a.isNotNull(), N.module_class(a))
    return T.frame(spark, d, "words").select(
        "id", N.static_value(a, b).alias("static"), N.joined_key(a, b).alias("key"), N.quoted_label(b).alias("quoted"), N.display_label(a, none, none, b).alias("label"), N.graphql_type(b).alias("type"), N.escaped_html(b).alias("html"),
        module.alias("module"), N.is_component(a).alias("component"), N.is_event(a).alias("event"), N.redacted_value(b).alias("safe"), F.coalesce(N.unsafe_secret(b), F.lit(False)).alias("unsafe"),
        F.when(b.isNotNull(), N.content_type(b)).alias("content"), knowledge.revision_checksum(a, b).alias("checksum"), N.uri_component(b).alias("uri"),
    )


@query(T.with_sql("boxes") + """
SELECT id, floor(w * 100 + 0.5) / 100 AS width, CASE WHEN x IS NULL OR w IS NULL OR h IS NULL OR isnan(x) OR x < 0 OR y < 0 OR w <= 0 OR h <= 0 THEN 'bounding-box-invalid' WHEN x + w > 100 OR y + h > 100 THEN 'bounding-box-out-of-bounds' END AS issue FROM boxes""")
def box_issues(spark: SparkSession, d: str) -> DataFrame:
    return T.frame(spark, d, "boxes").select("id", N.rounded(F.col("w")).alias("width"), N.box_issue(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(100), F.lit(100)).alias("issue"))


@query(T.with_sql("candidates") + """,
s AS (SELECT *, CASE WHEN list_has_any(signals, ['inline-click-handler', 'direct-click-listener', 'pointer-listener']) THEN 'strong' WHEN list_contains(signals, 'focusable') THEN 'supporting' ELSE 'weak' END AS strength FROM candidates)
SELECT id, strength, CASE WHEN coalesce(declared, '') <> '' AND coalesce(resolved, '') <> '' THEN 'explicit-destination' WHEN strength = 'strong' AND len(context) > 0 THEN 'custom-navigation' ELSE 'none' END AS navigation,
  CASE WHEN list_has_any(issues, ['ambiguous-runtime-target', 'claim-ineligible']) THEN 'ambiguous' WHEN callouts > 0 AND len(issues) > 0 THEN 'partially-mapped' WHEN callouts > 0 AND callouts >= claims THEN 'mapped' WHEN callouts > 0 THEN 'partially-mapped'
    WHEN list_has_any(issues, ['screenshot-unavailable', 'screenshot-state-mismatch']) THEN 'screenshot-unavailable' ELSE 'no-visual-target' END AS mapping,
  CASE WHEN list_contains(context, 'nav') THEN 'x' END AS nav FROM s""")
def candidate_classes(spark: SparkSession, d: str) -> DataFrame:
    rows = T.frame(spark, d, "candidates").withColumn("strength", N.candidate_strength(F.col("signals")))
    return rows.select("id", "strength", N.navigation_class(F.col("declared"), F.col("resolved"), F.col("strength"), F.col("context")).alias("navigation"), N.mapping_status(F.col("callouts"), F.col("claims"), F.col("issues")).alias("mapping"), F.when(F.array_contains("context", "nav"), F.lit("x")).alias("nav"))


@query(T.with_sql("patterns") + rf""", v AS (SELECT id, pattern, path, string_split(pattern[2:], '/') AS p, string_split(path[2:], '/') AS s FROM patterns), x AS (SELECT id, pattern, path, unnest(s) AS value, unnest(range(1, len(s) + 1)) AS i, p FROM v),
y AS (SELECT *, i <= len(p) AND starts_with(p[i], ':') AS bound, {_CLASS} AS class, rtrim(ltrim(p[i], ':'), '?') AS name FROM x)
SELECT id, pattern || '|/' || coalesce(string_agg(CASE WHEN NOT bound THEN value WHEN class = 'stable-slug' THEN lower(value) ELSE ':opaque' END, '/' ORDER BY i), '') AS key, '/' || coalesce(string_agg(CASE WHEN bound AND class <> 'stable-slug' THEN '[opaque]' ELSE value END, '/' ORDER BY i), '') AS path,
  coalesce(string_agg(name || ':' || class || ':' || CASE WHEN class = 'stable-slug' THEN value ELSE '' END, ',' ORDER BY i) FILTER (bound), '') AS bindings FROM y GROUP BY id, pattern""")
def route_bindings(spark: SparkSession, d: str) -> DataFrame:
    pattern, path = F.col("pattern"), F.col("path")
    told = F.transform(R.bindings(pattern, path), lambda x: F.concat_ws(":", x["parameter"], x["class"], F.coalesce(x["value"], F.lit(""))))
    return T.frame(spark, d, "patterns").select("id", R.structure_key(pattern, path).alias("key"), R.sanitized_path(pattern, path).alias("path"), F.array_join(told, ",").alias("bindings"))


@query("""SELECT o_orderkey AS doc_id, 2 AS line, 'query' AS type, 'op' || o_orderkey AS name, '[Order!]' AS return_type, 'Lists orders' AS description, 'page:Int:' || o_custkey || ',filter:F' || o_orderkey || '!:' AS arguments FROM orders WHERE o_orderkey % 5 = 0
UNION ALL SELECT o_orderkey, 3, 'unknown', 'GET /v1/orders/' || o_orderkey, NULL, NULL, '' FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, 2, 'mutation', 'add', 'Order', NULL, 'input:New!:' FROM orders WHERE o_orderkey % 5 = 1""")
def text_operations(spark: SparkSession, d: str) -> DataFrame:
    told = F.transform(apidocs.safe_arguments(F.col("arguments")), lambda x: F.concat_ws(":", x["name"], x["type"], F.coalesce(x["default_value"], F.lit(""))))
    return apidocs.text_operations(T.frame(spark, d, "docs")).withColumn("arguments", F.array_join(told, ",")).select("doc_id", "line", "type", "name", "return_type", F.nullif("description", F.lit("")).alias("description"), "arguments")


@query("SELECT 'T' || o_custkey AS type_name, count(*) AS n_definitions, 1 + count(DISTINCT o_orderstatus = 'F') AS n_fields, count(DISTINCT o_orderstatus = 'F') > 1 AS conflict FROM orders WHERE o_orderkey % 5 = 1 GROUP BY o_custkey")
def documented_types(spark: SparkSession, d: str) -> DataFrame:
    return apidocs.merged_types(apidocs.text_types(T.frame(spark, d, "docs")))


@query("SELECT o_orderkey AS doc_id, 'query' AS type, 'item & more ' || o_orderkey AS name, 'Item!' AS return_type, 'id:ID!' AS arguments FROM orders WHERE o_orderkey % 5 = 2 UNION ALL SELECT o_orderkey, 'mutation', 'drop' || o_orderkey, NULL, '' FROM orders WHERE o_orderkey % 5 = 2")
def html_operations(spark: SparkSession, d: str) -> DataFrame:
    rows = apidocs.html_operations(T.frame(spark, d, "docs"))
    return rows.withColumn("arguments", F.array_join(F.transform("arguments", lambda x: F.concat_ws(":", x["name"], x["type"])), ","))


@query("""SELECT o_orderkey AS doc_id, 'endpoint' AS part, 'https://us.shop.test/g' || o_orderkey AS value, 'US' AS detail FROM orders WHERE o_orderkey % 5 = 3 UNION ALL SELECT o_orderkey, 'header', 'Authorization: Bearer [REDACTED]', 'Bearer' FROM orders WHERE o_orderkey % 5 = 3 UNION ALL SELECT o_orderkey, 'header', 'Content-Type: application/json', NULL FROM orders WHERE o_orderkey % 5 = 3
UNION ALL SELECT o_orderkey, 'pagination', 'Results come with cursor pagination of ' || o_custkey || ' rows', NULL FROM orders WHERE o_orderkey % 5 = 3 UNION ALL SELECT o_orderkey, 'style', CASE WHEN o_orderkey % 5 < 2 THEN 'graphql' ELSE 'unknown' END, NULL FROM orders WHERE o_orderkey % 5 < 4""")
def api_facts(spark: SparkSession, d: str) -> DataFrame:
    docs = T.frame(spark, d, "docs")
    none = F.lit(None).cast("string")
    rows = apidocs.endpoints(docs).select("doc_id", F.lit("endpoint").alias("part"), "value", F.col("region").alias("detail"))
    rows = rows.unionByName(apidocs.authentication(docs).select("doc_id", F.lit("header").alias("part"), F.col("purpose").alias("value"), F.col("scheme").alias("detail")))
    rows = rows.unionByName(apidocs.pagination(docs).select("doc_id", F.lit("pagination").alias("part"), F.col("text").alias("value"), none.alias("detail")))
    by_text = docs.filter("content is not null").select("doc_id", apidocs.api_style(F.col("content"), F.lit(0)).alias("told"))
    style = by_text.join(apidocs.signed(docs).withColumn("signed", F.lit(True)), "doc_id", "left")
    style = style.select("doc_id", F.lit("style").alias("part"), F.when(F.col("signed"), F.lit("graphql")).otherwise(F.col("told")).alias("value"), none.alias("detail"))
    return rows.unionByName(style)


@query(T.with_sql("usages", "components") + """,
x AS (SELECT name, path, line, CASE WHEN count(*) = 1 THEN min(id) END AS id FROM components GROUP BY ALL), y AS (SELECT name, path, CASE WHEN count(*) = 1 THEN min(id) END AS id FROM components GROUP BY ALL)
SELECT src, coalesce(x.id, y.id) AS component FROM usages u LEFT JOIN x USING (name, path, line) LEFT JOIN y ON u.name = y.name AND u.path = y.path""")
def component_resolution(spark: SparkSession, d: str) -> DataFrame:
    return graph.resolve_component(T.frame(spark, d, "usages"), T.frame(spark, d, "components")).select("src", "component")


@query(T.with_sql("usages", "components") + """, n AS (SELECT name, path, count(*) AS n, min(id) AS id FROM components GROUP BY ALL)
SELECT CASE WHEN n = 1 THEN 'edge' ELSE 'unresolved' END AS part, src, CASE WHEN n = 1 THEN id WHEN n IS NULL THEN 'not-found' ELSE 'ambiguous' END AS value FROM usages LEFT JOIN n USING (name, path)""")
def reference_edges(spark: SparkSession, d: str) -> DataFrame:
    edges, open_ = graph.resolve_references(T.frame(spark, d, "usages"), T.frame(spark, d, "components"), ["name", "path"], "RENDERS")
    return edges.select(F.lit("edge").alias("part"), "src", F.col("dst").alias("value")).unionByName(open_.select(F.lit("unresolved").alias("part"), "src", F.col("reason").alias("value")))


@query(T.with_sql("usages") + """ SELECT src, name || CASE WHEN n > 1 THEN '#' || n ELSE '' END AS id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY src) AS n FROM usages)""")
def numbered_ids(spark: SparkSession, d: str) -> DataFrame:
    return graph.unique_ids(T.frame(spark, d, "usages"), "name", "src").select("src", "id")


@query(T.with_sql("tree").replace("WITH ", "WITH RECURSIVE ", 1) + """, w AS (SELECT id AS owner, id, kind, 0 AS depth FROM tree WHERE parent IS NULL UNION ALL SELECT w.owner, t.id, t.kind, w.depth + CASE WHEN t.kind = 'fragment' THEN 0 ELSE 1 END FROM w JOIN tree t ON t.parent = w.id) SELECT owner, id, depth FROM w WHERE kind NOT IN ('fragment', 'text')""")
def element_tree(spark: SparkSession, d: str) -> DataFrame:
    return graph.ui_tree(T.frame(spark, d, "tree"))


_REACH = T.with_sql("edges", "call_roots").replace("WITH ", "WITH RECURSIVE ") + """,
b(route, node) AS (SELECT src, dst FROM edges WHERE type = 'RENDERS_ROUTE' UNION SELECT route, dst FROM b JOIN edges ON src = node AND type = 'RENDERS'),
u(route, node) AS (SELECT route, dst FROM b JOIN edges ON src = node AND type = 'CONTAINS_ELEMENT' UNION SELECT route, dst FROM u JOIN edges ON src = node AND type = 'CONTAINS_ELEMENT'),
c(root, node) AS (SELECT node, node FROM call_roots UNION SELECT root, dst FROM c JOIN edges ON src = node AND type = 'CALLS')
"""


@query(_REACH + "SELECT route AS route_id, node AS node_id FROM u")
def route_scopes(spark: SparkSession, d: str) -> DataFrame:
    return graph.route_scopes(T.frame(spark, d, "edges"), T.frame(spark, d, "route_ids"))


@query(_REACH + "SELECT root, node FROM c")
def callable_closure(spark: SparkSession, d: str) -> DataFrame:
    edges = T.frame(spark, d, "edges").filter("type = 'CALLS'").select("src", "dst")
    return graph.closure(edges, T.frame(spark, d, "call_roots"))


@query(T.with_sql("edges", "members") + " SELECT a.feature_id, id FROM edges JOIN members a ON a.node = src JOIN members b ON b.node = dst AND b.feature_id = a.feature_id")
def inner_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.inner_edges(T.frame(spark, d, "edges"), T.frame(spark, d, "members"))


@query(T.with_sql("shown") + " SELECT state_id, route_id, key, CASE WHEN (SELECT count(DISTINCT route_id) FROM shown x WHERE x.key = s.key) > 1 THEN 'shared-shell' ELSE 'own' END AS scope FROM shown s")
def shared_shell(spark: SparkSession, d: str) -> DataFrame:
    return graph.shared_shell(T.frame(spark, d, "shown"))


@query(T.with_sql("exports").replace("WITH ", "WITH RECURSIVE ", 1) + """, h AS (SELECT DISTINCT module || '#' || name AS a, from_module || '#' || from_name AS b FROM exports WHERE from_module IS NOT NULL), r(a, b) AS (SELECT a, b FROM h UNION SELECT r.a, h.b FROM r JOIN h ON r.b = h.a), n AS (SELECT DISTINCT module, name, module || '#' || name AS a FROM exports),
e AS (SELECT a, a AS b FROM n UNION SELECT a, b FROM r), s AS (SELECT e.a, count(DISTINCT target) AS k, min(target) AS target, bool_or(e.b IN (SELECT a FROM r WHERE a = b)) AS circle FROM e LEFT JOIN exports x ON x.module || '#' || x.name = e.b GROUP BY e.a)
SELECT module, name, CASE WHEN k > 1 THEN 'ambiguous' WHEN k = 1 THEN 'resolved' WHEN circle THEN 'circular' ELSE 'not-found' END AS status, CASE WHEN k = 1 THEN target END AS target FROM n JOIN s USING (a)""")
def resolved_exports(spark: SparkSession, d: str) -> DataFrame:
    return graph.resolve_exports(T.frame(spark, d, "exports"))


_CLAIMS = T.with_sql("claims", "targets", "screenshots", "statements", "audits") + """,
k AS (SELECT state_id, target_id, count(*) AS n, min(x) AS x, min(y) AS y, min(w) AS w, min(h) AS h FROM targets GROUP BY ALL),
m AS (SELECT claim_id, feature_id, path, CASE WHEN target_id IS NULL THEN 'no-visual-target' WHEN status = 'ambiguous' THEN 'claim-ineligible' WHEN n IS NULL THEN 'no-visual-target' WHEN n > 1 THEN 'ambiguous-runtime-target' WHEN path IS NULL THEN 'screenshot-unavailable'
  WHEN x < 0 OR y < 0 OR w <= 0 OR h <= 0 THEN 'bounding-box-invalid' WHEN x + w > 100 OR y + h > 100 THEN 'bounding-box-out-of-bounds' END AS issue FROM claims LEFT JOIN k USING (state_id, target_id) LEFT JOIN screenshots USING (state_id)),
p AS (SELECT *, status IN ('corroborated', 'runtime', 'runtime-only') AS publishable, CASE kind WHEN 'goal' THEN 1 WHEN 'route' THEN 2 WHEN 'action' THEN 3 WHEN 'input' THEN 4 WHEN 'outcome' THEN 5 WHEN 'limitation' THEN 6 ELSE 9 END AS kind_rank FROM claims)
"""


@query(_CLAIMS + "SELECT * FROM m")
def claim_targets(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.claim_targets(T.frame(spark, d, "claims"), T.frame(spark, d, "targets"), T.frame(spark, d, "screenshots"), (100, 100))


@query(_CLAIMS + """SELECT feature_id, callouts, claims, CASE WHEN bad THEN 'ambiguous' WHEN callouts > 0 AND issues > 0 THEN 'partially-mapped' WHEN callouts >= claims AND callouts > 0 THEN 'mapped' WHEN callouts > 0 THEN 'partially-mapped' WHEN shots THEN 'screenshot-unavailable' ELSE 'no-visual-target' END AS status
FROM (SELECT feature_id, count(*) FILTER (issue IS NULL) AS callouts, count(*) AS claims, count(issue) AS issues, coalesce(bool_or(issue IN ('ambiguous-runtime-target', 'claim-ineligible')), false) AS bad, coalesce(bool_or(issue = 'screenshot-unavailable'), false) AS shots FROM m GROUP BY feature_id)""")
def step_status(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.step_status(knowledge.claim_targets(T.frame(spark, d, "claims"), T.frame(spark, d, "targets"), T.frame(spark, d, "screenshots"), (100, 100)))


@query(_CLAIMS + "SELECT claim_id, publishable, kind_rank, row_number() OVER (ORDER BY kind_rank, text, claim_id) AS place FROM p")
def claim_order(spark: SparkSession, d: str) -> DataFrame:
    rows = knowledge.publishable(T.frame(spark, d, "claims"))
    return ordering.total_order(rows, [F.col("kind_rank"), F.col("text"), F.col("claim_id")]).select("claim_id", "publishable", "kind_rank", "place")


@query(_CLAIMS + """SELECT section, idx, NULL AS claim_id, 'statement-without-claim' AS issue FROM statements WHERE len(claim_ids) = 0
UNION ALL SELECT section, idx, c, CASE WHEN publishable IS NULL THEN 'unknown-claim' ELSE 'claim-not-publishable' END FROM (SELECT section, idx, unnest(claim_ids) AS c FROM statements) LEFT JOIN p ON claim_id = c WHERE publishable IS NOT TRUE
UNION ALL SELECT 'unused', 0, claim_id, 'unused-claim' FROM p WHERE publishable AND claim_id NOT IN (SELECT unnest(claim_ids) FROM statements)""")
def statement_issues(spark: SparkSession, d: str) -> DataFrame:
    statements, claims = T.frame(spark, d, "statements"), T.frame(spark, d, "claims")
    unused = knowledge.unused_claims(statements, claims).select(F.lit("unused").alias("section"), F.lit(0).alias("idx"), "claim_id", F.lit("unused-claim").alias("issue"))
    return knowledge.statement_issues(statements, claims).unionByName(unused)


@query(_CLAIMS + """SELECT feature_id, count(*) AS claims, count(*) FILTER (publishable) AS publishable, count(*) FILTER (kind = 'limitation') AS limitations, coalesce(bool_or(kind = 'action' AND transition_id IS NOT NULL), false) AND coalesce(bool_or(kind = 'outcome'), false) AS supported,
  CASE WHEN bool_or(status = 'corroborated') THEN 'corroborated' WHEN bool_or(status = 'ambiguous') THEN 'ambiguous' WHEN bool_or(status = 'runtime-only') THEN 'runtime-only' ELSE 'static-only' END AS status FROM p GROUP BY feature_id""")
def feature_catalog(spark: SparkSession, d: str) -> DataFrame:
    claims = T.frame(spark, d, "claims")
    status = claims.groupBy("feature_id").agg(evidence.evidence_status(F.collect_set("status")).alias("status"))  # kinds of status
    return knowledge.catalog(claims, T.frame(spark, d, "statements")).join(knowledge.supports_procedure(claims), "feature_id").join(status, "feature_id")


@query(T.with_sql("audits") + """, b AS (SELECT *, lag(action) OVER (PARTITION BY doc_id ORDER BY number) AS before FROM audits)
SELECT doc_id, number, CASE action WHEN 'approved' THEN 'approved' WHEN 'created' THEN 'draft' ELSE 'needs-review' END AS state, CASE action WHEN 'created' THEN before IS NULL WHEN 'approved' THEN coalesce(before = 'edited', false) ELSE before IS NOT NULL END AS legal FROM b""")
def review_states(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.review(T.frame(spark, d, "audits")).select("doc_id", "number", "state", "legal")


@query(_CLAIMS + "SELECT doc_id, number, CASE WHEN action <> 'approved' THEN 'not-approved' WHEN status <> 'passed' THEN 'validation-failed' WHEN warnings > 0 THEN 'open-warnings' END AS refusal FROM audits QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY number DESC) = 1")
def export_gate(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.export_gate(T.frame(spark, d, "audits"))


@query(T.with_sql("titles") + r""", s AS (SELECT id, coalesce(nullif(trim(regexp_replace(lower(strip_accents(coalesce(title, ''))), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'document') AS name FROM titles) SELECT id, CASE WHEN name = 'con' THEN 'document-con' ELSE name END AS name FROM s""")
def export_names(spark: SparkSession, d: str) -> DataFrame:
    return T.frame(spark, d, "titles").select("id", N.export_filename("title").alias("name"))


@query(T.with_sql("globs") + r""" SELECT id, CASE WHEN len(string_split(pattern, '*')) > 2 THEN NULL WHEN NOT contains(pattern, '*') THEN CASE WHEN value = pattern THEN '' END
  WHEN starts_with(value, split_part(pattern, '*', 1)) AND ends_with(value, split_part(pattern, '*', 2)) AND length(value) >= length(pattern) - 1 THEN value[length(split_part(pattern, '*', 1)) + 1 : length(value) - length(split_part(pattern, '*', 2))] END AS star FROM globs""")
def pattern_stars(spark: SparkSession, d: str) -> DataFrame:
    return T.frame(spark, d, "globs").select("id", N.fits_pattern(F.col("value"), F.col("pattern")).alias("star"))


def queries() -> dict[str, Query]:
    return {name: function for name, (function, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FOUND.items()}
