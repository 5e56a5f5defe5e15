"""Queries of the product evidence graph, of traces and of chains over the given tables, each with its SQL.

The tables stand in for the manifests of an application, each for one: part for components with their elements and the
components that they render, supplier for callables, lineitem for calls, pages for routes, customer for navigation, labels for
actions, events for requests, orders for documents with their operations, documents for executions, nation for resolved symbols
and region for failed ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.urls import application_path
from tracelake.operators import evidence_graph, graph, modules, ordering
from tracelake.sources.tables import ENDPOINTS, containment, table

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, tuple[Query, str]] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def keep(function: Query) -> Query:
        FOUND[function.__name__] = (function, sql)
        return function

    return keep


_FILE = "concat('parts/', cast(floor({0} / 100) as bigint), '.tsx')"
_PART = "concat('Part', cast(floor({0} / 2) as bigint))"
_SPAN = "concat({0}, ':', {1}, '-', {2})"


def _at(file: str, first: str, last: str | None = None) -> str:
    return _SPAN.format(file, first, last or first)


def manifests(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The given tables as the manifests of MANIFESTS, one scan each."""
    part, page, doc = _FILE.format("p_partkey"), _FILE.format("page_id"), _FILE.format("doc_id")
    div, button = _at(part, "p_partkey", "p_partkey + 5"), _at(part, "p_partkey", "p_partkey + 2")
    render = "named_struct('local_name', {0}, 'expression', {1}, 'file', " + part + ", 'at', {2})"
    none = _at(part, "0")
    components = table(spark, d, "part").selectExpr(
        "p_partkey as place", f"{_PART.format('p_partkey')} as name", f"{part} as file", f"{_at(part, 'p_partkey')} as at", "'named' as export_status",
        f"array(named_struct('at', {div}, 'name', 'div', 'text', cast(null as string), 'parent_at', cast(null as string)), named_struct('at', {button}, 'name', 'button', 'text', p_name, 'parent_at', {div})) as elements",
        f"""filter(array(if(p_size <= 20, {render.format(_PART.format('p_partkey'), _PART.format('p_partkey'), _at(part, 'p_partkey'))}, null), {render.format("concat('Part', p_size)", "concat('Part', p_size)", none)},
        if(p_size > 40, {render.format('p_brand', "concat(p_brand, '.Item')", none)}, null), if(p_size < 25, {render.format("concat('Lib', p_size)", "concat('Lib', p_size)", none)}, null)), x -> x is not null) as renders""",
    )
    operation = "named_struct('type', {0}, 'name', {1}, 'at', concat('gql/', o_orderkey, '.ts:2-2'))"
    return {
        "components": components,
        "callables": table(spark, d, "supplier").selectExpr("cast(s_suppkey as string) as id", "concat('s', s_suppkey) as name", f"{_at(chr(39) + 'suppliers.ts' + chr(39), 's_suppkey')} as at", "'function' as kind"),
        "calls": table(spark, d, "lineitem").selectExpr(
            "l_orderkey * 8 + l_linenumber as place", "cast(l_suppkey as string) as caller", "case l_returnflag when 'A' then 'local' when 'N' then 'imported' else 'member-expression' end as binding", "cast(l_partkey as string) as callee",
            "concat('Lib', l_linenumber) as local_name", "'lib' as source", "concat('a.m', l_linenumber) as expression", "if(l_linestatus = 'F', 'F.ts', 'O.ts') as file", "concat('calls/', l_orderkey, '.ts:', l_linenumber, '-', l_linenumber) as at",
        ),
        "routes": table(spark, d, "pages").withColumn("path", application_path(F.col("url"))).selectExpr(
            "page_id as place", "'file-system' as source", "concat('app/', page_id, '/page.tsx') as file", "concat('app/', page_id, '/page.tsx:1-1') as at", "path", "if(contains(url, '#'), 'dynamic', 'static') as path_kind", f"{_PART.format('page_id')} as component", "'parts/0.tsx' as component_file",
            f"if(contains(url, '?'), 'parts/0.tsx:0-0', {_at(page, 'page_id')}) as component_at", "if(contains(url, '&'), 'lazy', null) as issue", "'Loaded component is dynamic' as issue_reason",
        ),
        "navigations": table(spark, d, "customer").selectExpr("c_custkey as place", "concat('nav.tsx:', c_custkey, '-', c_custkey) as at", "'a' as element", "c_name as label", "concat('/en/', c_custkey) as destination", "if(c_acctbal < 0, 'dynamic', 'static') as destination_kind"),
        "actions": table(spark, d, "labels").selectExpr(
            "doc_id as place", f"{_PART.format('doc_id')} as component", f"{_at(doc, 'doc_id', 'doc_id + 2')} as element_at", "'onClick' as event", f"{_at(doc, 'doc_id')} as event_at", f"{doc} as file",
            "case when toxic = 1 then 'inline' when quality = 1 then 'local' when quality = 0 then 'imported' else 'dynamic' end as binding", "concat('s', doc_id) as handler", "concat('suppliers.ts:', doc_id, '-', doc_id) as handler_at", "'lib' as handler_source", "'() => run()' as expression",
        ),
        "requests": table(spark, d, "events").selectExpr("event_id as place", "concat('api.ts:', event_id, '-', event_id) as at", "upper(event_type) as method", "concat('/u/', user_id) as url", "cast(user_id as string) as caller"),
        "documents": table(spark, d, "orders").selectExpr(
            "cast(o_orderkey as string) as id", "o_orderpriority as name", "concat('gql/', o_orderkey, '.ts:1-1') as at", "if(o_orderstatus = 'F', 'ok', 'dynamic') as status",
            f"""filter(array({operation.format("'query'", "concat('q', o_orderkey)")}, if(o_totalprice > 250000, {operation.format("'query'", "'second'")}, null), if(o_totalprice > 400000, {operation.format("'mutation'", "cast(null as string)")}, null)), x -> x is not null) as operations""",
        ),
        "executions": table(spark, d, "documents").selectExpr("doc_id as place", "concat('run.ts:', doc_id, '-', doc_id) as at", "coalesce(lang, 'x') as phase", "coalesce(source, 'y') as executor", "'query' as type", "cast(doc_id as string) as caller", "if(lang = 'en', 'dynamic', 'static') as document_kind", "cast(n_chars as string) as document", "'gql' as expression"),
        "symbols": table(spark, d, "nation").selectExpr(
            "if(n_regionkey = 4, 'namespace-member', 'import') as kind", "case n_regionkey when 3 then 'parts/0.tsx' when 2 then 'O.ts' else 'F.ts' end as file", "concat('Lib', n_nationkey) as local_name", "'lib' as source", "concat('calls/', n_nationkey * 100, '.ts:1-1') as usage_at",
            "if(n_regionkey = 3, 'component', 'callable') as target_kind", "cast(n_nationkey * 7 as string) as target_id", f"{_at(_FILE.format('n_nationkey'), 'n_nationkey')} as target_at",
        ),
        "failures": table(spark, d, "region").selectExpr("cast(r_regionkey as bigint) as place", "'import' as kind", "'O.ts' as file", "concat('Lib', r_regionkey) as local_name", "'lib' as source", "lower(r_name) as reason"),
    }


_E = "replace(replace(replace(url_encode({0}), '%2F', '/'), '%28', '('), '%29', ')')"
_GRAPH = f"""
WITH c AS (SELECT p_partkey AS k, 'parts/' || (p_partkey // 100) || '.tsx' AS file, 'Part' || (p_partkey // 2) AS name, file || ':' || k || '-' || k AS loc, file || ':' || k || '-' || (k + 5) AS div, file || ':' || k || '-' || (k + 2) AS button, p_name, p_size, p_brand FROM part),
cid AS (SELECT *, 'component:' || loc || ':' || name AS id FROM c),
fn AS (SELECT s_suppkey AS k, 's' || s_suppkey AS name, 'callable:' || s_suppkey AS id, 'suppliers.ts:' || s_suppkey || '-' || s_suppkey AS loc FROM supplier),
paths AS (SELECT page_id, url, CASE WHEN p = '' THEN '/' ELSE p END AS path FROM (SELECT page_id, url, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '(.)/+$', '\\1') AS p FROM pages)),
route AS (SELECT page_id AS k, url, path, 'app/' || page_id || '/page.tsx:1-1' AS loc, 'route:' || loc || ':' || {_E.format("'file-system:' || path")} AS id, 'Part' || (page_id // 2) AS component, CASE WHEN contains(url, '?') THEN 'parts/0.tsx:0-0' ELSE 'parts/' || (page_id // 100) || '.tsx:' || page_id || '-' || page_id END AS component_at FROM paths),
nav AS (SELECT c_custkey AS k, c_name, c_acctbal < 0 AS dynamic, '/en/' || c_custkey AS dest, 'nav.tsx:' || c_custkey || '-' || c_custkey AS loc, 'navigation:' || loc || ':' || {_E.format("'a:' || dest")} AS id FROM customer),
act AS (SELECT l.*, c.id AS component, c.button, 'parts/' || (doc_id // 100) || '.tsx' AS file, file || ':' || doc_id || '-' || doc_id AS loc, 'ui-event:' || loc || ':onClick' AS id, 'ui-element:' || c.button || ':button' AS element,
  CASE WHEN toxic = 1 THEN 'inline' WHEN quality = 1 THEN 'local' WHEN quality = 0 THEN 'imported' ELSE 'dynamic' END AS binding FROM labels l JOIN cid c ON c.k = doc_id),
req AS (SELECT event_id AS k, user_id, upper(event_type) AS method, '/u/' || user_id AS url, 'api.ts:' || event_id || '-' || event_id AS loc, 'http-request:' || loc || ':' || {_E.format("method || ':' || url")} AS id FROM events),
gd AS (SELECT *, 'graphql-document:' || o_orderkey AS id, 'gql/' || o_orderkey || '.ts:1-1' AS loc FROM orders),
op AS (SELECT id AS doc, o_orderkey, 'gql/' || o_orderkey || '.ts:2-2' AS loc, unnest([{{'i': 0, 't': 'query', 'n': 'q' || o_orderkey}}] || CASE WHEN o_totalprice > 250000 THEN [{{'i': 1, 't': 'query', 'n': 'second'}}] ELSE [] END || CASE WHEN o_totalprice > 400000 THEN [{{'i': 2, 't': 'mutation', 'n': NULL}}] ELSE [] END) AS x FROM gd WHERE o_orderstatus = 'F'),
opid AS (SELECT *, doc || ':operation:' || x.i || ':' || x.t || ':' || coalesce(x.n, 'anonymous') AS id FROM op),
ex AS (SELECT doc_id AS k, coalesce(lang, 'x') AS phase, coalesce(source, 'y') AS executor, coalesce(lang = 'en', false) AS dynamic, n_chars, 'run.ts:' || doc_id || '-' || doc_id AS loc, 'graphql-execution:' || loc || ':' || {_E.format("phase || ':' || executor")} AS id FROM documents),
sym AS (SELECT CASE WHEN n_regionkey = 4 THEN 'namespace-member' ELSE 'import' END AS kind, CASE n_regionkey WHEN 3 THEN 'parts/0.tsx' WHEN 2 THEN 'O.ts' ELSE 'F.ts' END AS file, 'Lib' || n_nationkey AS name, 'calls/' || (n_nationkey * 100) || '.ts:1-1' AS usage_at,
  CASE WHEN n_regionkey <> 3 THEN (SELECT id FROM fn WHERE fn.k = n_nationkey * 7) END AS fn, (SELECT id FROM cid WHERE cid.k = n_nationkey) AS component, 'parts/' || (n_nationkey // 100) || '.tsx:' || n_nationkey || '-' || n_nationkey AS loc FROM nation),
failed AS (SELECT 'Lib' || r_regionkey AS name, lower(r_name) AS reason FROM region),
call AS (SELECT l_orderkey * 8 + l_linenumber AS k, 'callable:' || l_suppkey AS src, l_suppkey, l_partkey, l_returnflag AS flag, CASE WHEN l_linestatus = 'F' THEN 'F.ts' ELSE 'O.ts' END AS file, 'Lib' || l_linenumber AS name, 'a.m' || l_linenumber AS expression, 'calls/' || l_orderkey || '.ts:' || l_linenumber || '-' || l_linenumber AS loc
  FROM lineitem WHERE l_suppkey IN (SELECT k FROM fn)),
called AS (SELECT c.*, CASE flag WHEN 'A' THEN (SELECT id FROM fn WHERE fn.k = c.l_partkey) WHEN 'N' THEN i.fn ELSE n.fn END AS dst, CASE flag WHEN 'N' THEN i.loc WHEN 'R' THEN n.loc END AS through
  FROM call c LEFT JOIN sym i ON flag = 'N' AND i.kind = 'import' AND i.file = c.file AND i.name = c.name LEFT JOIN sym n ON flag = 'R' AND n.kind = 'namespace-member' AND n.usage_at = c.loc),
r AS (SELECT id AS src, file, loc, k, name AS self, p_size, p_brand FROM cid),
rendered AS (
  SELECT src, src AS dst, 'ui-structure:' || loc || ':resolved' AS e, loc AS o, NULL AS reference, NULL AS reason, NULL AS source, k, 0 AS i FROM r WHERE p_size <= 20
  UNION ALL SELECT src, NULL, NULL, NULL, 'Part' || p_size, 'Rendered component reference could not be resolved', 'ui-structure', k, 1 FROM r
  UNION ALL SELECT src, NULL, NULL, NULL, p_brand || '.Item', 'JSX member component could not be uniquely resolved', 'ui-structure', k, 2 FROM r WHERE p_size > 40
  UNION ALL SELECT src, component, 'module-resolution:' || s.loc || ':resolved,ui-structure:' || r.file || ':0-0:resolved', NULL, 'Lib' || p_size, CASE WHEN s.name IS NOT NULL THEN 'Resolved render symbol has no matching UI component' ELSE 'Rendered component reference could not be resolved' END, CASE WHEN s.name IS NOT NULL THEN 'module-resolution' ELSE 'ui-structure' END, k, 3
  FROM r LEFT JOIN sym s ON s.kind = 'import' AND s.file = r.file AND s.name = 'Lib' || p_size WHERE p_size < 25),
n_static AS (SELECT path, count(*) AS n, min(id) AS id FROM route WHERE NOT contains(url, '#') GROUP BY path),
docs_of AS (SELECT ex.*, gd.id AS doc FROM ex LEFT JOIN gd ON gd.o_orderkey = ex.n_chars AND NOT ex.dynamic),
ops_of AS (SELECT doc, count(*) AS n, min(id) AS id FROM opid WHERE x.t = 'query' GROUP BY doc),
node AS (
  SELECT id, 'component' AS type, name AS label, loc, 'ui-structure' AS source FROM cid UNION ALL SELECT 'ui-element:' || div || ':div', 'ui-element', 'div', div, 'ui-structure' FROM c UNION ALL SELECT 'ui-element:' || button || ':button', 'ui-element', 'button "' || p_name || '"', button, 'ui-structure' FROM c
  UNION ALL SELECT id, 'callable', name, loc, 'function-call' FROM fn UNION ALL SELECT id, 'route', path, loc, 'route-navigation' FROM route UNION ALL SELECT id, 'navigation', c_name, loc, 'route-navigation' FROM nav UNION ALL SELECT id, 'ui-event', 'onClick', loc, 'action-binding' FROM act
  UNION ALL SELECT id, 'http-request', method || ' ' || url, loc, 'http-request' FROM req UNION ALL SELECT id, 'graphql-document', o_orderpriority, loc, 'graphql-operation' FROM gd UNION ALL SELECT id, 'graphql-operation', x.t || ' ' || coalesce(x.n, '<anonymous>'), loc, 'graphql-operation' FROM opid
  UNION ALL SELECT id, 'graphql-execution', executor, loc, 'graphql-operation' FROM ex),
raw AS (
  SELECT 'COMPONENT_RENDERS_COMPONENT' AS type, src, dst, string_agg(e, ',' ORDER BY e) AS evidence, 0 AS k FROM rendered WHERE dst IS NOT NULL GROUP BY src, dst
  UNION ALL SELECT 'CONTAINS_ELEMENT', id, 'ui-element:' || div || ':div', 'ui-structure:' || div || ':direct', 0 FROM cid UNION ALL SELECT 'CONTAINS_ELEMENT', 'ui-element:' || div || ':div', 'ui-element:' || button || ':button', 'ui-structure:' || button || ':direct', 0 FROM c
  UNION ALL SELECT 'ROUTE_RENDERS_COMPONENT', route.id, cid.id, 'route-navigation:' || component_at || ':resolved', 0 FROM route JOIN cid ON cid.name = component AND cid.loc = component_at
  UNION ALL SELECT 'NAVIGATES_TO', nav.id, n_static.id, 'route-navigation:' || loc || ':resolved', 0 FROM nav JOIN n_static ON dest = path AND n = 1 AND NOT dynamic
  UNION ALL SELECT 'HAS_EVENT', element, id, 'action-binding:' || loc || ':direct', 0 FROM act UNION ALL SELECT 'BINDS_TO', act.id, fn.id, 'action-binding:' || fn.loc || ':resolved', 0 FROM act JOIN fn ON fn.k = doc_id AND binding = 'local'
  UNION ALL SELECT 'CALLS', src, dst, CASE WHEN through IS NULL THEN 'function-call:' || loc || ':direct' ELSE 'function-call:' || loc || ':direct,module-resolution:' || through || ':resolved' END, k FROM called WHERE dst IS NOT NULL
  UNION ALL SELECT 'PERFORMS_HTTP_REQUEST', 'callable:' || user_id, id, 'http-request:' || loc || ':direct', 0 FROM req WHERE user_id IN (SELECT k FROM fn)
  UNION ALL SELECT 'DEFINES_OPERATION', doc, id, 'graphql-operation:' || loc || ':direct', 0 FROM opid UNION ALL SELECT 'PERFORMS_GRAPHQL_EXECUTION', 'callable:' || k, id, 'graphql-operation:' || loc || ':direct', 0 FROM ex WHERE k IN (SELECT k FROM fn)
  UNION ALL SELECT 'USES_DOCUMENT', id, doc, 'graphql-operation:' || loc || ':resolved', 0 FROM docs_of WHERE doc IS NOT NULL
  UNION ALL SELECT 'EXECUTES_OPERATION', d.id, o.id, 'graphql-operation:' || loc || ':resolved', 0 FROM docs_of d JOIN ops_of o USING (doc) WHERE n = 1),
edge AS (SELECT 'edge:' || type || ':' || src || '->' || dst || CASE WHEN n > 1 THEN '#' || n ELSE '' END AS id, type, src, dst, evidence FROM (SELECT *, row_number() OVER (PARTITION BY type, src, dst ORDER BY k, evidence) AS n FROM raw)),
open AS (
  SELECT 'COMPONENT_RENDERS_COMPONENT' AS type, src, reference, reason, source, k, i FROM rendered WHERE dst IS NULL
  UNION ALL SELECT 'ROUTE_RENDERS_COMPONENT', id, component, 'Associated route component is not a same-file UI component', 'route-navigation', k, 0 FROM route WHERE (component, component_at) NOT IN (SELECT (name, loc) FROM cid) AND (SELECT count(*) FROM cid WHERE cid.file = 'parts/0.tsx' AND cid.name = component) <> 1
  UNION ALL SELECT 'ROUTE_RENDERS_COMPONENT', id, 'lazy', 'Loaded component is dynamic', 'route-navigation', k, 1 FROM route WHERE contains(url, '&')
  UNION ALL SELECT 'NAVIGATES_TO', nav.id, dest, CASE WHEN dynamic THEN 'Navigation destination is dynamic' WHEN n > 1 THEN 'Multiple routes have this path' ELSE 'No discovered route has this path' END, 'route-navigation', k, 0 FROM nav LEFT JOIN n_static ON dest = path WHERE dynamic OR coalesce(n, 0) <> 1
  UNION ALL SELECT 'BINDS_TO', id, CASE binding WHEN 'local' THEN 's' || doc_id WHEN 'imported' THEN 's' || doc_id || ' from lib' ELSE '() => run()' END, CASE binding WHEN 'local' THEN 'Local handler has no matching callable identity' WHEN 'inline' THEN 'Inline handler has no matching callable identity' WHEN 'imported' THEN 'Imported handler did not resolve to a callable' ELSE 'Handler binding is dynamic' END,
    CASE binding WHEN 'imported' THEN 'module-resolution' ELSE 'action-binding' END, doc_id, 0 FROM act WHERE NOT (binding = 'local' AND doc_id IN (SELECT k FROM fn))
  UNION ALL SELECT 'CALLS', src, CASE flag WHEN 'N' THEN name || ' from lib' ELSE expression END, CASE WHEN flag = 'R' THEN 'Member call could not be resolved as a local namespace import' WHEN reason IS NOT NULL THEN 'Module resolution failed: ' || reason ELSE 'Imported call did not resolve to a callable' END, 'module-resolution', k, 0
    FROM called LEFT JOIN failed USING (name) WHERE dst IS NULL AND flag <> 'A' AND (flag <> 'N' OR failed.name IS NULL OR file = 'O.ts')
  UNION ALL SELECT 'CALLS', src, name || ' from lib', 'Imported call did not resolve to a callable', 'module-resolution', k, 0 FROM called JOIN failed USING (name) WHERE dst IS NULL AND flag = 'N' AND file <> 'O.ts'
  UNION ALL SELECT 'USES_DOCUMENT', id, CASE WHEN dynamic THEN 'gql' ELSE n_chars::VARCHAR END, CASE WHEN dynamic THEN 'GraphQL document reference is dynamic' ELSE 'Referenced GraphQL document is absent' END, 'graphql-operation', k, 0 FROM docs_of WHERE doc IS NULL
  UNION ALL SELECT 'EXECUTES_OPERATION', d.id, 'query', CASE WHEN n > 1 THEN 'Document has multiple matching operations' ELSE 'Document has no matching operation' END, 'graphql-operation', k, 0 FROM docs_of d LEFT JOIN ops_of o USING (doc) WHERE doc IS NOT NULL AND coalesce(n, 0) <> 1),
unresolved AS (SELECT 'unresolved:' || type || ':' || src || ':' || {_E.format("reference")} || CASE WHEN n > 1 THEN '#' || n ELSE '' END AS id, type, src, reference, reason, source FROM (SELECT *, row_number() OVER (PARTITION BY type, src, reference ORDER BY k, i, reason) AS n FROM open))
"""


@query(_GRAPH + "SELECT id, type, label, loc AS location, source FROM node")
def evidence_graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Reads all tables that `manifests` names, each once."""
    return evidence_graph.build_graph(manifests(spark, d), "nodes").nodes


@query(_GRAPH + "SELECT * FROM edge")
def evidence_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = evidence_graph.build_graph(manifests(spark, d), "edges").edges
    told = F.transform("evidence", lambda x: F.concat_ws(":", x["source"], x["at"], x["strength"]))
    return edges.withColumn("evidence", F.array_join(told, ","))


@query(_GRAPH + "SELECT * FROM unresolved")
def evidence_graph_unresolved(spark: SparkSession, d: str) -> DataFrame:
    return evidence_graph.build_graph(manifests(spark, d), "unresolved").unresolved


_CONTAINED = """e AS (SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst FROM nation UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer UNION ALL SELECT 'customer:' || o_custkey, 'orders:' || o_orderkey FROM orders)"""


@query(f"""WITH RECURSIVE {_CONTAINED}, l AS (SELECT 'orders:' || o_orderkey AS src, 'nation:' || (o_orderkey // 100) AS dst FROM orders WHERE o_orderkey // 100 IN (SELECT n_nationkey FROM nation)),
a AS (SELECT src || '>' || dst AS id, src, dst FROM e UNION ALL SELECT src || '>' || dst, src, dst FROM l),
t AS (SELECT 'region:' || r_regionkey AS root, 'region:' || r_regionkey AS node, 0 AS depth FROM region UNION SELECT root, dst, depth + 1 FROM t JOIN a ON node = src WHERE depth < 8),
m AS (SELECT root, node, min(depth) AS depth FROM t GROUP BY ALL)
SELECT root, node, depth, (SELECT count(*) FROM a JOIN m p ON p.node = a.src WHERE a.dst = m.node AND p.root = m.root AND p.depth = m.depth - 1) AS ways FROM m""")
def trace_edges(spark: SparkSession, d: str) -> DataFrame:
    """Every node that a region leads to, with the edge that discovers it, over the containment graph and edges from orders
    back to nations, which make circles. ways: how many edges from the level before might have; via is one of them, checked
    by a join."""
    _, edges = containment(spark, d)
    back = table(spark, d, "orders").selectExpr("concat('orders:', o_orderkey) as src", "cast(floor(o_orderkey / 100) as bigint) as n").join(table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n")), "n")
    back = back.select("src", F.concat(F.lit("nation:"), F.col("n").cast("string")).alias("dst"))
    edges = edges.select("id", "src", "dst").unionByName(back.select(F.concat("src", F.lit(">"), "dst").alias("id"), "src", "dst"))
    edges = graph.cut(edges, "edges")
    roots = table(spark, d, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("node"))
    found = graph.cut(graph.trace_via(edges, roots), "found")
    before = found.select("root", F.col("node").alias("src"), (F.col("depth") + 1).alias("depth")).join(edges, "src")
    ways = before.groupBy("root", F.col("dst").alias("node"), "depth").agg(F.count(F.lit(1)).alias("ways"), F.collect_set("id").alias("ids"))  # edges that lead to one node from one level
    rows = found.join(ways, ["root", "node", "depth"], "left").filter("via is null or array_contains(ids, via)")
    return rows.select("root", "node", "depth", F.coalesce("ways", F.lit(0).cast("long")).alias("ways"))


@query("""WITH n AS (SELECT p_partkey AS k, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i, p_brand FROM part), c AS (SELECT *, sum(CASE WHEN p_size <= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand ORDER BY i) - CASE WHEN p_size <= 3 THEN 1 ELSE 0 END AS g FROM n),
last AS (SELECT p_brand, g, max(i) AS i FROM c GROUP BY ALL), stop AS (SELECT p_brand, g, i, p_size <= 3 AS real FROM c JOIN last USING (p_brand, g, i))
SELECT c.p_brand AS file, 'd' || c.k AS name, CASE WHEN real THEN 'd' || (SELECT k FROM c x WHERE x.p_brand = c.p_brand AND x.i = stop.i) END AS declaration, CASE WHEN real THEN stop.i - c.i END AS wrappers FROM c JOIN stop ON stop.p_brand = c.p_brand AND stop.g = c.g""")
def wrapped_declarations(spark: SparkSession, d: str) -> DataFrame:
    """Declarations are parts, files their brands: a part wraps the next one of its brand unless it is small; the last of a
    brand wraps one that is not there."""
    follows = F.lead("p_partkey").over(ordering.W.partitionBy("p_brand").orderBy("p_partkey"))
    rows = table(spark, d, "part").select(F.col("p_brand").alias("file"), F.concat(F.lit("d"), F.col("p_partkey").cast("string")).alias("name"), F.when(F.col("p_size") > 3, F.concat(F.lit("d"), F.coalesce(follows, F.lit(-1)).cast("string"))).alias("wrapped"))
    return modules.wrapped_declarations(rows)


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS name FROM part)
SELECT p_partkey, name, row_number() OVER (ORDER BY lower(name), name DESC, p_partkey) AS place FROM p""")
def part_places(spark: SparkSession, d: str) -> DataFrame:
    """The place of each part by name in the order of the Unicode collation (small letters before capitals), then by key."""
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 25, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"))
    return ordering.total_order(rows, [ordering.collated(F.col("name")), F.col("p_partkey")])


@query(r"""WITH p AS (SELECT CASE WHEN p = '' THEN '/' ELSE p END AS path FROM (SELECT regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '(.)/+$', '\1') AS p FROM pages))
SELECT 'duplicate-node' AS rule, 'page:' || path AS subject FROM p GROUP BY path HAVING count(*) > 1
UNION ALL SELECT 'missing-target', 'orders:' || n_chars FROM documents WHERE n_chars NOT IN (SELECT o_orderkey FROM orders)""")
def graph_violations(spark: SparkSession, d: str) -> DataFrame:
    """The whole containment graph with pages by their path and documents that mention the order of their length: pages that
    share a path and lengths that are no order are the violations."""
    nodes, edges = containment(spark, d)
    docs = table(spark, d, "documents").select(F.concat(F.lit("documents:"), F.col("doc_id").cast("string")).alias("src"), F.concat(F.lit("orders:"), F.col("n_chars").cast("string")).alias("dst"))
    pages = table(spark, d, "pages").select(F.concat(F.lit("page:"), application_path(F.col("url"))).alias("id"), F.lit("page").alias("type"))
    nodes = nodes.unionByName(pages).unionByName(docs.select(F.col("src").alias("id"), F.lit("documents").alias("type")))
    edges = edges.unionByName(docs.select(F.concat("src", F.lit(">"), "dst").alias("id"), F.lit("MENTIONS").alias("type"), "src", "dst"))
    return graph.violations(nodes, edges, [*ENDPOINTS, ("MENTIONS", "documents", "orders")])


def queries() -> dict[str, Query]:
    return {name: function for name, (function, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FOUND.items()}
