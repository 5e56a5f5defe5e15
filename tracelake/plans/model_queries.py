"""Queries of the feature model, of module resolution and of crawled pages over projections of the given tables, each with the SQL
that it is held against. Small tables that reach every branch stand in for the projections in the tests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators import crawl, features, knowledge, modules, ordering
from tracelake.plans.evidence_queries import _CLASS
from tracelake.plans.projected import Projected

T = Projected({
    "seeds": ("feature_id string, route_id string, navigation_id string, pattern string, place int", "SELECT 'F' || c_custkey, CASE WHEN c_custkey % 5 = 4 THEN NULL ELSE 'r' || c_custkey END, CASE WHEN c_nationkey % 3 = 0 THEN 'v' || c_custkey END, CASE c_custkey % 5 WHEN 0 THEN '/shop/:item' WHEN 1 THEN '/:a/:b' WHEN 2 THEN 'x/:id' WHEN 3 THEN '/' END, c_custkey FROM {customer}"),
    "links": ("id string, type string, src string, dst string", "SELECT 'a' || c_custkey, 'ROUTE_RENDERS_COMPONENT', 'r' || c_custkey, 'C' || c_nationkey FROM {customer} UNION ALL SELECT 'b' || s_suppkey, 'CONTAINS_ELEMENT', 'C' || s_nationkey, 'u' || s_suppkey FROM {supplier} UNION ALL SELECT 'c' || s_suppkey, 'HAS_EVENT', 'u' || s_suppkey, 'e' || s_suppkey FROM {supplier} UNION ALL SELECT 'd' || s_suppkey, 'BINDS_TO', 'e' || s_suppkey, 'f' || s_suppkey FROM {supplier} UNION ALL SELECT 'e' || s_suppkey, 'CALLS', 'f' || s_suppkey, 'f' || (s_suppkey * 2 % 97) FROM {supplier} UNION ALL SELECT 'f' || s_suppkey, CASE WHEN s_nationkey < 10 THEN 'PERFORMS_HTTP_REQUEST' ELSE 'PERFORMS_GRAPHQL_EXECUTION' END, 'f' || s_suppkey, 'x' || s_suppkey FROM {supplier} UNION ALL SELECT 'g' || s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'USES_DOCUMENT' ELSE 'EXECUTES_OPERATION' END, 'x' || s_suppkey, 'd' || s_suppkey FROM {supplier} UNION ALL SELECT 'h' || c_custkey, 'NAVIGATES_TO', 'v' || c_custkey, 'r' || (c_custkey + 1) FROM {customer} UNION ALL SELECT 'i' || s_suppkey, 'NAVIGATES_TO', 'u' || s_suppkey, 'r' || s_suppkey FROM {supplier}"),
    "results": ("result_id string, status string", "SELECT 'R' || o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'corroborated' WHEN 'O' THEN 'ambiguous' ELSE 'static-only' END FROM {orders}"),
    "refs": ("result_id string, kind string, ref string", "SELECT 'R' || o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'node' WHEN 1 THEN 'state' ELSE 'transition' END, 'z' || o_custkey FROM {orders} UNION ALL SELECT 'R' || o_orderkey, 'node', 'z' || (o_orderkey % 500) FROM {orders}"),
    "parts": ("feature_id string, kind string, ref string", "SELECT 'F' || c_nationkey, CASE c_custkey % 3 WHEN 0 THEN 'node' WHEN 1 THEN 'state' ELSE 'transition' END, CASE c_custkey % 3 WHEN 1 THEN 's' ELSE 'z' END || c_custkey FROM {customer}"),
    "states": ("feature_id string, state_id string, place int", "SELECT 'F' || CAST(floor(page_id / 2) AS BIGINT), 's' || page_id, page_id FROM {pages}"),
    "selected": ("result_id string, route_id string, state_id string, path string", "SELECT 'A' || page_id, 'r' || CASE WHEN page_id % 9 = 0 THEN 0 ELSE CAST(floor(page_id / 2) AS BIGINT) END, 's' || page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) FROM {pages}"),
    "observed": ("feature_id string, place int, label string, evidence_id string", "SELECT 'F' || CAST(floor(event_id / 2) AS BIGINT), event_id, CASE WHEN value > 70 THEN NULL WHEN value > 30 THEN '  ' || event_type || '  ' || event_type ELSE event_type || ' ' || event_type END, 'e' || event_id FROM {events}"),
    "candidates": ("feature_id string, source string, place int, name string, evidence_id string, detail string", "SELECT 'F' || CAST(floor(event_id / 4) AS BIGINT), CASE event_type WHEN 'click' THEN 'component' WHEN 'view' THEN 'runtime-heading' WHEN 'purchase' THEN 'route-identity' WHEN 'error' THEN 'navigation-label' ELSE 'runtime-name' END, user_id, CASE WHEN value < 20 THEN '' WHEN value < 30 THEN NULL ELSE ' N' || event_id || ' ' END, 'e' || event_id, CASE WHEN event_type = 'purchase' THEN 'route-bound-value' END FROM {events}"),
    "moves": ("id string, src string, dst string, label string, after_url string", "SELECT 't' || o_orderkey, 's' || o_custkey, CASE WHEN o_orderstatus <> 'P' THEN 's' || (o_orderkey % 300) END, CASE WHEN o_totalprice > 300000 THEN NULL WHEN o_totalprice > 200000 THEN '' ELSE 'Go ' || o_orderpriority END, 'https://a.test/' || o_orderkey FROM {orders}"),
    "menus": ("feature_id string, node_id string, label string, node_label string, destination string", "SELECT 'F' || s_nationkey, 'v' || s_suppkey, CASE WHEN s_acctbal > 6000 THEN NULL WHEN s_acctbal > 3000 THEN '' ELSE s_name END, 'nav ' || s_name, CASE WHEN s_nationkey > 5 THEN '/shop' END FROM {supplier}"),
    "shells": ("feature_id string, route_id string, pattern string, key string", "SELECT 'F' || c_custkey, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'r' || c_nationkey END, CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_nationkey % 2 = 0 THEN '/shop/:item' ELSE 'about' END, c_mktsegment || CAST(floor(c_acctbal / 4000) AS BIGINT) FROM {customer}"),
    "evidence": ("kind string, evidence_id string, detail string", "SELECT 'static-node', 'n' || p_partkey, CASE p_size % 4 WHEN 0 THEN 'component' WHEN 1 THEN 'callable' WHEN 2 THEN 'route' ELSE 'ui-event' END FROM {part} UNION ALL SELECT 'static-edge', 'n' || s_suppkey, CAST(NULL AS STRING) FROM {supplier} UNION ALL SELECT 'runtime-state', 's' || c_custkey, CAST(NULL AS STRING) FROM {customer} UNION ALL SELECT 'runtime-transition', 't' || s_suppkey, CAST(NULL AS STRING) FROM {supplier} UNION ALL SELECT 'reconciliation', 'R' || o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'ambiguous' ELSE 'static-only' END FROM {orders}"),
    "used": ("kind string, evidence_id string", "SELECT 'static-node', 'n' || l_partkey FROM {lineitem} WHERE l_quantity > 45 UNION ALL SELECT 'runtime-state', 's' || o_custkey FROM {orders} WHERE o_totalprice > 400000 UNION ALL SELECT 'reconciliation', 'R' || l_orderkey FROM {lineitem} WHERE l_quantity > 40"),
    "named": ("feature_id string, name string, route string", "SELECT 'F' || c_custkey, CASE WHEN c_nationkey = 3 THEN ' ' WHEN c_nationkey = 4 THEN NULL ELSE c_name END, CASE WHEN c_nationkey > 12 THEN '/' || c_nationkey END FROM {customer} UNION ALL SELECT 'F' || s_suppkey, s_name, CAST(NULL AS STRING) FROM {supplier} WHERE s_nationkey < 5"),
    "reported": ("feature_id string, name string, route string", "SELECT 'F' || c_custkey, c_name, CASE WHEN c_nationkey > 12 THEN '/' || c_nationkey END FROM {customer}"),
    "lines": ("feature_id string, section string, label string, status string", "SELECT 'F' || o_custkey, CASE o_orderstatus WHEN 'F' THEN 'UI' ELSE 'ACTION' END, o_orderpriority || o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'corroborated' END FROM {orders}"),
    "files": ("path string", "SELECT 'src/d' || CAST(floor(p_partkey / 10) AS BIGINT) || '/f' || p_partkey || CASE p_size % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' WHEN 2 THEN '.js' ELSE '.jsx' END FROM {part} UNION ALL SELECT 'src/d' || CAST(floor(p_partkey / 10) AS BIGINT) || '/f' || p_partkey || '.ts' FROM {part} WHERE p_partkey % 3 = 0 UNION ALL SELECT 'src/d' || CAST(floor(p_partkey / 10) AS BIGINT) || '/index.ts' FROM {part} WHERE p_partkey % 10 = 5 UNION ALL SELECT 'packages/p' || s_suppkey || '/index.ts' FROM {supplier} UNION ALL SELECT 'packages/p' || s_suppkey || '/main.ts' FROM {supplier} UNION ALL SELECT 'lib/x' || s_suppkey || '.ts' FROM {supplier}"),
    "imports": ("import_id long, file string, specifier string", "SELECT p_partkey, 'src/d' || CAST(floor(p_partkey / 10) AS BIGINT) || '/main.ts', CASE p_size % 9 WHEN 0 THEN './f' || p_partkey WHEN 1 THEN '../d' || CAST(floor(p_partkey / 10) AS BIGINT) || '/f' || p_partkey WHEN 2 THEN './nothing' WHEN 3 THEN '../../../out' WHEN 4 THEN '@org/p' || (p_partkey % 150) WHEN 5 THEN '@org/p' || (p_partkey % 150) || '/main' WHEN 6 THEN '../d0' WHEN 7 THEN '@lib/x' || (p_partkey % 150) ELSE 'react' END FROM {part} UNION ALL SELECT -1 - n_nationkey, 'c' || n_nationkey || '/sub/main.ts', CASE WHEN n_nationkey % 2 = 0 THEN '@lib/x' || n_nationkey ELSE 'exact' END FROM {nation}"),
    "owners": ("path string, name string, workspaces array<string>, entries array<string>", "SELECT 'packages/p' || s_suppkey || '/package.json', '@org/p' || s_suppkey, {none}, CASE s_suppkey % 3 WHEN 0 THEN {list}('main') WHEN 1 THEN {list}('gone.ts') ELSE {none} END FROM {supplier} UNION ALL SELECT 'packages/t' || s_suppkey || '/package.json', CASE WHEN s_suppkey % 10 = 9 THEN '@org/p' || s_suppkey END, {none}, {none} FROM {supplier} UNION ALL SELECT 'package.json', 'root', {list}('packages/*', 'tools/'), {none} FROM (SELECT min(r_regionkey) AS k FROM {region}) x UNION ALL SELECT 'other/p' || n_nationkey || '/package.json', n_name, {none}, {none} FROM {nation}"),
    "settings": ("path string, extends string, base_url string", "SELECT 'c' || n_nationkey || '/tsconfig.json', CASE n_nationkey % 5 WHEN 0 THEN NULL WHEN 4 THEN 'none.json' ELSE 'c' || (n_nationkey - 1) || '/tsconfig.json' END, CASE n_nationkey % 5 WHEN 0 THEN '../lib' WHEN 2 THEN '.' END FROM {nation} UNION ALL SELECT 'k' || r_regionkey || '/t.json', 'k' || ((r_regionkey + 1) % 5) || '/t.json', CASE WHEN r_regionkey = 2 THEN './in' END FROM {region}"),
    "aliases": ("path string, pattern string, targets array<string>", "SELECT 'c' || n_nationkey || '/tsconfig.json', '@lib/*', {list}('gone/*', '*') FROM {nation} WHERE n_nationkey % 5 = 0 UNION ALL SELECT 'c' || n_nationkey || '/tsconfig.json', 'exact', {list}('x1') FROM {nation} WHERE n_nationkey % 5 = 0"),
    "page_targets": ("state_id string, target_id string, source string, role string, tag string, dom_path string, declared string, resolved string, navigation string, strength string", "SELECT 's' || CAST(floor(p_partkey / 12) AS BIGINT), 't' || p_partkey, CASE WHEN p_size % 3 = 0 THEN 'interaction-candidate' ELSE 'semantic-element' END, CASE p_size % 5 WHEN 0 THEN 'link' WHEN 1 THEN 'textbox' WHEN 2 THEN 'img' WHEN 3 THEN 'button' END, CASE WHEN p_size % 7 = 0 THEN 'select' ELSE 'div' END, 'p' || (p_partkey % 4), CASE p_size % 4 WHEN 0 THEN '/x' WHEN 1 THEN '#top' WHEN 2 THEN '#/app' END, CASE WHEN p_size % 8 < 4 THEN 'https://a.test/page#top' WHEN p_size % 8 < 7 THEN 'https://a.test/other' END, CASE WHEN p_size % 2 = 1 THEN 'custom-navigation' END, CASE WHEN p_size > 25 THEN 'strong' ELSE 'weak' END FROM {part}"),
    "pages_seen": ("state_id string, origin string, mutated boolean", "SELECT 's' || c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 'https://b.test' ELSE 'https://a.test' END, CASE WHEN c_nationkey = 7 THEN NULL ELSE c_acctbal < 1000 END FROM {customer}"),
    "widgets": ("state_id string, role string, input_type string, name string", "SELECT 's' || o_custkey, CASE o_orderkey % 3 WHEN 0 THEN 'textbox' WHEN 1 THEN 'button' END, CASE WHEN o_orderkey % 97 = 0 THEN 'password' END, CASE o_orderkey % 4 WHEN 0 THEN 'Next' WHEN 1 THEN 'User' WHEN 2 THEN 'Search' ELSE 'log in' END FROM {orders}"),
    "words_seen": ("state_id string, place int, text string", "SELECT 's' || o_custkey, o_orderkey, CASE o_orderkey % 13 WHEN 0 THEN 'Please sign' WHEN 1 THEN 'in here' WHEN 2 THEN 'Login now' ELSE 'cataloging' END FROM {orders}"),
    "wanted": ("state_id string, target_id string, tag string, text string", "SELECT 's' || CAST(floor(p_partkey / 12) AS BIGINT), 't' || p_partkey, 'a', CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN p_name WHEN 2 THEN '  ' || p_name ELSE 'Old' END FROM {part}"),
    "present": ("state_id string, target_id string, tag string, text string", "SELECT 's' || CAST(floor(p_partkey / 12) AS BIGINT), 't' || p_partkey, CASE WHEN p_size % 9 = 0 THEN 'b' ELSE 'a' END, p_name FROM {part} WHERE p_size % 6 <> 5 UNION ALL SELECT 's' || CAST(floor(p_partkey / 12) AS BIGINT), 't' || p_partkey, 'a', p_name FROM {part} WHERE p_size % 6 = 4"),
    "attempts": ("src string, dst string, target_id string, failed boolean", "SELECT 's' || o_custkey, CASE WHEN o_orderstatus <> 'P' THEN 's' || o_orderkey END, 't' || o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE o_totalprice > 300000 END FROM {orders}"),
    "callouts": ("callout_id string, step int, state_id string, path string, number int", "SELECT 'c' || CAST(floor(o_orderkey * 9 / 10) AS BIGINT), CAST(o_custkey AS INT), 's' || o_custkey, CASE WHEN o_orderkey % 20 = 0 THEN 'gone.png' ELSE 's' || o_custkey || '.png' END, CAST(1 + o_orderkey % 4 AS INT) FROM {orders} WHERE o_totalprice < 200000"),
    "shots": ("state_id string, path string", "SELECT 's' || c_custkey, 's' || c_custkey || '.png' FROM {customer}"),
    "guides": ("step int, status string", "SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'mapped' ELSE 'no-visual-target' END FROM {customer}"),
    "entries": ("feature_id string, package_id string, path string, updated string", "SELECT 'F' || o_custkey, 'p' || (o_orderkey % 3), 'a' || o_orderkey || '.json', o_orderpriority FROM {orders}"),
    "detected": ("warning_id string, state string", "SELECT 'w' || doc_id, 'open' FROM {labels}"),
    "redacted": ("warning_id string, state string", "SELECT 'w' || doc_id, 'redacted' FROM {documents}"),
    "found": ("target_id string, place int, evidence array<string>", "SELECT 'd' || CAST(floor(o_orderkey / 4) AS BIGINT), CAST(o_orderkey % 4 AS INT), CASE o_orderstatus WHEN 'F' THEN {list}('a', o_orderpriority) WHEN 'O' THEN {list}(o_orderpriority) ELSE {none} END FROM {orders}"),
})

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, tuple[Query, str]] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def keep(function: Query) -> Query:
        FOUND[function.__name__] = (function, sql)
        return function

    return keep


_HASH = "substr(sha256({0}), 1, 16)"


@query(T.with_sql("seeds", "links").replace("WITH ", "WITH RECURSIVE ", 1) + """,
route AS (SELECT feature_id, route_id AS node FROM seeds WHERE route_id IS NOT NULL),
component AS (SELECT DISTINCT feature_id, dst AS node FROM route JOIN links ON node = src AND type = 'ROUTE_RENDERS_COMPONENT'),
ui AS (SELECT DISTINCT feature_id, dst AS node FROM component JOIN links ON node = src AND type = 'CONTAINS_ELEMENT'),
event AS (SELECT DISTINCT feature_id, dst AS node FROM ui JOIN links ON node = src AND type = 'HAS_EVENT'),
called AS (SELECT DISTINCT feature_id, dst AS node FROM event JOIN links ON node = src AND type = 'BINDS_TO' UNION SELECT feature_id, dst FROM called JOIN links ON node = src AND type = 'CALLS'),
execution AS (SELECT DISTINCT feature_id, dst AS node FROM called JOIN links ON node = src AND type = 'PERFORMS_GRAPHQL_EXECUTION')
SELECT feature_id, 'route' AS part, node FROM route UNION SELECT feature_id, 'component', node FROM component UNION SELECT feature_id, 'ui', node FROM ui UNION SELECT feature_id, 'event', node FROM event UNION SELECT feature_id, 'callable', node FROM called
UNION SELECT feature_id, 'http', dst FROM called JOIN links ON node = src AND type = 'PERFORMS_HTTP_REQUEST' UNION SELECT feature_id, 'graphql', node FROM execution UNION SELECT feature_id, 'graphql', dst FROM execution JOIN links ON node = src AND type IN ('USES_DOCUMENT', 'EXECUTES_OPERATION')
UNION SELECT feature_id, 'navigation', navigation_id FROM seeds WHERE navigation_id IS NOT NULL UNION SELECT feature_id, 'navigation', src FROM seeds JOIN links ON dst = route_id AND type = 'NAVIGATES_TO' WHERE navigation_id IS NULL""")
def feature_nodes(spark: SparkSession, d: str) -> DataFrame:
    return features.feature_nodes(T.frame(spark, d, "seeds"), T.frame(spark, d, "links"))


@query(T.with_sql("results", "refs", "parts") + "SELECT DISTINCT feature_id, result_id FROM results JOIN refs USING (result_id) JOIN parts USING (kind, ref) WHERE status <> 'ambiguous'")
def feature_results(spark: SparkSession, d: str) -> DataFrame:
    return features.relevant_results(T.frame(spark, d, "results"), T.frame(spark, d, "refs"), T.frame(spark, d, "parts"))


@query(T.with_sql("seeds", "states", "selected") + rf""", r AS (SELECT feature_id, CASE WHEN starts_with(pattern, '/') THEN pattern ELSE '/' || pattern END AS pattern, route_id FROM seeds WHERE route_id IS NOT NULL), j AS (SELECT r.feature_id, r.pattern, s.place, x.result_id, x.path FROM r JOIN states s USING (feature_id) LEFT JOIN selected x ON x.route_id = r.route_id AND x.state_id = s.state_id),
w AS (SELECT feature_id, pattern, min(result_id) AS result_id, arg_min(path, place) AS path FROM j GROUP BY ALL HAVING bool_and(result_id IS NOT NULL)), p AS (SELECT feature_id, pattern, place, string_split(path[2:], '/') AS s, string_split(pattern[2:], '/') AS p FROM j WHERE path IS NOT NULL),
v AS (SELECT feature_id, place, i, value, {_CLASS} AS class FROM (SELECT feature_id, place, unnest(s[: len(p)]) AS value, unnest(range(1, least(len(s), len(p)) + 1)) AS i, p FROM p) WHERE starts_with(p[i], ':')), f AS (SELECT feature_id, value, min((place, i)) AS o FROM v WHERE class = 'stable-slug' GROUP BY ALL),
e AS (SELECT feature_id, count(*) AS n, arg_min(value, o) AS first, arg_max(value, o) AS last FROM f GROUP BY feature_id), k AS (SELECT feature_id, pattern, '/' || string_agg(CASE WHEN i <= len(p) AND starts_with(p[i], ':') THEN CASE WHEN {_CLASS} = 'stable-slug' THEN lower(value) ELSE ':opaque' END ELSE value END, '/' ORDER BY i) AS shown FROM (SELECT feature_id, pattern, unnest(string_split(path[2:], '/')) AS value, unnest(range(1, len(string_split(path[2:], '/')) + 1)) AS i, string_split(pattern[2:], '/') AS p FROM w) GROUP BY ALL)
SELECT w.feature_id, result_id, w.pattern, w.pattern || '|' || shown AS identity_key, CASE WHEN w.pattern = '/' THEN 'Root' WHEN w.pattern = '/:a/:b' THEN CASE WHEN n IS NULL THEN w.pattern WHEN n = 1 OR first = last THEN upper(first[1]) || first[2:] ELSE upper(first[1]) || first[2:] || ' / ' || upper(last[1]) || last[2:] END
  ELSE upper(w.pattern[2]) || split_part(w.pattern[3:], '/', 1) || CASE WHEN n > 0 THEN ' / ' || upper(last[1]) || last[2:] ELSE '' END END AS name, CASE WHEN w.pattern = '/' THEN 'route-literal' WHEN n IS NULL THEN CASE WHEN w.pattern = '/:a/:b' THEN 'route-pattern' ELSE 'route-literal' END WHEN w.pattern = '/:a/:b' AND n > 1 THEN 'runtime-route-structure' ELSE 'route-bound-value' END AS source FROM w JOIN k USING (feature_id, pattern) LEFT JOIN e USING (feature_id)""")
def feature_route_identity(spark: SparkSession, d: str) -> DataFrame:
    return features.route_identities(T.frame(spark, d, "seeds").drop("place"), T.frame(spark, d, "states"), T.frame(spark, d, "selected"))


@query(T.with_sql("observed") + """, o AS (SELECT *, trim(regexp_replace(coalesce(label, ''), '[ \\t\\r\\n]+', ' ', 'g')) AS name FROM observed)
SELECT feature_id, min(name) AS name, min_by(evidence_id, place) AS evidence_id FROM o GROUP BY feature_id HAVING count(DISTINCT name) = 1 AND min(name) <> ''""")
def feature_navigation_label(spark: SparkSession, d: str) -> DataFrame:
    return features.only_label(T.frame(spark, d, "observed"))


@query(T.with_sql("candidates") + f"""SELECT feature_id, trim(name) AS name, coalesce(detail, source) AS source, evidence_id FROM candidates WHERE coalesce(name, '') <> ''
QUALIFY row_number() OVER (PARTITION BY feature_id ORDER BY list_position([{', '.join(repr(s) for s in features.SOURCES)}], source), place, evidence_id) = 1""")
def feature_names(spark: SparkSession, d: str) -> DataFrame:
    return features.choose_names(T.frame(spark, d, "candidates"))


@query(T.with_sql("seeds") + """ SELECT feature_id, CASE WHEN pattern = '/' THEN 'Root' ELSE upper(ltrim(string_split(pattern, '/')[-1], ':')[1]) || ltrim(string_split(pattern, '/')[-1], ':')[2:] END AS name FROM seeds WHERE route_id IS NOT NULL""")
def feature_route_names(spark: SparkSession, d: str) -> DataFrame:
    return T.frame(spark, d, "seeds").filter("route_id is not null").select("feature_id", features.route_name(F.col("pattern")).alias("name"))


_RELATED = T.with_sql("seeds", "links", "states", "moves") + f""",
node AS (SELECT feature_id, place, route_id AS node FROM seeds UNION SELECT feature_id, place, navigation_id FROM seeds UNION SELECT s.feature_id, s.place, dst FROM seeds s JOIN links ON route_id = src AND type = 'ROUTE_RENDERS_COMPONENT'
  UNION SELECT s.feature_id, s.place, b.dst FROM seeds s JOIN links a ON route_id = a.src AND a.type = 'ROUTE_RENDERS_COMPONENT' JOIN links b ON a.dst = b.src AND b.type = 'CONTAINS_ELEMENT'
  UNION SELECT feature_id, place, src FROM seeds JOIN links ON dst = route_id AND type = 'NAVIGATES_TO' WHERE navigation_id IS NULL),
edge AS (SELECT l.id, (SELECT arg_max(feature_id, place) FROM seeds WHERE route_id = dst) AS t, (SELECT arg_min(feature_id, place) FROM node WHERE node = src) AS f FROM links l WHERE type = 'NAVIGATES_TO'),
came AS (SELECT b.feature_id AS t, arg_min(a.feature_id, s.place) AS f FROM moves m JOIN states a ON a.state_id = m.src JOIN states b ON b.state_id = m.dst JOIN seeds s ON s.feature_id = a.feature_id GROUP BY b.feature_id),
r AS (SELECT 'navigation-to' AS type, coalesce(edge.f, came.f) AS from_feature, edge.t AS to_feature, id AS edge_id, NULL AS transition_id FROM edge LEFT JOIN came USING (t)
  UNION ALL SELECT 'runtime-transition-to', a.feature_id, b.feature_id, NULL, m.id FROM moves m JOIN states a ON a.state_id = m.src JOIN states b ON b.state_id = m.dst)
SELECT 'feature-relationship:' || {_HASH.format("type || '|' || from_feature || '|' || to_feature || '|' || coalesce(edge_id, '') || '|' || coalesce(transition_id, '')")} AS id, * FROM r WHERE from_feature <> to_feature"""


@query(_RELATED)
def feature_relationships(spark: SparkSession, d: str) -> DataFrame:
    seeds, links = T.frame(spark, d, "seeds"), T.frame(spark, d, "links")
    return features.relationships(links.filter("type = 'NAVIGATES_TO'").select("id", "src", "dst"), T.frame(spark, d, "moves").select("id", "src", "dst"), seeds.select("feature_id", "place"), features.leading_nodes(seeds, links, seeds), T.frame(spark, d, "states").select("feature_id", "state_id"))


@query(T.with_sql("menus", "moves", "states") + """SELECT feature_id, 'entry:' || node_id AS id, coalesce(nullif(label, ''), node_label) AS label, destination FROM menus
UNION SELECT feature_id, 'entry:' || id, label, after_url FROM moves JOIN states ON dst = state_id WHERE label <> ''""")
def feature_entry_points(spark: SparkSession, d: str) -> DataFrame:
    return features.entry_points(T.frame(spark, d, "menus"), T.frame(spark, d, "moves"), T.frame(spark, d, "states"))


@query(T.with_sql("shells") + """SELECT *, CASE WHEN pattern LIKE '%:%' AND EXISTS (SELECT 1 FROM shells o WHERE o.route_id = s.route_id AND o.key = s.key AND o.feature_id <> s.feature_id) THEN 'shared-shell' ELSE 'feature-specific' END AS scope FROM shells s""")
def feature_sibling_scope(spark: SparkSession, d: str) -> DataFrame:
    return features.sibling_scope(T.frame(spark, d, "shells"))


@query(T.with_sql("evidence", "used") + f""", u AS (SELECT kind, evidence_id, CASE kind WHEN 'static-node' THEN CASE WHEN detail IN ('route', 'navigation', 'component', 'ui-element', 'ui-event') THEN 'no-deterministic-feature-context' ELSE 'internal-evidence-without-feature-root' END
  WHEN 'static-edge' THEN 'edge-not-contained-by-feature-context' WHEN 'runtime-state' THEN 'runtime-state-without-meaningful-user-facing-root' WHEN 'runtime-transition' THEN 'transition-not-associated-with-feature' ELSE CASE WHEN detail = 'ambiguous' THEN 'ambiguous-evidence-not-force-assigned' ELSE 'evidence-not-related-to-feature' END END AS reason
  FROM evidence WHERE (kind, evidence_id) NOT IN (SELECT (kind, evidence_id) FROM used))
SELECT 'unassigned:' || {_HASH.format("kind || '|' || evidence_id || '|' || reason")} AS id, * FROM u""")
def feature_unassigned(spark: SparkSession, d: str) -> DataFrame:
    return features.unassigned(T.frame(spark, d, "evidence"), T.frame(spark, d, "used"))


@query(T.with_sql("named", "parts", "states") + """SELECT 'duplicate-feature' AS rule, feature_id AS subject FROM named GROUP BY feature_id HAVING count(*) > 1 UNION ALL SELECT 'invalid-name', feature_id FROM named WHERE trim(coalesce(name, '')) = ''
UNION ALL (SELECT DISTINCT 'unknown-' || kind, ref FROM parts WHERE kind <> 'state' OR ref NOT IN (SELECT state_id FROM states))""")
def feature_issues(spark: SparkSession, d: str) -> DataFrame:
    return features.issues(T.frame(spark, d, "named"), T.frame(spark, d, "parts"), T.frame(spark, d, "states").select(F.lit("state").alias("kind"), F.col("state_id").alias("ref")))


@query(T.with_sql("reported", "lines") + """, n AS (SELECT DISTINCT * FROM reported), r AS (SELECT n.feature_id, route, name, 0 AS o, 'FEATURE' AS section, name AS line FROM n UNION ALL SELECT feature_id, route, name, 1, section, concat_ws(' - ', label, status) FROM lines JOIN n USING (feature_id))
SELECT row_number() OVER (ORDER BY coalesce(route, '~'), name, feature_id, o, section, line) AS place, section, line FROM r""")
def feature_report(spark: SparkSession, d: str) -> DataFrame:
    lines = features.report(T.frame(spark, d, "reported").distinct(), T.frame(spark, d, "lines"))
    first = F.when(F.col("section") == "FEATURE", 0).otherwise(1)
    return ordering.total_order(lines, [F.col("at"), first, F.col("section"), F.col("line")]).select("place", "section", "line")


@query(T.with_sql("files", "imports") + """, b AS (SELECT import_id, CASE WHEN specifier LIKE '../../../%' THEN '../out' WHEN specifier LIKE '../%' THEN 'src/' || specifier[4:] ELSE regexp_replace(file, '/[^/]*$', '') || specifier[2:] END AS base FROM imports WHERE specifier LIKE '.%'),\nn AS (SELECT import_id, count(DISTINCT path) AS n, min(path) AS path FROM b JOIN files ON path IN (base || '.ts', base || '.tsx', base || '.js', base || '.jsx', base || '/index.ts', base || '/index.tsx', base || '/index.js', base || '/index.jsx') GROUP BY import_id)\nSELECT import_id, CASE WHEN n IS NULL THEN 'module-not-found' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous-module' END AS status, CASE WHEN n = 1 THEN path END AS path FROM b LEFT JOIN n USING (import_id)""")
def module_relative(spark: SparkSession, d: str) -> DataFrame:
    return modules.resolve_relative(T.frame(spark, d, "imports").filter(F.startswith("specifier", F.lit("."))), T.frame(spark, d, "files"))


_PACKAGES = T.with_sql("owners") + """, m AS (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS root FROM owners),
p AS (SELECT m.name, m.root, m.path AS manifest, m.entries FROM m JOIN m o ON o.path <> m.path, unnest(o.workspaces) w(pattern) WHERE m.name IS NOT NULL AND o.root = '' AND regexp_full_match(m.root, replace(regexp_replace(pattern, '/$', ''), '*', '[^/]*')))"""


@query(_PACKAGES + " SELECT DISTINCT name, root, manifest FROM p")
def module_workspaces(spark: SparkSession, d: str) -> DataFrame:
    return modules.workspace_packages(T.frame(spark, d, "owners")).drop("entries")


@query("""WITH k AS (SELECT p_partkey AS import_id, p_partkey % 150 AS s, p_size % 9 = 5 AS deep FROM part WHERE p_size % 9 IN (4, 5)) SELECT import_id, '@org/p' || s AS package, CASE WHEN s % 10 = 9 THEN 'ambiguous-module' WHEN NOT deep AND s % 3 = 1 THEN 'module-not-found' ELSE 'resolved' END AS status,
  CASE WHEN s % 10 <> 9 THEN CASE WHEN deep OR s % 3 = 0 THEN 'packages/p' || s || '/main.ts' WHEN s % 3 = 2 THEN 'packages/p' || s || '/index.ts' END END AS path FROM k WHERE s IN (SELECT s_suppkey FROM supplier)""")
def module_packages(spark: SparkSession, d: str) -> DataFrame:
    return modules.resolve_workspace(T.frame(spark, d, "imports"), modules.workspace_packages(T.frame(spark, d, "owners")), T.frame(spark, d, "files"))


def _settings(spark: SparkSession, d: str) -> DataFrame:
    paths = T.frame(spark, d, "aliases").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pattern", "targets"))).alias("paths"))  # the patterns of one configuration
    return T.frame(spark, d, "settings").join(paths, "path", "left")


@query("""SELECT 'c' || n_nationkey || '/tsconfig.json' AS path, CASE n_nationkey % 5 WHEN 2 THEN 'c' || n_nationkey WHEN 3 THEN 'c' || (n_nationkey - 1) WHEN 4 THEN NULL ELSE 'lib' END AS base_url, CASE WHEN n_nationkey % 5 = 4 THEN 0 ELSE 2 END AS n_paths FROM nation
UNION ALL SELECT 'k' || r_regionkey || '/t.json', CASE WHEN r_regionkey <= 2 THEN 'k2/in' END, 0 FROM region""")
def module_configurations(spark: SparkSession, d: str) -> DataFrame:
    held, _ = modules.inherited(_settings(spark, d))
    return held.select("path", "base_url", F.coalesce(F.nullif(F.size("paths"), F.lit(-1)), F.lit(0)).alias("n_paths"))


@query("""SELECT 'c' || n_nationkey || '/tsconfig.json' AS path, 'Unsupported or missing extends target: none.json' AS message FROM nation WHERE n_nationkey % 5 = 4 UNION ALL SELECT min('k' || r_regionkey || '/t.json'), 'Circular configuration extends chain' FROM region""")
def module_configuration_errors(spark: SparkSession, d: str) -> DataFrame:
    return modules.inherited(_settings(spark, d))[1]


@query("""WITH k AS (SELECT n_nationkey AS n, -1 - n_nationkey AS import_id, 'c' || n_nationkey || '/tsconfig.json' AS config, CASE WHEN n_nationkey % 5 < 2 THEN (SELECT 'lib/x' || s_suppkey || '.ts' FROM supplier WHERE s_suppkey = CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey ELSE 1 END) END AS path FROM nation WHERE n_nationkey % 5 <> 4)
SELECT import_id, config, 'path-alias' AS kind, CASE WHEN path IS NULL THEN 'configured-path-alias-target-not-found' ELSE 'resolved' END AS status, path FROM k""")
def module_aliases(spark: SparkSession, d: str) -> DataFrame:
    held, _ = modules.inherited(_settings(spark, d))
    return modules.resolve_configured(T.frame(spark, d, "imports"), held, T.frame(spark, d, "files"))


@query(T.with_sql("found") + "SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY len(evidence), place) = 1")
def module_shortest_evidence(spark: SparkSession, d: str) -> DataFrame:
    return modules.shortest_evidence(T.frame(spark, d, "found"))


_PRIORITY = """CASE WHEN source = 'semantic-element' AND (role IN ('textbox', 'searchbox', 'combobox', 'checkbox', 'radio', 'switch', 'option') OR tag IN ('input', 'textarea', 'select')) THEN 'form-control' WHEN source = 'semantic-element' AND role = 'img' THEN 'semantic-image'
  WHEN declared <> '' AND resolved <> '' THEN CASE WHEN declared LIKE '#%' AND declared NOT LIKE '#/%' AND regexp_extract(resolved, '^https?://[^/]*([^?#]*)', 1) = '/page' THEN 'utility-navigation' ELSE 'explicit-navigation' END
  WHEN source = 'interaction-candidate' AND navigation = 'custom-navigation' THEN CASE WHEN strength = 'strong' THEN 'strong-custom-navigation' ELSE 'supporting-navigation' END WHEN source = 'semantic-element' AND role IN ('button', 'menuitem', 'tab') THEN 'safe-control' ELSE 'unknown' END"""


@query(T.with_sql("page_targets") + f""", p AS (SELECT state_id, target_id, dom_path, {_PRIORITY} AS priority FROM page_targets),
r AS (SELECT *, row_number() OVER (PARTITION BY state_id ORDER BY list_position([{', '.join(repr(s) for s in crawl.PRIORITIES)}], priority), dom_path, target_id) AS place FROM p)
SELECT state_id, target_id, priority, dom_path, place, CASE WHEN place > 6 THEN 'runtime-skipped:' || {_HASH.format("state_id || '|' || target_id || '|not-eligible'")} END AS skipped_id FROM r""")
def crawl_targets(spark: SparkSession, d: str) -> DataFrame:
    names = ["source", "role", "tag", "declared", "resolved", "navigation", "strength"]
    rows = T.frame(spark, d, "page_targets").withColumn("priority", crawl.priority(*[F.col(n) for n in names], F.lit("https://a.test/page")))
    return crawl.ranked_targets(rows.select("state_id", "target_id", "priority", "dom_path"), 6)


@query(T.with_sql("pages_seen", "widgets", "words_seen") + r""", l AS (SELECT state_id, bool_or(regexp_matches(lower(concat_ws(' ', text, following)), '\b(login|log in|sign in)\b')) AS login FROM (SELECT *, lead(text) OVER (PARTITION BY state_id ORDER BY place) AS following FROM words_seen) GROUP BY state_id),
w AS (SELECT state_id, bool_or(coalesce(input_type = 'password', false)) AS password, bool_or(coalesce(role = 'textbox', false)) AS box, bool_or(coalesce(role = 'button' AND lower(name) IN ('next', 'login', 'log in', 'sign in'), false)) AS button FROM widgets GROUP BY state_id),
s AS (SELECT p.state_id, concat_ws(',', CASE WHEN mutated THEN 'mutation-observed' END, CASE WHEN origin <> 'https://a.test' THEN 'origin-boundary' END, CASE WHEN coalesce(password, false) OR (coalesce(box, false) AND coalesce(login, false) AND coalesce(button, false)) THEN 'form-state' END) AS stops FROM pages_seen p LEFT JOIN w USING (state_id) LEFT JOIN l USING (state_id))
SELECT state_id, stops, stops = '' AS expandable FROM s""")
def crawl_stops(spark: SparkSession, d: str) -> DataFrame:
    rows = crawl.state_stops(T.frame(spark, d, "pages_seen"), T.frame(spark, d, "widgets"), T.frame(spark, d, "words_seen"), ["https://a.test"])
    return rows.withColumn("stops", F.array_join("stops", ","))


@query(T.with_sql("wanted", "present") + """, n AS (SELECT state_id, target_id, count(*) AS n, min(tag) AS t, min(text) AS x FROM present GROUP BY ALL)
SELECT state_id, target_id, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' WHEN tag = t AND (text = '' OR trim(regexp_replace(text, ' +', ' ', 'g')) = x) THEN 'resolved' ELSE 'stale' END AS status FROM wanted LEFT JOIN n USING (state_id, target_id)""")
def crawl_captured(spark: SparkSession, d: str) -> DataFrame:
    return crawl.captured_targets(T.frame(spark, d, "wanted"), T.frame(spark, d, "present"))


@query(T.with_sql("attempts") + f"""SELECT 'runtime-transition:' || {_HASH.format("CASE WHEN failed THEN src || '|' || target_id || '|failed' ELSE src || '|' || coalesce(dst, 'none') || '|' || target_id END")} AS id, src, dst, target_id, CASE WHEN failed THEN 'failed' ELSE 'observed' END AS status FROM attempts""")
def crawl_transitions(spark: SparkSession, d: str) -> DataFrame:
    return crawl.transition_ids(T.frame(spark, d, "attempts"))


@query(T.with_sql("callouts") + f""", s AS (SELECT state_id, path, count(*) AS n_callouts, string_agg(callout_id, ',' ORDER BY number, callout_id) AS callouts, string_agg(callout_id, '|' ORDER BY number, callout_id) AS ids FROM (SELECT state_id, path, callout_id, min(number) AS number FROM callouts GROUP BY ALL) GROUP BY ALL)
SELECT 'screenshot-annotation-set:' || {_HASH.format("state_id || '|' || path || '|' || ids")} AS id, state_id, path, n_callouts, callouts FROM s""")
def annotation_sets(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.annotation_sets(T.frame(spark, d, "callouts"))


@query(T.with_sql("callouts", "shots", "guides") + """SELECT 'duplicate-callout' AS rule, callout_id AS subject FROM callouts GROUP BY callout_id HAVING count(*) > 1 UNION ALL SELECT 'screenshot-mismatch', callout_id FROM callouts WHERE (state_id, path) NOT IN (SELECT (state_id, path) FROM shots)
UNION ALL SELECT 'callout-numbering', state_id || '|' || path FROM callouts GROUP BY state_id, path HAVING min(number) <> 1 OR max(number) <> count(DISTINCT number)
UNION ALL SELECT 'mapped-without-callout', step::VARCHAR FROM guides WHERE status = 'mapped' AND step NOT IN (SELECT step FROM callouts) UNION ALL SELECT 'callout-without-target', step::VARCHAR FROM guides WHERE status = 'no-visual-target' AND step IN (SELECT step FROM callouts)""")
def mapping_issues(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.mapping_issues(T.frame(spark, d, "guides"), T.frame(spark, d, "callouts"), T.frame(spark, d, "shots"))


@query(T.with_sql("entries") + "SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY feature_id, package_id ORDER BY path DESC) = 1")
def latest_packages(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.latest_packages(T.frame(spark, d, "entries"))


@query(T.with_sql("detected", "redacted") + "SELECT * FROM detected UNION ALL SELECT * FROM redacted WHERE warning_id NOT IN (SELECT warning_id FROM detected)")
def merged_warnings(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.merged_warnings(T.frame(spark, d, "detected"), T.frame(spark, d, "redacted"))


def queries() -> dict[str, Query]:
    return {name: function for name, (function, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FOUND.items()}
