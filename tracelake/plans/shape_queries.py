"""Queries of open data (VARIANT), fingerprints, readiness, trees of lines and validators over the given tables, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import routes as R
from tracelake.functions.urls import application_path
from tracelake.operators import crawl, documents, fingerprints, knowledge, projections, rules, summaries, trees, workspace
from tracelake.sources.tables import links, table
from tracelake.streaming import readiness

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, tuple[Query, str]] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def keep(function: Query) -> Query:
        FOUND[function.__name__] = (function, sql)
        return function

    return keep


#: Nodes with open data from events: their types, users and properties, of which some have another shape than is read.
_OPERATION = """concat('{"variables":', if(value > 60, 'null', concat('[', props, ',{"type":"Int","required":true,"name":"k"},{"name":"u","type":7},3,{"name":"v","defaultValue":"1","type":"ID!"}]')),
  ',"name":', if(value < 20, 'null', concat('"op', user_id, '"')), ',"operationType":', case event_type when 'click' then '"query"' when 'view' then '"mutation"' when 'purchase' then '"subscription"' else '5' end, ',"returnType":"Item"}')"""


def _nodes(spark: SparkSession, d: str, kind: str, text: str) -> DataFrame:
    return table(spark, d, "events").select(F.concat(F.lit("n"), F.col("event_id").cast("string")).alias("id"), F.lit(kind).alias("type"), F.try_parse_json(F.expr(text)).alias("data"))


_GOOD = "event_type IN ('click', 'view', 'purchase') AND value >= 20"


@query(f"SELECT 'n' || event_id AS node_id, 'op' || user_id AS name, CASE event_type WHEN 'click' THEN 'query' WHEN 'view' THEN 'mutation' ELSE 'subscription' END AS type, 'Item' AS return_type, value <= 60 AS has_variables FROM events WHERE {_GOOD}")
def open_operations(spark: SparkSession, d: str) -> DataFrame:
    """Operations in the open data of events."""
    return projections.read_operations(_nodes(spark, d, "graphql-operation", _OPERATION))[0]


@query(f"""SELECT 'n' || event_id AS node_id, x.place, x.key, x.type, x.required, x.default_value FROM events, (SELECT unnest([{{'place': 1, 'key': 'k', 'type': 'Int', 'required': true, 'default_value': NULL}}, {{'place': 4, 'key': 'v', 'type': 'ID!', 'required': NULL, 'default_value': '1'}}]) AS x) WHERE {_GOOD} AND value <= 60""")
def open_variables(spark: SparkSession, d: str) -> DataFrame:
    return projections.read_operations(_nodes(spark, d, "graphql-operation", _OPERATION))[1]


@query(f"""SELECT 'n' || event_id AS node_id, 'operation' AS part, 1 AS n FROM events WHERE NOT coalesce({_GOOD}, false) UNION ALL SELECT 'n' || event_id, 'variable', 3 FROM events WHERE {_GOOD} AND value <= 60""")
def open_malformed(spark: SparkSession, d: str) -> DataFrame:
    """What the two projections pass over: other types and names, and three of five variables."""
    return projections.read_operations(_nodes(spark, d, "graphql-operation", _OPERATION))[2]


@query("SELECT 'n' || event_id AS node_id, '/u/' || user_id AS value FROM events WHERE event_type = 'click'")
def open_endpoints(spark: SparkSession, d: str) -> DataFrame:
    text = """concat('{"transport":{"endpoint":{"value":"/u/', user_id, '","kind":"', if(event_type = 'click', 'static', 'dynamic'), '"}}}')"""
    return projections.read_endpoints(_nodes(spark, d, "graphql-execution", text))[0]


@query("""SELECT 'n' || event_id AS node_id, 'type' AS part, NULL AS name, 1::BIGINT AS n FROM events UNION ALL SELECT 'n' || event_id, 'read', 'T' || user_id, 1 FROM events
UNION ALL SELECT 'n' || event_id, 'field', NULL, 2 FROM events UNION ALL SELECT 'n' || event_id, 'fields', 'k,w', 2 FROM events""")
def open_types(spark: SparkSession, d: str) -> DataFrame:
    """Types in the open data of events, their fields, and what is passed over."""
    text = """concat('{"schemaTypes":[', props, ',{"name":"T', user_id, '","fields":[{"name":"k","type":"Int"},', props, ',"x",{"type":"ID","name":"w"}]}]}')"""
    types, fields, skipped = projections.read_types(_nodes(spark, d, "graphql-document", text))
    listed = fields.groupBy("node_id").agg(F.array_join(F.array_sort(F.collect_list("field")), ",").alias("name"), F.count(F.lit(1)).alias("n"))  # fields of one type
    rows = skipped.select("node_id", "part", F.lit(None).cast("string").alias("name"), "n")
    return rows.unionByName(types.select("node_id", F.lit("read").alias("part"), "name", F.lit(1).cast("long").alias("n"))).unionByName(listed.withColumn("part", F.lit("fields")))


@query("""SELECT event_id AS state_id, 0 AS place, 0 AS "at", 'a' || event_id AS observation_id, 'GET' AS method, '/u/' || user_id AS url FROM events UNION ALL SELECT event_id, 0, 2, 'b' || event_id, NULL, '/v' FROM events WHERE value > 30""")
def flattened_network(spark: SparkSession, d: str) -> DataFrame:
    """Observations from nested lists: each event is a state with two sets, one of them of another shape."""
    text = """concat('{"networkObservations":[{"network":[{"id":"a', event_id, '","url":"/u/', user_id, '","method":"GET"},', props, if(value > 30, concat(',{"url":"/v","id":"b', event_id, '","method":1}'), ''), ']},{"network":5}]}')"""
    states = table(spark, d, "events").select(F.col("event_id").alias("state_id"), F.try_parse_json(F.expr(text)).alias("data"))
    return projections.read_network(states)[0]


@query("""WITH o AS (SELECT 'obs' || event_id AS observation_id, CASE WHEN event_type <> 'view' THEN user_id END AS state_id, CASE WHEN event_type = 'view' THEN user_id END AS transition_id FROM events),
r AS (SELECT 'obs' || o_orderkey AS observation_id, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS state_id, CASE WHEN o_orderstatus <> 'F' THEN o_custkey END AS transition_id FROM orders)
SELECT o.* FROM o WHERE EXISTS (SELECT 1 FROM r WHERE r.observation_id = o.observation_id AND CASE WHEN o.state_id IS NOT NULL THEN r.state_id IS NULL OR r.state_id = o.state_id ELSE r.transition_id IS NULL OR r.transition_id = o.transition_id END)""")
def runtime_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """Events as observations of states or transitions, orders as the references of results."""
    observations = table(spark, d, "events").selectExpr("concat('obs', event_id) as observation_id", "if(event_type <> 'view', user_id, null) as state_id", "if(event_type = 'view', user_id, null) as transition_id")
    references = table(spark, d, "orders").selectExpr("concat('obs', o_orderkey) as observation_id", "if(o_orderstatus <> 'P', o_custkey, null) as state_id", "if(o_orderstatus <> 'F', o_custkey, null) as transition_id")
    return projections.runtime_endpoints(observations, references)


@query("""WITH e AS (SELECT user_id, event_type, event_id, (props::JSON->>'k')::BIGINT // 50 AS k, floor(value / 50)::BIGINT AS v, event_id // 300 AS batch FROM events)
SELECT user_id, event_type, batch, count(*) AS n, count(DISTINCT (k, v)) AS n_values, CASE WHEN count(DISTINCT (k, v)) > 1 THEN 'conflict' WHEN count(*) > 1 THEN 'duplicate' ELSE 'single' END AS status, min(event_id) AS first_event FROM e GROUP BY user_id, event_type, batch""")
def canonical_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Observations of events by user, type and batch. Their values are nested objects whose keys stand in one order or the other
    and whose numbers are written in two ways, which makes no conflict."""
    rows = table(spark, d, "events").withColumn("k", F.expr("cast(get_json_object(props, '$.k') as bigint) div 50")).withColumn("v", F.expr("cast(floor(value / 50) as bigint)")).withColumn("batch", F.expr("event_id div 300"))
    one = """concat('{"id":0,"a":{"k":', k, ',"v":[', v, ',{"y":1,"x":"', 'é \\\\u0041', '"}]}}')"""
    two = """concat('{ "a" : {"v":[', v, '.0 , {"x":"', 'é A', '","y":1}], "k":', k, '},"id":0e0 }')"""
    keys = ["user_id", "event_type", "batch"]
    seen = rows.select(*keys, "event_id", F.when(F.col("event_id") % 2 == 0, F.expr(one)).otherwise(F.expr(two)).alias("seen"))
    found = projections.retained_observations(seen, keys, "seen", ["event_id"])
    first = rows.groupBy(*keys).agg(F.min("event_id").alias("first_event"))
    return found.join(first, keys).select(*keys, "n", "n_values", "status", "first_event")


_NAV = r"""SELECT page_id, 'link' AS kind, regexp_extract(a, '<a href="([^"]*)"', 1) AS a, regexp_extract(a, '<a href="[^"]*"[^>]*>(.*?)</a>', 1, 's') AS b
  FROM (SELECT page_id, unnest(regexp_extract_all(m, '<a href="[^"]*"[^>]*>.*?</a>', 0, 's')) AS a FROM (SELECT page_id, unnest(regexp_extract_all(html, '<nav[^>]*>(.*?)</nav>', 1, 's')) AS m FROM pages))"""


@query(f"""WITH e AS ({_NAV} UNION ALL SELECT page_id, 'heading', h[2:3], regexp_extract(h, '^<h[1-6][^>]*>(.*)</h[1-6]>$', 1, 's') FROM (SELECT page_id, unnest(regexp_extract_all(html, '<h[2-6][^>]*>.*?</h[2-6]>', 0, 's')) AS h FROM pages)),
s AS (SELECT page_id, count(*) AS n, string_agg(kind || '|' || a || '|' || b, '~' ORDER BY kind, a, b) AS told FROM e GROUP BY page_id)
SELECT count(*) AS states, min(page_id) AS first_state, min(n) AS n, true AS verified FROM s GROUP BY told""")
def page_shells(spark: SparkSession, d: str) -> DataFrame:
    """Pages with the same menu links and minor headings, whatever their order."""
    pages = table(spark, d, "pages")
    menu = pages.select("page_id", F.explode(links(F.col("html"))).alias("x")).select("page_id", F.lit("link").alias("kind"), F.col("x.href").alias("a"), F.col("x.label").alias("b"))
    heads = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit("(?s)<h[2-6][^>]*>.*?</h[2-6]>"), F.lit(0))).alias("h"))
    heads = heads.select("page_id", F.lit("heading").alias("kind"), F.substring("h", 2, 2).alias("a"), F.regexp_extract("h", "(?s)^<h[1-6][^>]*>(.*)</h[1-6]>$", 1).alias("b"))
    return fingerprints.fingerprint_groups(menu.unionByName(heads), "page_id", ["kind", "a", "b"]).drop("fingerprint")


_POLLS = """SELECT concat(cast(user_id AS varchar), '-', cast(floor(event_id / 400) AS bigint)) AS state_id, ts AS polled_at, event_type AS signature, CASE WHEN value > 5 THEN 1 ELSE 0 END AS evidence, CASE WHEN value > 60 THEN 1 ELSE 0 END AS loaders FROM events"""


def polls(spark: SparkSession, d: str) -> DataFrame:
    """Events as polls of states: a user within 400 events, seen by its type, loading with large values."""
    state = F.concat_ws("-", F.col("user_id").cast("string"), F.floor(F.col("event_id") / 400).cast("string"))
    return table(spark, d, "events").select(state.alias("state_id"), F.col("ts").alias("polled_at"), F.col("event_type").alias("signature"), F.when(F.col("value") > 5, 1).otherwise(0).alias("evidence"), F.when(F.col("value") > 60, 1).otherwise(0).alias("loaders"))


@query(f"""WITH p AS ({_POLLS}), s AS (SELECT *, epoch_us(polled_at) // 1000 - min(epoch_us(polled_at) // 1000) OVER (PARTITION BY state_id) AS since FROM p), t AS (SELECT * FROM s WHERE since < 36000000),
c AS (SELECT *, row_number() OVER w AS n, CASE WHEN lag(signature) OVER w IS NOT DISTINCT FROM signature AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c FROM t WINDOW w AS (PARTITION BY state_id ORDER BY polled_at)),
r AS (SELECT *, row_number() OVER (PARTITION BY state_id, g ORDER BY polled_at) AS run FROM (SELECT *, sum(c) OVER (PARTITION BY state_id ORDER BY polled_at ROWS UNBOUNDED PRECEDING) AS g FROM c)),
f AS (SELECT state_id, min(n) FILTER (evidence > 0 AND loaders = 0 AND run >= 2) AS hit, max(n) AS last FROM r GROUP BY state_id)
SELECT f.state_id, CASE WHEN hit IS NOT NULL THEN 'ready' ELSE 'partial' END AS status, CASE WHEN hit IS NOT NULL THEN 'semantic-ui' ELSE 'semantic-timeout' END AS reason,
  CASE WHEN hit IS NULL THEN CASE WHEN loaders <> 0 THEN 'visible-loading-state' WHEN evidence = 0 THEN 'no-substantive-destination-content' ELSE 'unstable-destination-content' END END AS timeout_reason, n AS polls, since AS elapsed_ms
FROM f JOIN r ON r.state_id = f.state_id AND r.n = coalesce(hit, last)""")
def readiness_results(spark: SparkSession, d: str) -> DataFrame:
    """Every state of `polls`, ready or timed out after ten hours with the reason."""
    return readiness.readiness_table(polls(spark, d), timeout_ms=36_000_000)


_LINES = """SELECT doc_id AS id, i - 1 AS line, least(length(x) % 7, 5) AS indent, CASE WHEN length(x) % 3 = 0 THEN 'list' WHEN length(x) % 3 = 1 THEN 'link' ELSE 'textbox' END AS role FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE length(x) > 0"""


@query(f"""WITH l AS ({_LINES}) SELECT a.id, a.line::INTEGER AS line, a.indent::INTEGER AS indent, a.role, 'n"' || a.line AS name, (SELECT max(b.line) FROM l b WHERE b.id = a.id AND b.line < a.line AND b.indent < a.indent)::INTEGER AS parent FROM l a""")
def snapshot_lines(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots written from documents: each line an item, indented by its length, with a name and typed text."""
    line = lambda x, i: F.when(F.length(x) > 0, F.concat(F.repeat(F.lit(" "), F.least(F.length(x) % 7, F.lit(5))), F.lit("- "), F.when(F.length(x) % 3 == 0, F.lit("list")).when(F.length(x) % 3 == 1, F.lit("link")).otherwise(F.lit("textbox")), F.lit(' "n\\"'), i.cast("string"), F.lit('": secret'))).otherwise(F.lit(""))
    texts = table(spark, d, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), line), "\n").alias("told"))
    return trees.line_tree(texts, "doc_id", "told")


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN [] ELSE ['div: ' || c_name] END AS own, ['section: ' || r_name, 'nav: ' || n_name] AS above, c_mktsegment = 'BUILDING' AS link FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
t AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_linestatus, l_returnflag, l_orderkey * 8 + l_linenumber AS k FROM lineitem),
o AS (SELECT o_orderkey, o_custkey, o_orderstatus, coalesce(list(l_returnflag ORDER BY k, l_linestatus = 'O', l_returnflag) FILTER (k IS NOT NULL), []) AS said, coalesce(list(l_returnflag ORDER BY k, l_returnflag) FILTER (l_linestatus = 'O'), []) AS open FROM orders LEFT JOIN t ON l_orderkey = o_orderkey GROUP BY ALL),
cl AS (SELECT c_custkey, list(l_returnflag ORDER BY k, l_linestatus = 'O', l_returnflag) FILTER (k IS NOT NULL) AS said, list(l_returnflag ORDER BY k, l_returnflag) FILTER (l_linestatus = 'O') AS open FROM c JOIN orders ON o_custkey = c_custkey LEFT JOIN t ON l_orderkey = o_orderkey WHERE link GROUP BY c_custkey)
SELECT 'o' || o_orderkey AS id, 'a' AS element, CASE WHEN len(open) > 0 THEN 'dynamic' ELSE 'static' END AS label_kind, CASE WHEN len(open) > 0 THEN array_to_string(open, ', ') ELSE array_to_string(said, ' ') END AS label, CASE WHEN o_orderstatus = 'P' THEN 'dynamic' ELSE 'static' END AS destination_kind, '/o/' || o_orderkey AS destination, array_to_string(above || own, ' > ') AS ancestors FROM o JOIN c ON c_custkey = o_custkey
UNION ALL SELECT 'c' || c.c_custkey, 'Link', CASE WHEN len(coalesce(open, [])) > 0 THEN 'dynamic' ELSE 'static' END, CASE WHEN len(coalesce(open, [])) > 0 THEN array_to_string(open, ', ') ELSE coalesce(array_to_string(said, ' '), '') END, 'static', '/c/' || c.c_custkey, array_to_string(above, ' > ') FROM c LEFT JOIN cl USING (c_custkey) WHERE link""")
def link_breadcrumbs(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations, customers and orders as nested elements, of which orders and some customers are links; line items are
    the texts in them, or expressions."""
    none = "cast(null as string) as {0}".format
    rows = [
        table(spark, d, "region").selectExpr("concat('r', r_regionkey) as id", none("parent"), "'element' as kind", "'section' as name", "r_name as title", "0L as place", none("destination_kind"), none("destination"), none("text")),
        table(spark, d, "nation").selectExpr("concat('n', n_nationkey) as id", "concat('r', n_regionkey) as parent", "'element' as kind", "'nav' as name", "n_name as title", "0L as place", none("destination_kind"), none("destination"), none("text")),
        table(spark, d, "customer").selectExpr("concat('c', c_custkey) as id", "concat('n', c_nationkey) as parent", "'element' as kind", "if(c_mktsegment = 'BUILDING', 'Link', 'div') as name", "c_name as title", "0L as place", "if(c_mktsegment = 'BUILDING', 'static', null) as destination_kind", "if(c_mktsegment = 'BUILDING', concat('/c/', c_custkey), null) as destination", none("text")),
        table(spark, d, "orders").selectExpr("concat('o', o_orderkey) as id", "concat('c', o_custkey) as parent", "'element' as kind", "'a' as name", none("title"), "0L as place", "if(o_orderstatus = 'P', 'dynamic', 'static') as destination_kind", "concat('/o/', o_orderkey) as destination", none("text")),
        table(spark, d, "lineitem").withColumn("n", F.monotonically_increasing_id()).selectExpr("concat('t', n) as id", "concat('o', l_orderkey) as parent", "if(l_linestatus = 'O', 'dynamic', 'text') as kind", none("name"), none("title"), "l_orderkey * 8 + l_linenumber as place", none("destination_kind"), none("destination"), "l_returnflag as text"),
    ]
    found = trees.navigation_records(rules.union(*rows).filter("parent is not null or kind = 'element'"))
    return found.withColumn("ancestors", F.array_join("ancestors", " > "))


@query(r"""WITH p AS (SELECT page_id, url, CASE WHEN p = '' THEN '/' ELSE p END AS path FROM (SELECT page_id, url, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '(.)/+$', '\1') AS p FROM pages))
SELECT page_id, CASE WHEN contains(url, '#') THEN NULL ELSE path END AS route, CASE WHEN contains(url, '?') THEN NULL WHEN page_id % 2 = 0 THEN '/' || split_part(path, '/', 2) || '/x' ELSE path END AS joined FROM p""")
def page_routes(spark: SparkSession, d: str) -> DataFrame:
    """Pages as files of an app folder with groups and slots, some with no page file's name; and their last part declared below
    the first, absolute or below an unknown one."""
    path = application_path(F.col("url"))
    name = F.when(F.contains("url", F.lit("#")), F.lit("/layout.tsx")).otherwise(F.lit("/page.tsx"))
    file = F.concat(F.when(F.col("page_id") % 3 == 0, F.lit("src/app/(site)")).otherwise(F.lit("app/@main")), F.when(path == "/", F.lit("")).otherwise(path), F.lit("/(group)"), name)
    even = F.col("page_id") % 2 == 0
    declared = F.when(even | F.contains("url", F.lit("?")), F.lit("x//")).otherwise(F.concat(F.lit("/"), path))
    parent = F.when(~F.contains("url", F.lit("?")), F.concat(F.lit("/"), F.split(path, "/")[1], F.lit("/")))
    return table(spark, d, "pages").select("page_id", R.app_page_route(file).alias("route"), R.joined_route(declared, parent, F.lit(True)).alias("joined"))


_RESULTS = """SELECT o_orderkey::VARCHAR AS id, CASE o_orderstatus WHEN 'F' THEN 'corroborated' WHEN 'O' THEN 'static-only' ELSE 'runtime-only' END AS status, CASE WHEN o_totalprice > 400000 THEN NULL WHEN o_totalprice > 200000 THEN 'exact' ELSE 'strong' END AS strength,
  CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE 'c' || o_custkey END AS node, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 5 <> 0 THEN NULL ELSE 'e' || (o_orderkey * 2) END AS runtime, o_orderpriority LIKE '5%' AS silent FROM orders"""


@query(f"""WITH r AS ({_RESULTS}), bad AS (SELECT id, unnest([CASE WHEN silent THEN 'no-reasons' END, CASE WHEN status = 'corroborated' AND (strength IS NULL OR node IS NULL OR runtime IS NULL) THEN 'corroborated-incomplete' END,
  CASE WHEN status = 'static-only' AND (node IS NULL OR runtime IS NOT NULL) THEN 'static-only-references' END, CASE WHEN status = 'runtime-only' AND (node IS NOT NULL OR runtime IS NULL) THEN 'runtime-only-references' END]) AS rule FROM r)
SELECT rule, id AS subject FROM bad WHERE rule IS NOT NULL UNION ALL SELECT 'duplicate-exact-match', node FROM r WHERE strength = 'exact' AND node IS NOT NULL GROUP BY node HAVING count(*) > 1
UNION ALL SELECT 'missing-static-reference', id FROM r WHERE node NOT IN (SELECT 'c' || c_custkey FROM customer) UNION ALL SELECT 'missing-runtime-reference', id FROM r WHERE runtime NOT IN (SELECT 'e' || event_id FROM events)""")
def reconciliation_violations(spark: SparkSession, d: str) -> DataFrame:
    """Orders as results of requests: customers are the nodes, events the observations."""
    results = table(spark, d, "orders").selectExpr(
        "cast(o_orderkey as string) as id", "'http' as domain", "case o_orderstatus when 'F' then 'corroborated' when 'O' then 'static-only' else 'runtime-only' end as status",
        "case when o_totalprice > 400000 then null when o_totalprice > 200000 then 'exact' else 'strong' end as strength", "if(o_custkey % 3 = 0, cast(array() as array<string>), array(concat('c', o_custkey))) as static",
        "if(o_orderstatus = 'O' and o_orderkey % 5 <> 0, null, concat('e', o_orderkey * 2)) as runtime", "if(o_orderpriority like '5%', cast(array() as array<string>), array('x')) as reasons",
    )
    nodes = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("ref"))
    observed = table(spark, d, "events").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("ref"))
    return rules.reconciliation_issues(results, nodes, observed)


@query("""WITH v AS (SELECT doc_id, lower(coalesce(source, '')) AS id, CASE lang WHEN 'en' THEN 'succeeded' WHEN 'de' THEN 'failed' ELSE lang END AS generation, n_chars FROM documents)
SELECT rule, subject FROM (SELECT id || '-' || doc_id AS subject, unnest([CASE WHEN NOT regexp_full_match(id || '-' || doc_id, '[a-z0-9][a-z0-9-]{0,127}') THEN 'invalid-document-id' END, CASE WHEN coalesce(generation, '') NOT IN ('succeeded', 'failed') THEN 'invalid-generation-status' END, CASE WHEN n_chars > 5000 THEN 'invalid-review-status' END,
  CASE WHEN generation = 'succeeded' AND n_chars < 1000 THEN 'succeeded-without-article' END, CASE WHEN generation = 'failed' AND n_chars < 500 THEN 'failed-without-diagnostic' END, CASE WHEN n_chars < 100 THEN 'invalid-checksum' END]) AS rule FROM v) WHERE rule IS NOT NULL
UNION ALL SELECT 'missing-revision', id || '-' || doc_id FROM v WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def document_violations(spark: SparkSession, d: str) -> DataFrame:
    """Documents with states by their language and length; labels are their revisions."""
    rows = table(spark, d, "documents").selectExpr(
        "concat(lower(coalesce(source, '')), '-', doc_id) as id", "case lang when 'en' then 'succeeded' when 'de' then 'failed' else lang end as generation", "if(n_chars > 5000, 'unknown', 'draft') as review", "n_chars >= 1000 as has_article",
        "cast(doc_id as string) as current_revision", "if(n_chars < 500, '', 'told') as failure", "if(n_chars < 100, 'x', sha2(cast(doc_id as string), 256)) as checksum", "doc_id",
    )
    revisions = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id"), "doc_id").join(rows.select("doc_id", F.col("id").alias("document_id")), "doc_id")
    return rules.document_issues(rows, revisions.select("document_id", "id"))


@query("""WITH k AS (SELECT conv_id * 100 + turn AS id, conv_id, turn, role, length(coalesce(text, '')) AS n FROM conversations),
claim AS (SELECT id AS claim_id, CASE WHEN n % 2 = 0 THEN 'runtime-observation' ELSE 'visible-outcome' END AS kind FROM k WHERE n % 9 <> 0),
cls AS (SELECT id AS claim_id, CASE WHEN n % 5 = 0 THEN 'excluded' WHEN n % 5 = 1 THEN 'context' ELSE 'selected' END AS class, CASE WHEN n % 10 = 0 THEN 'duplicate' END AS reason FROM k WHERE n % 7 <> 0 UNION ALL SELECT id, 'context', NULL FROM k WHERE n % 11 = 0),
s AS (SELECT claim_id, count(DISTINCT class) AS n, bool_or(class = 'excluded') AS out FROM cls GROUP BY claim_id),
m AS (SELECT coalesce(claim.claim_id, s.claim_id) AS claim_id, kind, n, coalesce(out, false) AS out FROM claim FULL JOIN s ON s.claim_id = claim.claim_id),
prose AS (SELECT CASE WHEN turn = 0 THEN 'prerequisite' WHEN turn = 1 THEN 'expected' ELSE 'step' END AS part, id AS idx, CASE WHEN n % 13 = 0 THEN [] ELSE [id, id + 1] END AS ids FROM k),
cited AS (SELECT part, idx, c, kind, n, out FROM (SELECT part, idx, unnest(ids) AS c FROM prose) LEFT JOIN m ON claim_id = c)
SELECT 'unknown-claim' AS code, 'selection' AS place, claim_id::VARCHAR AS claim_id FROM cls WHERE claim_id NOT IN (SELECT claim_id FROM claim)
UNION ALL SELECT 'unclassified-claim', 'selection', claim_id::VARCHAR FROM m WHERE kind IS NOT NULL AND n IS NULL UNION ALL SELECT 'duplicate-classification', 'selection', claim_id::VARCHAR FROM m WHERE kind IS NOT NULL AND n > 1
UNION ALL SELECT 'missing-citation', part || ':' || idx, NULL FROM prose WHERE len(ids) = 0
UNION ALL SELECT CASE WHEN kind IS NULL THEN 'unknown-claim' WHEN out THEN 'excluded-claim-used' ELSE 'unselected-claim-used' END, part || ':' || idx, c::VARCHAR FROM cited WHERE kind IS NULL OR out OR n IS NULL
UNION ALL SELECT 'unsupported-prerequisite', 'prerequisite:' || idx, NULL FROM prose WHERE part = 'prerequisite' AND idx NOT IN (SELECT idx FROM cited WHERE part = 'prerequisite' AND kind = 'runtime-observation')
UNION ALL SELECT 'unsupported-outcome', 'expected:' || idx, NULL FROM prose WHERE part = 'expected' AND idx NOT IN (SELECT idx FROM cited WHERE part = 'expected' AND kind = 'visible-outcome')
UNION ALL SELECT 'invalid-deduplication', 'duplicate:' || id, id::VARCHAR FROM k WHERE n % 3 = 0 AND NOT (id IN (SELECT claim_id FROM cls WHERE class = 'excluded' AND reason = 'duplicate') AND id + 1 IN (SELECT claim_id FROM cls WHERE class <> 'excluded'))
UNION ALL SELECT CASE WHEN kind IS NULL THEN 'unknown-claim' ELSE 'excluded-claim-used' END, 'plan:' || k.id, k.id::VARCHAR FROM k LEFT JOIN m ON claim_id = k.id WHERE kind IS NULL OR out
UNION ALL SELECT 'invalid-screenshot-intent', 'intent:' || id, NULL FROM k LEFT JOIN prose ON part = 'step' AND idx = id WHERE ids IS NULL OR NOT list_contains(ids, id)""")
def writer_violations(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns as claims, sorted, cited, planned and shown by their lengths and places."""
    k = table(spark, d, "conversations").selectExpr("conv_id * 100 + turn as id", "turn", "length(coalesce(text, '')) as n")
    claims = k.filter("n % 9 <> 0").selectExpr("id as claim_id", "if(n % 2 = 0, 'runtime-observation', 'visible-outcome') as kind")
    classes = k.filter("n % 7 <> 0").selectExpr("id as claim_id", "case n % 5 when 0 then 'excluded' when 1 then 'context' else 'selected' end as class", "if(n % 10 = 0, 'duplicate', null) as reason")
    classes = classes.unionByName(k.filter("n % 11 = 0").selectExpr("id as claim_id", "'context' as class", "cast(null as string) as reason"))
    prose = k.selectExpr("case turn when 0 then 'prerequisite' when 1 then 'expected' else 'step' end as part", "id as idx", "if(n % 13 = 0, cast(array() as array<bigint>), array(id, id + 1)) as claim_ids")
    duplicates = k.filter("n % 3 = 0").selectExpr("id as idx", "id as claim_id", "id + 1 as retained")
    return rules.writer_issues(claims, classes, prose, k.selectExpr("id as idx", "id as claim_id"), duplicates, k.selectExpr("id as idx", "id as step", "array(id) as claim_ids"))


@query("""SELECT count(*) AS states_discovered, count(*) FILTER (c_acctbal < 0) AS boundary_states, count(*) FILTER (c_mktsegment = 'BUILDING') AS mutation_stop_branches, greatest(0, max(c_nationkey)) AS max_depth_reached,
  (SELECT count(*) FILTER (o_orderstatus = 'F') FROM orders) AS transitions_observed, (SELECT count(*) FILTER (o_orderstatus = 'P') FROM orders) AS failed_transitions, (SELECT count(*) FROM lineitem) AS targets_skipped,
  (SELECT count(*) FILTER (l_returnflag = 'R') FROM lineitem) AS blocked, (SELECT count(*) FILTER (l_returnflag = 'N') FROM lineitem) AS unknown FROM customer""")
def crawl_summary(spark: SparkSession, d: str) -> DataFrame:
    """Customers as states, orders as transitions, line items as skipped targets."""
    states = table(spark, d, "customer").selectExpr("c_acctbal < 0 as boundary", "if(c_mktsegment = 'BUILDING', array('mutation-observed'), cast(array() as array<string>)) as stops", "c_nationkey as depth")
    moves = table(spark, d, "orders").selectExpr("case o_orderstatus when 'F' then 'observed' when 'P' then 'failed' else 'open' end as status")
    return summaries.discovery_summary(states, moves, table(spark, d, "lineitem").selectExpr("case l_returnflag when 'R' then 'blocked' when 'N' then 'unknown' else 'allowed' end as decision"))


@query("""SELECT count(*) AS states_observed, count(*) FILTER (c_acctbal < 0) AS origin_boundaries, count(*) FILTER (c_mktsegment = 'BUILDING') AS mutation_stops, count(*) FILTER (c_nationkey > 12) AS partial_states, count(*) FILTER (c_mktsegment = 'BUILDING') AS branch_stops, (SELECT count(*) FROM orders) AS transitions_observed FROM customer""")
def crawl_coverage(spark: SparkSession, d: str) -> DataFrame:
    states = table(spark, d, "customer").selectExpr("c_custkey as state_id", "c_acctbal < 0 as boundary", "if(c_mktsegment = 'BUILDING', array('mutation-observed'), cast(array() as array<string>)) as stops", "if(c_nationkey > 12, 'partial', 'ready') as readiness")
    return summaries.runtime_coverage(states, table(spark, d, "orders"))


@query("""WITH r AS (SELECT CASE WHEN l_linestatus = 'F' THEN 'operation' ELSE 'endpoint' END AS domain, CASE l_returnflag WHEN 'A' THEN 'corroborated' WHEN 'N' THEN 'contract-only' ELSE 'conflicting' END AS status FROM lineitem),
s AS (SELECT d.x AS domain, t.x AS status FROM (SELECT unnest(['operation', 'endpoint', 'type']) AS x) d, (SELECT unnest(['corroborated', 'contract-only', 'product-only', 'ambiguous', 'conflicting']) AS x) t)
SELECT s.domain, s.status, count(r.status) AS results FROM s LEFT JOIN r USING (domain, status) GROUP BY ALL UNION ALL SELECT 'total', t.x, count(r.status) FROM (SELECT unnest(['corroborated', 'contract-only', 'product-only', 'ambiguous', 'conflicting']) AS x) t LEFT JOIN r ON r.status = t.x GROUP BY ALL""")
def contract_totals(spark: SparkSession, d: str) -> DataFrame:
    """Line items as results of a contract, zeros included."""
    rows = table(spark, d, "lineitem").selectExpr("if(l_linestatus = 'F', 'operation', 'endpoint') as domain", "case l_returnflag when 'A' then 'corroborated' when 'N' then 'contract-only' else 'conflicting' end as status")
    return summaries.contract_totals(rows, ["operation", "endpoint", "type"])


@query("SELECT l_linestatus AS domain, count(*) AS results, count(*) FILTER (l_returnflag = 'A') AS compared FROM lineitem GROUP BY ALL")
def contract_compared(spark: SparkSession, d: str) -> DataFrame:
    return summaries.contract_coverage(table(spark, d, "lineitem").selectExpr("l_linestatus as domain", "l_returnflag <> 'N' as has_contract", "l_returnflag <> 'R' as has_product"))


@query("SELECT '/v1/' || event_type AS value, CASE WHEN value > 50 THEN 'EU' END AS region, count(*) AS mentions, min(event_id) AS first_line FROM events GROUP BY ALL")
def endpoint_regions(spark: SparkSession, d: str) -> DataFrame:
    return summaries.endpoint_regions(table(spark, d, "events").selectExpr("concat('/v1/', event_type) as value", "if(value > 50, 'EU', null) as region", "event_id as line"))


@query("SELECT count(*) FILTER (value > 40) AS with_context, count(*) FILTER (NOT coalesce(value > 40, false)) AS without_context, coalesce(sum(user_id), 0)::BIGINT AS pairs_evaluated, count(*) FILTER (event_type = 'click') AS unique_matches, count(*) FILTER (event_type = 'view') AS ambiguous_matches FROM events")
def context_summary(spark: SparkSession, d: str) -> DataFrame:
    return summaries.ui_context(table(spark, d, "events").selectExpr("case event_type when 'click' then 'corroborated' when 'view' then 'ambiguous' else 'runtime-only' end as status", "if(value > 40, 'eligible', 'ambiguous-route-context') as context", "user_id as evaluated"))


_BUTTON = "concat(case p_size % 9 when 0 then 'Delete ' when 1 then 'Log in to ' else 'Show ' end, p_name)"
_TARGET = """CASE WHEN p_size % 9 = 0 THEN 'blocked|destructive-action-text:delete' WHEN p_size % 11 = 0 OR p_size % 13 = 0 THEN 'blocked|form-submission' WHEN p_size % 7 = 0 THEN 'blocked|unsupported-navigation-scheme:mailto'
  WHEN p_size % 7 = 1 THEN 'unknown|unresolved-navigation-destination' WHEN p_size % 7 = 2 THEN CASE WHEN p_size % 3 = 0 THEN 'blocked|cross-origin' ELSE 'allowed|safe-same-origin-navigation,no-destructive-signal,not-form-submit' END WHEN p_size % 7 = 3 THEN 'allowed|safe-same-origin-navigation,no-destructive-signal,not-form-submit'
  WHEN p_size % 2 = 0 AND p_partkey % 5 <> 0 AND p_size % 4 = 0 THEN 'allowed|strong-interaction-evidence,structural-navigation-context,no-destructive-signal,not-form-submit' WHEN p_size % 2 = 0 AND p_partkey % 5 <> 0 AND p_size % 9 = 1 THEN 'allowed|strong-interaction-evidence,authentication-entry,no-destructive-signal,not-form-submit'
  WHEN p_size % 2 = 0 THEN 'unknown|strong-interaction-without-safe-navigation-evidence' ELSE 'unknown|insufficient-safe-navigation-evidence' END"""


@query(f"SELECT p_partkey, split_part(told, '|', 1) AS decision, split_part(told, '|', 2) AS reasons FROM (SELECT p_partkey, {_TARGET} AS told FROM part)")
def probe_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Parts as targets of a page, by all rules of safety in their order."""
    rows = table(spark, d, "part").selectExpr(
        "p_partkey", "if(p_size % 2 = 0, 'interaction-candidate', 'semantic-element') as source", f"array({_BUTTON}, null, p_brand) as texts", "p_size % 11 = 0 as submits", "if(p_size % 13 = 0, 'submit', null) as input_type",
        "case p_size % 7 when 0 then 'mailto:x@a.test' when 1 then '/gone' when 2 then 'HTTPS://b.test/x' when 3 then '/here' end as declared",
        "case p_size % 7 when 0 then 'mailto:x@a.test' when 2 then if(p_size % 3 = 0, 'https://c.test/x', 'https://b.test/x') when 3 then '/here' end as resolved", "'https://a.test/page' as page_url",
        "if(p_size % 2 = 0, 'strong', 'weak') as strength", "if(p_size % 4 = 0, 'custom-navigation', 'none') as navigation", "array('strong-click-evidence', 'menu-context') as evidence", "p_partkey % 5 = 0 as in_form",
    )
    return crawl.probe_safety(rows, origins=["https://b.test"]).select("p_partkey", "decision", F.array_join("reasons", ",").alias("reasons"))


@query("""WITH b AS (SELECT conv_id, turn, CASE WHEN turn = 4 THEN 'heading' ELSE 'paragraph' END AS kind, 'Step ' || turn || ' of ' || conv_id || ' by x' || conv_id || '@mail.test' AS text FROM conversations)
SELECT conv_id AS document_id, turn AS block, CASE WHEN (conv_id + turn) % 4 = 0 THEN 'ledger' WHEN turn = 1 AND conv_id % 3 <> 0 THEN 'claim' WHEN turn = 2 THEN 'limitation' WHEN turn = 3 AND conv_id % 2 = 0 THEN 'screenshot' END AS source,
  CASE WHEN (conv_id + turn) % 4 = 0 THEN 'c' || turn || ',c1' WHEN turn = 1 AND conv_id % 3 <> 0 THEN 'c1' ELSE '' END AS claim_ids,
  CASE WHEN (conv_id + turn) % 4 = 0 THEN CASE WHEN conv_id % 3 = 0 AND EXISTS (SELECT 1 FROM b x WHERE x.conv_id = b.conv_id AND x.turn = 1) THEN 'ambiguous-statement' END WHEN (turn = 1 AND conv_id % 3 <> 0) OR turn = 2 OR (turn = 3 AND conv_id % 2 = 0) THEN NULL ELSE 'unsupported-statement' END AS issue
FROM b WHERE kind <> 'heading'""")
def revalidated_statements(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as edited articles, their turns as blocks: some stand in the ledger, as claims, limitations or pictures."""
    text = "concat('Step ', turn, ' of ', conv_id, ' by x', conv_id, '@mail.test')"
    rows = table(spark, d, "conversations").selectExpr("conv_id as document_id", "turn as block", "if(turn = 4, 'heading', 'paragraph') as kind", f"{text} as text", "turn", "conv_id")
    said = "concat('  STEP ', turn, '  of ', conv_id, ' by [the owner].')"
    ledger = rows.filter("(conv_id + turn) % 4 = 0").selectExpr("document_id", "turn as place", f"{said} as text", "array(concat('c', turn), 'c1') as claim_ids")
    claims = rows.filter("turn = 1").selectExpr("document_id", "'c1' as claim_id", "turn as place", f"{said} as text", "if(conv_id % 3 = 0, 'ambiguous', 'corroborated') as status", "true as publishable")
    limits = rows.filter("turn = 2").selectExpr("document_id", f"{said} as message")
    shots = rows.filter("turn = 3 and conv_id % 2 = 0").selectExpr("document_id", f"{text} as path")
    found = documents.revalidated(rows.select("document_id", "block", "kind", "text"), ledger, claims, limits, shots)
    return found.filter("block is not null").select("document_id", "block", "source", F.array_join("claim_ids", ",").alias("claim_ids"), "issue")


_HASH = "'knowledge-internal:' || substr(sha256({0}), 1, 16)".format


@query(f"""WITH i AS (SELECT {_HASH("kind || '|i' || k")} AS id, 'F' || o_custkey AS feature_id, kind, 'call ' || k AS label, 'n' || k AS node_id, NULL AS contract_id, 'R' || k AS result_id FROM (SELECT *, o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'http' ELSE 'graphql' END AS kind FROM orders WHERE o_orderstatus <> 'P')),
l AS (SELECT {_HASH("'contract|l' || l_orderkey || '-' || l_linenumber")} AS id, 'F' || l_suppkey AS feature_id, 'contract-operation' AS kind, 'query op' || l_partkey AS label, 'n' || l_partkey AS node_id, 'p' || l_partkey AS contract_id, 'R' || l_orderkey AS result_id FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10) AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 100000))
SELECT * FROM i UNION ALL SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY feature_id, id ORDER BY kind, label, node_id, contract_id, result_id) = 1""")
def knowledge_internal(spark: SparkSession, d: str) -> DataFrame:
    """Orders as requests and executions of customers' features, line items as their links to documented parts."""
    items = table(spark, d, "orders").selectExpr("concat('F', o_custkey) as feature_id", "case o_orderstatus when 'F' then 'http' when 'O' then 'graphql' else 'other' end as kind", "concat('i', o_orderkey) as item_id", "concat('call ', o_orderkey) as label", "concat('n', o_orderkey) as node_id", "concat('R', o_orderkey) as result_id")
    link = table(spark, d, "lineitem").selectExpr("concat('l', l_orderkey, '-', l_linenumber) as link_id", "concat('F', l_suppkey) as feature_id", "concat('n', l_partkey) as node_id", "concat('p', l_partkey) as operation_id", "concat('R', l_orderkey) as result_id")
    operations = table(spark, d, "part").filter("p_size > 10").selectExpr("concat('p', p_partkey) as operation_id", "'query' as type", "concat('op', p_partkey) as name")
    return knowledge.internal_evidence(items, link, operations, table(spark, d, "orders").filter("o_totalprice > 100000").selectExpr("concat('R', o_orderkey) as result_id"))


@query("""WITH c AS (SELECT 'F' || o_custkey AS feature_id, 'c' || o_orderkey AS claim_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'visible-outcome' ELSE 'user-action' END AS kind, CASE WHEN o_totalprice > 450000 THEN 'conflicting' WHEN o_totalprice > 400000 THEN 'ambiguous' ELSE 'corroborated' END AS status FROM orders)
SELECT feature_id, 'missing-evidence' AS kind, NULL AS claim_id, 'Success or error outcome was not observed in runtime evidence.' AS message FROM c GROUP BY feature_id HAVING NOT bool_or(kind = 'visible-outcome') UNION ALL SELECT DISTINCT feature_id, 'bounded-runtime', NULL, 'Runtime evidence was collected with bounded coverage.' FROM c
UNION ALL SELECT feature_id, CASE status WHEN 'ambiguous' THEN 'evidence-ambiguity' ELSE 'evidence-conflict' END, claim_id, kind || ' evidence is ' || status || ' and is not publishable.' FROM c WHERE status <> 'corroborated'""")
def knowledge_limitations(spark: SparkSession, d: str) -> DataFrame:
    """What orders as claims of customers' features do not show."""
    claims = table(spark, d, "orders").selectExpr("concat('F', o_custkey) as feature_id", "concat('c', o_orderkey) as claim_id", "if(o_orderpriority = '1-URGENT', 'visible-outcome', 'user-action') as kind", "case when o_totalprice > 450000 then 'conflicting' when o_totalprice > 400000 then 'ambiguous' else 'corroborated' end as status")
    return knowledge.limitations(claims)


@query("""SELECT 'i' || p_partkey AS item_id, CASE WHEN p_partkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000) OR p_partkey + 1 IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000) THEN 'ambiguous' ELSE 'corroborated' END AS status FROM part""")
def ui_claim_statuses(spark: SparkSession, d: str) -> DataFrame:
    """Parts as elements with two references each, large orders as ambiguous results."""
    items = table(spark, d, "part").selectExpr("concat('i', p_partkey) as item_id", "'corroborated' as status", "array(p_partkey, p_partkey + 1) as refs")
    return knowledge.ui_claim_status(items, table(spark, d, "orders").filter("o_totalprice > 480000").selectExpr("o_custkey as ref")).select("item_id", "status")


_CLAIM = """concat(case p_size % 6 when 0 then concat('Mail a', p_partkey, '@b.test for ') when 1 then 'See HTTPS://shop.test/x for ' when 2 then 'See https://example.com/x for ' when 3 then 'The client  name of ' else 'Select ' end, p_name)"""
_SIGNAL = "CASE p_size % 6 WHEN 0 THEN 'email-address' WHEN 1 THEN 'tenant-hostname' WHEN 3 THEN 'customer-identifier' END"


def _visible_claims(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr("cast(floor(p_partkey / 3) as bigint) as package_id", "concat('s', p_partkey % 2) as state_id", f"{_CLAIM} as text", "p_size <= 40 as visible")


@query(f"""SELECT p_partkey // 3 AS package_id, count(*) FILTER (p_size <= 40 AND {_SIGNAL} IS NOT NULL) > 0 AS tenant_specific,
  coalesce(array_to_string(list_sort(list_distinct(list({_SIGNAL}) FILTER (p_size <= 40 AND {_SIGNAL} IS NOT NULL))), ','), '') AS signals FROM part GROUP BY 1""")
def tenant_packages(spark: SparkSession, d: str) -> DataFrame:
    """Parts as claims, three to a package, and the signs of tenants in those that are shown."""
    return workspace.package_signals(_visible_claims(spark, d)).withColumn("signals", F.array_join(F.array_sort("signals"), ","))


@query(f"""WITH c AS (SELECT p_partkey // 3 AS package_id, 's' || (p_partkey % 2) AS state_id, {_SIGNAL} AS s FROM part WHERE p_size <= 40), g AS (SELECT package_id, state_id, count(*) AS related, count(s) AS n FROM c GROUP BY ALL)
SELECT p_partkey // 3 AS package_id, 's' || (p_partkey % 3) AS state_id, p_partkey || '.png' AS path, CASE WHEN n > 0 THEN 'known-tenant-information' ELSE 'unknown' END AS safety, coalesce(related, 0) AS related FROM part LEFT JOIN g ON g.package_id = p_partkey // 3 AND g.state_id = 's' || (p_partkey % 3)""")
def picture_reviews(spark: SparkSession, d: str) -> DataFrame:
    pictures = table(spark, d, "part").selectExpr("cast(floor(p_partkey / 3) as bigint) as package_id", "concat('s', p_partkey % 3) as state_id", "concat(p_partkey, '.png') as path")
    return workspace.picture_reviews(pictures, _visible_claims(spark, d)).drop("signals")


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS number, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS current FROM orders""")
def revision_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Orders as revisions of their customer's document."""
    rows = table(spark, d, "orders").selectExpr("o_custkey as document_id", "o_orderkey as revision_id", "o_orderdate as created_at")
    return workspace.numbered_revisions(rows).select(F.col("revision_id").alias("o_orderkey"), "number", "current")


@query("""SELECT DISTINCT user_id AS probe_id, CASE event_type WHEN 'click' THEN 'POST' WHEN 'view' THEN 'GET' WHEN 'purchase' THEN 'PUT' ELSE 'DELETE' END AS method FROM events WHERE value > 50 AND event_type <> 'view'
EXCEPT SELECT user_id, CASE event_type WHEN 'click' THEN 'POST' WHEN 'view' THEN 'GET' WHEN 'purchase' THEN 'PUT' ELSE 'DELETE' END FROM events WHERE value <= 3""")
def probe_mutations(spark: SparkSession, d: str) -> DataFrame:
    """Events with large values as traffic after a user's click, those with small ones as traffic before it."""
    rows = table(spark, d, "events").selectExpr("user_id as probe_id", "case event_type when 'click' then 'post' when 'view' then 'GET' when 'purchase' then 'Put' else 'delete' end as method", "value")
    return workspace.new_mutations(rows.filter("value <= 3"), rows.filter("value > 50"))


@query("SELECT user_id AS state_id, bool_or(value > 95 OR event_type = 'purchase') AS meaningful FROM events GROUP BY user_id")
def meaningful_states(spark: SparkSession, d: str) -> DataFrame:
    return workspace.meaningful_states(table(spark, d, "events").selectExpr("user_id as state_id", "if(value > 95, 'x', '') as name", "if(event_type = 'purchase', 'y', null) as text"))


@query("""SELECT 'u' || p_partkey AS node_id, CASE WHEN p_partkey % 4 <> 0 THEN 'c' || (p_partkey % 7) END AS component_id, CASE WHEN p_size % 5 = 0 THEN '' ELSE 'button' END AS s_tag, p_name AS s_text, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END AS s_aria, '' AS s_label, CASE WHEN p_size % 3 = 0 THEN 'first' ELSE '' END AS s_title, '' AS s_hint, '' AS s_type, p_size > 25 AS s_event FROM part""")
def static_descriptors(spark: SparkSession, d: str) -> DataFrame:
    """Parts as elements with open data."""
    props = """concat('[{"name":"type","valueType":"dynamic","value":"x"},7', if(p_size % 2 = 0, concat(',{"valueType":"string","name":"aria-label","value":"', p_brand, '"}'), ''), if(p_size % 3 = 0, ',{"name":"title","valueType":"string","value":"first"},{"name":"title","valueType":"string","value":"second"}', ''), ']')"""
    data = f"""concat('{{"props":', {props}, ',"name":', if(p_size % 5 = 0, '5', '"Button"'), '}}')"""
    rows = table(spark, d, "part")
    nodes = rows.selectExpr("concat('u', p_partkey) as id", "'ui-element' as type", "concat('button \"', p_name, '\"') as label", f"try_parse_json({data}) as data")
    edges = rows.filter("p_partkey % 4 <> 0").selectExpr("concat('b', p_partkey) as id", "'CONTAINS_ELEMENT' as type", "concat('c', p_partkey % 7) as src", "concat('u', p_partkey) as dst")
    edges = edges.unionByName(rows.filter("p_partkey % 4 <> 0").selectExpr("concat('c', p_partkey) as id", "'CONTAINS_ELEMENT' as type", "'later' as src", "concat('u', p_partkey) as dst"))
    return workspace.static_descriptors(nodes, edges.unionByName(rows.filter("p_size > 25").selectExpr("concat('e', p_partkey) as id", "'HAS_EVENT' as type", "concat('u', p_partkey) as src", "'x' as dst")))


@query("""SELECT 'c' || o_orderkey AS claim_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'internal-feature' WHEN '2-HIGH' THEN 'entry-point' WHEN '3-MEDIUM' THEN 'visible-ui' END AS source, CASE WHEN o_orderstatus = 'F' THEN 'F' || o_custkey ELSE o_orderstatus END AS text FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')""")
def identity_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").selectExpr("concat('c', o_orderkey) as claim_id", "case o_orderpriority when '1-URGENT' then 'feature-name' when '2-HIGH' then 'entry-point' when '3-MEDIUM' then 'visible-ui' else 'route' end as kind", "if(o_orderstatus = 'F', '', o_orderstatus) as text", "concat('F', o_custkey) as feature_name")
    return workspace.identity_candidates(rows)


@query("""SELECT count(*) FILTER (event_type = 'click') AS queries, count(*) FILTER (event_type = 'view') AS mutations, 0 AS subscriptions, count(*) FILTER (event_type NOT IN ('click', 'view')) AS unknown_operations, (SELECT count(*) FILTER (o_orderstatus = 'F') FROM orders) AS endpoints, (SELECT count(*) FILTER (o_orderstatus = 'O') FROM orders) AS types,
  0 AS authentication_requirements, (SELECT count(*) FILTER (o_orderstatus = 'P') FROM orders) AS pagination_evidence, 0 AS unresolved_evidence FROM events""")
def documentation_summary(spark: SparkSession, d: str) -> DataFrame:
    operations = table(spark, d, "events").selectExpr("case event_type when 'click' then 'query' when 'view' then 'mutation' else 'unknown' end as type")
    return workspace.documentation_summary(operations, table(spark, d, "orders").selectExpr("case o_orderstatus when 'F' then 'endpoint' when 'O' then 'type' else 'pagination' end as part"))


@query("""SELECT c_custkey AS feature_id, row_number() OVER (ORDER BY CASE WHEN c_nationkey > 12 THEN '/' || c_mktsegment ELSE '~' END, c_name, c_custkey) AS place FROM customer""")
def feature_places(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").selectExpr("c_custkey as feature_id", "c_name as name", "if(c_nationkey > 12, concat('/', c_mktsegment), null) as route")
    return workspace.ordered_features(rows).select("feature_id", "place")


@query("SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders")
def document_places(spark: SparkSession, d: str) -> DataFrame:
    return workspace.ordered_documents(table(spark, d, "orders").selectExpr("o_orderkey as id", "o_orderdate as updated_at")).select("id", "place")


@query("""SELECT 'R' || o_orderkey AS id, row_number() OVER (ORDER BY CASE WHEN o_custkey % 2 = 0 THEN 'http' ELSE 'ui' END, lower(o_orderstatus), o_orderstatus, 'R' || o_orderkey) AS place FROM orders""")
def result_places(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").selectExpr("concat('R', o_orderkey) as id", "if(o_custkey % 2 = 0, 'http', 'ui') as domain", "o_orderstatus as status")
    return workspace.ordered_results(rows).select("id", "place")


@query(r"""WITH c AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN ' Jo.' || conv_id || '@x ' WHEN 1 THEN 'no/slash' ELSE '' END AS name FROM conversations)
SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'Jo.' || conv_id || '@x' ELSE 'Local reviewer' END AS reviewer, CASE WHEN turn % 2 = 0 THEN '# T' || conv_id || chr(10) || 'mail [person] and a' || conv_id || '@b.c' || chr(10) END AS clean FROM c""")
def replaced_values(spark: SparkSession, d: str) -> DataFrame:
    """Turns as reviewers who replace the first of two equal addresses, in the block that holds it or in another one."""
    rows = table(spark, d, "conversations").select("conv_id", "turn")
    mail = F.concat(F.lit("a"), F.col("conv_id").cast("string"), F.lit("@b.c"))
    text = F.concat(F.lit(" # T"), F.col("conv_id").cast("string"), F.lit("\r\nmail "), mail, F.lit(" and "), mail, F.lit("\r\n\n"))
    name = F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" Jo."), F.col("conv_id").cast("string"), F.lit("@x "))).when(F.col("turn") % 3 == 1, F.lit("no/slash")).otherwise(F.lit(""))
    block = F.when(F.col("turn") % 2 == 0, F.lit(1)).otherwise(F.lit(0))
    rows = rows.withColumn("told", text).withColumn("mail", mail)
    return rows.select("conv_id", "turn", workspace.safe_reviewer(name).alias("reviewer"), workspace.replaced_in_block(F.col("told"), block, F.col("mail"), F.lit("[person]")).alias("clean"))


def queries() -> dict[str, Query]:
    return {name: function for name, (function, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FOUND.items()}
