"""Small tables that reach every branch of the queries over projections, and the rows that they must give where the SQL of a
query speaks of its own projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelake.plans.projected import SQL_TYPES, columns

class Inline:
    """Tables by name: (columns as 'name type, ...', rows)."""

    def __init__(self, tables: dict[str, tuple[str, list[tuple]]]):
        self.tables = tables

    def frame(self, spark: SparkSession, folder: str, name: str) -> DataFrame:
        told, rows = self.tables[name]
        return spark.createDataFrame(rows, told)

    def with_sql(self, *names: str) -> str:
        return "WITH " + ",\n".join(self.table_sql(n) for n in names)

    def table_sql(self, name: str) -> str:
        told = columns(self.tables[name][0])
        rows = ", ".join("(" + ", ".join(f"{_literal(v)}::{SQL_TYPES[k]}" for v, (_, k) in zip(r, told)) + ")" for r in self.tables[name][1])
        return f"{name}({', '.join(c for c, _ in told)}) AS (VALUES {rows})"


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(_literal, value)) + "]"
    if isinstance(value, float):
        return f"'{value}'"
    return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


DOC = """Welcome to the Query API.
Query:
  listOrders(page: Int = 1, filter: OrderFilter!): [Order!] - Lists  orders
Mutation addOrder(input: NewOrder!): Order
notASignature(oops)
Mutation
dropOrder(id: ID!): Boolean
Type Order - A sold thing
id: ID! - The key
total: Float
lines: [Line!]

stray: Text
Type Empty
GET /v1/orders/{id} returns one
US endpoint https://us.shop.test/graphql, EU: https://eu.shop.test/graphql).
Authorization: Bearer abc123
X-Colour: blue
Content-Type: application/json
Results come with cursor pagination of fifty rows. Done"""
OTHER = "Type Order\nid: String\nnote: Text\nSee https://plain.test/page for more" + " words" * 30
PAGE = """<html><body><section id="query-item" class="operation"><h2 class="operation-heading">item &amp; more</h2><div class="operation-response"><code>Item!</code></div>
<div class="operation-arguments"><table><tbody><tr><td class="property-name"><code>id</code></td><td class="property-type">Key <code>ID!</code></td></tr><tr><td>none</td></tr></tbody></table></div></section>
<section id="mutation-drop"><p>No heading</p></section></body></html>"""

EVIDENCE = Inline({
    "call_roots": ("node string", [("f",)]),
    "titles": ("id int, title string", [(1, "Order  List (2)"), (2, "Crème brûlée!"), (3, "CON"), (4, "///"), (5, None)]),
    "globs": ("id int, value string, pattern string", [(1, "src/deep/x.ts", "src/*/x.ts"), (2, "lib/x.ts", "src/*/x.ts"), (3, "same", "same"), (4, "a/b/c", "a/*/*"), (5, "ab", "a*b")]),
    "requests": ("node_id string, method string, url string", [("a1", "get", "/api/items"), ("a2", "GET", "/api/items"), ("b", "POST", "/api/items"), ("c", "DELETE", "/api/items/1"), ("d", None, "/api/x"), ("e", "GET", ""), ("f", "GET", "/api/one?q=1")]),
    "network": ("ref string, method string, url string, resource_type string", [("n1", "GET", "https://app.test/api/items", "fetch"), ("n2", "get", "https://app.test/api/items", "xhr"), ("n3", "POST", "https://app.test/api/items", "fetch"), ("n4", "POST", "https://app.test/api/items", "fetch"), ("n5", "GET", "https://app.test/main.js", "script"), ("n6", "GET", "https://app.test/telemetry", "ping"), ("n7", "GET", "https://app.test/api/one?q=1", "fetch"), ("n8", "POST", "https://app.test/graphql", "fetch")]),
    "executions": ("node_id string, endpoint string", [("g1", "/graphql"), ("g2", "https://app.test/graphql"), ("g3", None), ("g4", "/other")]),
    "navigations": ("node_id string, destination string, label string", [("v1", "/orders", "Orders"), ("v2", "/help", None), ("v3", "/two", None), ("v4", None, "x"), ("v5", "/gone", "Gone"), ("v6", "/two", "Second  one"), ("v7", "/two", "Third")]),
    "transitions": ("ref string, path string, label string, kind string", [("t1", "/orders", "orders ", "url-change"), ("t2", "/help", "Get help", "url-change"), ("t3", "/two", "First", "url-change"), ("t4", "/two", "second one", "url-change"), ("t5", "/lost", "", "same-url"), ("t6", "/new", "New", "url-change")]),
    "static_ui": ("node_id string, s_tag string, s_text string, s_aria string, s_label string, s_title string, s_hint string, s_type string, s_event boolean", [("u1", "Button", "Save", None, None, None, None, None, True), ("u2", "Button", "Cancel", "", "", "", "", "", False), ("u3", "button", "Cancel", None, None, None, None, None, False), ("u4", "input", None, "Subject", None, None, "Type here", "text", False), ("u5", "div", None, None, None, None, None, None, False), ("u6", "a", "Far", None, None, None, None, None, False), ("u7", "h2", None, None, "Title", None, None, None, False)]),
    "runtime_ui": ("ref string, state_id string, r_tag string, r_role string, r_name string, r_text string, r_hint string, r_type string, r_strong boolean", [("e1", "s1", "button", "button", "Save", "Save", None, None, True), ("e2", "s1", "div", "button", "cancel", "", None, None, False), ("e3", "s1", "input", "textbox", "subject", "", "type  here", "TEXT", False), ("e4", "s1", "input", "textbox", "Subject", "", None, "email", False), ("e5", "s2", "button", "button", "Save", "Save", None, None, True), ("e6", "s3", "a", "link", "Far", "Far", None, None, False), ("e7", "s1", "span", "heading", "Title", "x", None, None, False)]),
    "contexts": ("state_id string, route_id string, ambiguous boolean", [("s1", "r1", False), ("s2", None, True)]),
    "scopes": ("route_id string, node_id string", [("r1", "u1"), ("r1", "u2"), ("r1", "u3"), ("r1", "u4"), ("r1", "u5"), ("r1", "u7")]),
    "documented": ("operation_id string, name string, type string, n_variants int, return_type string", [("o1", "addOrder", "mutation", 1, "Order"), ("o2", "orders", "query", 1, "[ Order ]"), ("o3", "lost", "query", 1, None), ("o4", "both", "query", 1, "X"), ("o5", "flip", "query", 1, "X"), ("o6", "vague", "query", 2, None), ("o7", "GET /x", "unknown", 1, None), ("o8", "fine", "query", 1, "Y")]),
    "product": ("node_id string, name string, type string, return_type string, has_variables boolean", [("p1", "addOrder", "mutation", "Order", True), ("p2", "orders", "query", "[Order]", False), ("p3", "both", "query", "X", True), ("p4", "both", "query", "X", True), ("p5", "flip", "mutation", "X", True), ("p6", "vague", "query", None, True), ("p7", "extra", "query", None, False), ("p8", "fine", "query", "Y", True)]),
    "arguments": ("operation_id string, key string, type string, required boolean, default_value string", [("o1", "input", "New Order!", True, None), ("o1", "dry", "Boolean", False, "false"), ("o1", "old", "Int", False, None), ("o8", "a", "Int!", True, "1")]),
    "variables": ("node_id string, key string, type string, required boolean, default_value string", [("p1", "input", "NewOrder!", True, None), ("p1", "dry", "Int", None, "true"), ("p1", "fresh", "Int", False, None), ("p8", "a", "Int!", True, "1")]),
    "doc_endpoints": ("endpoint_id string, value string", [("x1", "https://app.test/graphql/"), ("x2", "https://eu.test/graphql"), ("x3", "https://seen.test/api")]),
    "code_endpoints": ("node_id string, value string", [("c1", "/graphql"), ("c2", "https://seen.test/api"), ("c3", "/never")]),
    "seen_endpoints": ("ref string, value string", [("w1", "https://app.test/graphql?x=1"), ("w2", "https://other.test/graphql")]),
    "origins": ("origin string", [("https://app.test",), ("https://other.test",)]),
    "doc_types": ("name string", [("Order",), ("Line",), ("Twice",), ("Gone",)]),
    "code_types": ("node_id string, name string", [("k1", "Order"), ("k2", "Line"), ("k3", "Twice"), ("k4", "Twice"), ("k5", "Fresh")]),
    "doc_fields": ("name string, field string, type string", [("Order", "id", "ID !"), ("Order", "total", "Float"), ("Order", "old", "Int"), ("Line", "id", "ID"), ("Twice", "id", "ID")]),
    "code_fields": ("node_id string, field string, type string", [("k1", "id", "ID!"), ("k1", "total", "Int"), ("k2", "id", "ID"), ("k2", "more", "Int"), ("k3", "id", "ID")]),
    "features": ("feature_id string, node_id string", [("f1", "p1"), ("f1", "p2"), ("f2", "p1"), ("f2", "p7")]),
    "executes": ("execution_id string, node_id string", [("g1", "p1"), ("g2", "p1"), ("g4", "p8")]),
    "transports": ("execution_id string, ref string", [("g1", "n8"), ("g2", "n8"), ("g1", "n9")]),
    "docs": ("doc_id int, content string", [(1, DOC), (2, OTHER), (3, PAGE), (4, None)]),
    "words": ("id int, a string, b string", [(1, "ui-element", 'button "Save all"'), (2, "route", "a b/c~(d)!'é"), (3, "static", ""), (4, "dynamic", "x"), (5, "static", "value"), (6, "./near", "src/*/x.ts"), (7, "@/alias", "src/deep/x.ts"), (8, "react", "<b>\"A\" & 'B'</b>"), (9, "onClick", "token: \"abc\""), (10, "Once", "Authorization: Bearer [REDACTED]"), (11, "Panel", "Authorization: Basic xyz"), (12, None, None), (13, "on", "[ Order ! ]")]),
    "boxes": ("id int, x double, y double, w double, h double", [(1, 0.0, 0.0, 10.006, 10.0), (2, 95.0, 0.0, 10.0, 5.0), (3, -1.0, 0.0, 5.0, 5.0), (4, 1.0, 1.0, 0.0, 5.0), (5, float("nan"), 1.0, 1.0, 1.0), (6, None, 1.0, 1.0, 1.0)]),
    "candidates": ("id int, signals array<string>, declared string, resolved string, context array<string>, callouts int, claims int, issues array<string>", [(1, ["focusable", "pointer-listener"], None, None, ["nav"], 2, 2, []), (2, ["focusable"], "/x", "https://a.test/x", [], 1, 2, []), (3, [], "", "", ["nav"], 0, 1, ["screenshot-unavailable"]), (4, ["inline-click-handler"], None, None, [], 2, 2, ["bounding-box-invalid"]), (5, ["hover"], None, None, [], 1, 1, ["claim-ineligible"]), (6, [], None, None, [], 0, 1, ["x"])]),
    "patterns": ("id int, pattern string, path string", [(1, "/shop/:item/:id?", "/shop/red-shoes/4711"), (2, "/:a/:b", "/Blue/x%20y"), (3, "/plain", "/plain/more"), (4, "/u/:token", "/u/0123456789abcdef0123")]),
    "usages": ("src string, name string, path string, line int", [("m1", "Card", "a.tsx", 3), ("m2", "Card", "a.tsx", 99), ("m3", "List", "b.tsx", 1), ("m4", "List", "b.tsx", 50), ("m5", "None", "c.tsx", 1)]),
    "components": ("id string, name string, path string, line int", [("q1", "Card", "a.tsx", 3), ("q2", "List", "b.tsx", 1), ("q3", "List", "b.tsx", 9)]),
    "tree": ("id string, parent string, kind string", [("root", None, "element"), ("frag", "root", "fragment"), ("kid", "frag", "element"), ("txt", "kid", "text"), ("leaf", "kid", "element"), ("other", None, "element")]),
    "edges": ("id string, type string, src string, dst string", [("1", "RENDERS_ROUTE", "r1", "A"), ("2", "RENDERS", "A", "B"), ("3", "RENDERS", "B", "A"), ("4", "CONTAINS_ELEMENT", "A", "u1"), ("5", "CONTAINS_ELEMENT", "u1", "u2"), ("6", "CONTAINS_ELEMENT", "B", "u3"), ("7", "RENDERS_ROUTE", "r2", "B"), ("8", "CALLS", "f", "g"), ("9", "CALLS", "g", "h"), ("10", "CALLS", "h", "f"), ("11", "CALLS", "x", "f")]),
    "route_ids": ("route_id string", [("r1",), ("r2",)]),
    "members": ("feature_id string, node string", [("F1", "A"), ("F1", "B"), ("F1", "u1"), ("F2", "f"), ("F2", "g")]),
    "shown": ("state_id string, route_id string, key string", [("s1", "r1", "menu"), ("s2", "r2", "menu"), ("s1", "r1", "form"), ("s3", "r1", "form")]),
    "exports": ("module string, name string, target string, from_module string, from_name string", [("m1", "a", "d1", None, None), ("m2", "a", None, "m1", "a"), ("m3", "a", None, "m2", "a"), ("m3", "a", None, "m4", "b"), ("m4", "b", "d2", None, None), ("m5", "x", None, "m6", "x"), ("m6", "x", None, "m5", "x"), ("m7", "y", None, "m8", "nope")]),
    "claims": ("claim_id string, feature_id string, kind string, text string, status string, state_id string, target_id string, transition_id string", [("c1", "f1", "action", "Press save", "corroborated", "s1", "e1", "t1"), ("c2", "f1", "outcome", "It is saved", "runtime-only", "s1", "e2", None), ("c3", "f1", "route", "Open it", "static-only", None, None, None), ("c4", "f2", "action", "Lost", "ambiguous", "s1", "e9", None), ("c5", "f2", "action", "Twice", "corroborated", "s2", "d", "t2")]),
    "targets": ("state_id string, target_id string, x double, y double, w double, h double", [("s1", "e1", 1.0, 1.0, 5.0, 5.0), ("s1", "e2", 99.0, 1.0, 5.0, 5.0), ("s2", "d", 1.0, 1.0, 2.0, 2.0), ("s2", "d", 3.0, 1.0, 2.0, 2.0)]),
    "screenshots": ("state_id string, path string", [("s1", "s1.png")]),
    "statements": ("section string, idx int, text string, claim_ids array<string>", [("steps", 0, "Press save.", ["c1"]), ("steps", 1, "Guess", []), ("notes", 0, "Odd", ["c9", "c4"])]),
    "audits": ("doc_id string, number int, action string, status string, warnings int", [("d1", 1, "created", "passed", 0), ("d1", 2, "edited", "passed", 0), ("d1", 3, "approved", "passed", 0), ("d2", 1, "created", "failed", 0), ("d2", 2, "approved", "failed", 1), ("d3", 1, "approved", "passed", 0)]),
})

MODEL = Inline({
    "reported": ("feature_id string, name string, route string", [("F1", "Shop", "/shop"), ("F2", " ", None), ("F3", "Page", None)]),
    "aliases": ("path string, pattern string, targets array<string>", [("base/tsconfig.json", "@lib/*", ["gone/*", "*"]), ("base/tsconfig.json", "@out/*", ["../../*"]), ("base/tsconfig.json", "*", ["nope/*"]), ("base/tsconfig.json", "exact", ["x"])]),
    "seeds": ("feature_id string, route_id string, navigation_id string, pattern string, place int", [("F1", "r1", None, "/shop/:item", 1), ("F2", "r2", None, "about", 2), ("F3", None, "v9", None, 3), ("F4", "r1", "v2", "/shop/:item", 4), ("F5", "r5", None, "/:a/:b", 5), ("F6", "r6", None, "/:id", 6), ("F7", "r7", None, "/", 7)]),
    "links": ("id string, type string, src string, dst string", [("1", "ROUTE_RENDERS_COMPONENT", "r1", "C1"), ("2", "CONTAINS_ELEMENT", "C1", "u1"), ("3", "CONTAINS_ELEMENT", "C1", "u2"), ("4", "HAS_EVENT", "u1", "e1"), ("5", "BINDS_TO", "e1", "f"), ("6", "CALLS", "f", "g"), ("7", "CALLS", "g", "f"), ("8", "PERFORMS_HTTP_REQUEST", "g", "h1"), ("9", "PERFORMS_GRAPHQL_EXECUTION", "f", "x1"), ("10", "USES_DOCUMENT", "x1", "d1"), ("11", "EXECUTES_OPERATION", "x1", "o1"), ("12", "NAVIGATES_TO", "v1", "r1"), ("13", "NAVIGATES_TO", "u2", "r2"), ("14", "NAVIGATES_TO", "v9", "r2"), ("15", "NAVIGATES_TO", "lost", "r2"), ("16", "NAVIGATES_TO", "v1", "gone"), ("17", "ROUTE_RENDERS_COMPONENT", "r2", "C1")]),
    "results": ("result_id string, status string", [("R1", "corroborated"), ("R2", "ambiguous"), ("R3", "static-only"), ("R4", "runtime-only")]),
    "refs": ("result_id string, kind string, ref string", [("R1", "node", "u1"), ("R1", "state", "s1"), ("R2", "node", "u1"), ("R3", "node", "nobody"), ("R4", "state", "s2"), ("R4", "transition", "t1")]),
    "parts": ("feature_id string, kind string, ref string", [("F1", "node", "u1"), ("F1", "state", "s1"), ("F2", "state", "s2"), ("F2", "transition", "t1"), ("F3", "node", "u1")]),
    "states": ("feature_id string, state_id string, place int", [("F1", "s1", 1), ("F1", "s2", 2), ("F1", "s3", 3), ("F2", "s4", 1), ("F5", "s5", 1), ("F5", "s6", 2), ("F6", "s7", 1), ("F7", "s8", 1), ("F4", "s9", 1)]),
    "selected": ("result_id string, route_id string, state_id string, path string", [("A3", "r1", "s1", "/shop/red-shoes"), ("A2", "r1", "s2", "/shop/4711"), ("A1", "r1", "s3", "/shop/blue_hat"), ("A5", "r5", "s5", "/north/east"), ("A6", "r5", "s6", "/north/west"), ("A7", "r6", "s7", "/4711"), ("A8", "r7", "s8", "/"), ("A9", "r2", "s9", "/about")]),
    "observed": ("feature_id string, place int, label string, evidence_id string", [("F1", 1, " Shop  now", "t1"), ("F1", 2, "Shop now", "l1"), ("F2", 1, "One", "t2"), ("F2", 2, "Two", "t3"), ("F3", 1, "", "l3")]),
    "candidates": ("feature_id string, source string, place int, name string, evidence_id string, detail string", [("F1", "component", 1, "ShopPage", "C1", None), ("F1", "runtime-heading", 2, "Second", "h2", None), ("F1", "runtime-heading", 1, " First ", "h1", None), ("F2", "navigation-label", 1, "", "v1", None), ("F2", "route-identity", 1, "Shop / Hat", "A1", "route-bound-value"), ("F2", "route-segment", 1, "Shop", "r2", None), ("F3", "runtime-name", 1, "Page", "s9", None), ("F4", "runtime-name", 1, None, "s9", None)]),
    "moves": ("id string, src string, dst string, label string, after_url string", [("t1", "s1", "s4", "Go", "https://a.test/about"), ("t2", "s4", "s1", None, None), ("t3", "s1", "s2", "Next", None), ("t4", "s1", None, "Lost", None), ("t5", "s9", "s4", "Go", "https://a.test/about")]),
    "menus": ("feature_id string, node_id string, label string, node_label string, destination string", [("F1", "v1", "Shop", "nav", "/shop"), ("F1", "v2", "", "nav two", None), ("F2", "v1", None, "nav", "/shop")]),
    "shells": ("feature_id string, route_id string, pattern string, key string", [("F1", "r1", "/shop/:item", "menu"), ("F4", "r1", "/shop/:item", "menu"), ("F1", "r1", "/shop/:item", "form"), ("F2", "r2", "about", "menu"), ("F8", "r2", "about", "menu"), ("F3", None, None, "menu")]),
    "evidence": ("kind string, evidence_id string, detail string", [("static-node", "n1", "component"), ("static-node", "n2", "callable"), ("static-node", "n3", "route"), ("static-edge", "n1", None), ("runtime-state", "s1", None), ("runtime-transition", "t1", None), ("reconciliation", "R1", "ambiguous"), ("reconciliation", "R2", "static-only")]),
    "used": ("kind string, evidence_id string", [("static-node", "n3"), ("runtime-state", "n1")]),
    "named": ("feature_id string, name string, route string", [("F1", "Shop", "/shop"), ("F2", " ", None), ("F3", "Page", None), ("F3", "Page", None)]),
    "lines": ("feature_id string, section string, label string, status string", [("F1", "UI", "Save", "corroborated"), ("F1", "ACTION", "save", None), ("F3", "UI", "Menu", "static")]),
    "files": ("path string", [("src/a.ts",), ("src/b/index.tsx",), ("src/two.ts",), ("src/two.js",), ("lib/x.ts",), ("packages/ui/main.ts",), ("packages/ui/button.tsx",), ("packages/core/index.ts",), ("packages/core/deep/part.js",), ("app/lib/x.ts",)]),
    "imports": ("import_id int, file string, specifier string", [(1, "src/main.ts", "./a"), (2, "src/b/c.ts", "../two"), (3, "src/b/c.ts", "../../lib/x.ts"), (4, "src/main.ts", "./b"), (5, "src/main.ts", "./nothing"), (6, "src/main.ts", "../../out"), (7, "src/main.ts", "@org/ui"), (8, "src/main.ts", "@org/ui/button"), (9, "src/main.ts", "@org/core"), (10, "src/main.ts", "@org/core/deep/part"), (11, "src/main.ts", "@org/twin"), (12, "src/main.ts", "@org/uikit"), (13, "app/main.ts", "@lib/x"), (14, "app/main.ts", "@lib/gone"), (15, "app/main.ts", "@out/x"), (16, "src/main.ts", "lib/x"), (17, "app/main.ts", "exact"), (18, "app/sub/y.ts", "lib/x"), (19, "src/main.ts", "react")]),
    "owners": ("path string, name string, workspaces array<string>, entries array<string>", [("package.json", "root", ["packages/*", "tools/"], []), ("packages/ui/package.json", "@org/ui", [], ["main", "gone.ts"]), ("packages/core/package.json", "@org/core", [], []), ("packages/core/deep/package.json", "@org/deep", [], []), ("tools/package.json", "tools", [], []), ("other/package.json", None, [], []), ("packages/t1/package.json", "@org/twin", [], []), ("packages/t2/package.json", "@org/twin", [], [])]),
    "settings": ("path string, extends string, base_url string", [("app/tsconfig.json", "base/tsconfig.json", None), ("base/tsconfig.json", None, "../lib"), ("x/a.json", "x/b.json", "."), ("x/b.json", "x/c.json", None), ("x/c.json", "x/b.json", "./in"), ("y/tsconfig.json", "none.json", None)]),
    "page_targets": ("state_id string, target_id string, source string, role string, tag string, dom_path string, declared string, resolved string, navigation string, strength string", [("s1", "a", "semantic-element", "link", "a", "p2", "/x", "https://a.test/x", None, None), ("s1", "b", "semantic-element", "link", "a", "p1", "#top", "https://a.test/page#top", None, None), ("s1", "c", "semantic-element", "link", "a", "p1", "#/app", "https://a.test/page#/app", None, None), ("s1", "d", "semantic-element", "textbox", "input", "p1", None, None, None, None), ("s1", "e", "semantic-element", "img", "img", "p1", None, None, None, None), ("s1", "f", "interaction-candidate", None, "div", "p1", None, None, "custom-navigation", "strong"), ("s1", "g", "interaction-candidate", None, "div", "p1", None, None, "custom-navigation", "weak"), ("s1", "h", "semantic-element", "button", "button", "p1", None, None, None, None), ("s1", "i", "interaction-candidate", None, "div", "p1", None, None, None, None), ("s2", "a", "semantic-element", "link", "a", "p1", "#else", "https://a.test/other#else", None, None)]),
    "pages_seen": ("state_id string, origin string, mutated boolean", [("s1", "https://a.test", False), ("s2", "https://b.test", True), ("s3", "https://a.test", False), ("s4", "https://a.test", False), ("s5", "https://a.test", None)]),
    "widgets": ("state_id string, role string, input_type string, name string", [("s1", "textbox", "password", "Code"), ("s3", "textbox", None, "User"), ("s3", "button", None, "Next"), ("s4", "textbox", None, "User"), ("s4", "button", None, "Search")]),
    "words_seen": ("state_id string, place int, text string", [("s3", 1, "Please sign"), ("s3", 2, "in here"), ("s4", 1, "login"), ("s5", 1, "cataloging")]),
    "wanted": ("state_id string, target_id string, tag string, text string", [("s1", "a", "a", "Go  on"), ("s1", "b", "a", ""), ("s1", "c", "a", "Old"), ("s1", "d", "a", "x"), ("s1", "e", "a", "x"), ("s1", "f", "b", "x")]),
    "present": ("state_id string, target_id string, tag string, text string", [("s1", "a", "a", "Go on"), ("s1", "b", "a", "Any"), ("s1", "c", "a", "New"), ("s1", "d", "a", "x"), ("s1", "d", "a", "x"), ("s1", "f", "a", "x")]),
    "attempts": ("src string, dst string, target_id string, failed boolean", [("s1", "s2", "a", False), ("s1", None, "b", None), ("s1", None, "c", True)]),
    "callouts": ("callout_id string, step int, state_id string, path string, number int", [("c1", 1, "s1", "one.png", 2), ("c2", 1, "s1", "one.png", 1), ("c3", 2, "s2", "two.png", 1), ("c4", 2, "s2", "two.png", 3), ("c4", 3, "s2", "two.png", 3), ("c5", 3, "s3", "gone.png", 1)]),
    "shots": ("state_id string, path string", [("s1", "one.png"), ("s2", "two.png"), ("s3", "three.png")]),
    "guides": ("step int, status string", [(1, "mapped"), (2, "no-visual-target"), (4, "mapped"), (5, "no-visual-target")]),
    "entries": ("feature_id string, package_id string, path string, updated string", [("F1", "p1", "a.json", "2024-01-02"), ("F1", "p1", "b.json", "2024-01-01"), ("F1", "p2", "a.json", "2024-01-03")]),
    "detected": ("warning_id string, state string", [("w1", "open"), ("w2", "open")]),
    "redacted": ("warning_id string, state string", [("w2", "redacted"), ("w3", "redacted")]),
    "found": ("target_id string, place int, evidence array<string>", [("d1", 1, ["a", "b"]), ("d1", 2, ["c"]), ("d1", 3, ["d"]), ("d2", 1, [])]),
})

EXPECTED = {
    'api_facts': "SELECT * FROM (VALUES (1, 'endpoint', 'https://us.shop.test/graphql', 'US'), (1, 'endpoint', 'https://eu.shop.test/graphql', 'EU'), (1, 'header', 'Authorization: Bearer [REDACTED]', 'Bearer'), (1, 'header', 'Content-Type: application/json', NULL),\n  (1, 'pagination', 'Results come with cursor pagination of fifty rows', NULL), (1, 'style', 'graphql', NULL), (2, 'style', 'unknown', NULL), (3, 'style', 'unknown', NULL)) v(doc_id, part, value, detail)",
    'crawl_stops': "SELECT * FROM (VALUES ('s1', 'form-state', false), ('s2', 'mutation-observed,origin-boundary', false), ('s3', 'form-state', false), ('s4', '', true), ('s5', '', true)) v(state_id, stops, expandable)",
    'documented_types': "SELECT * FROM (VALUES ('Order', 2, 5, true)) v(type_name, n_definitions, n_fields, conflict)",
    'element_tree': "SELECT * FROM (VALUES ('root', 'root', 0), ('root', 'kid', 1), ('root', 'leaf', 2), ('other', 'other', 0)) v(owner, id, depth)",
    'export_names': "SELECT * FROM (VALUES (1, 'order-list-2'), (2, 'creme-brulee'), (3, 'document-con'), (4, 'document'), (5, 'document')) v(id, name)",
    'feature_route_identity': "SELECT * FROM (VALUES ('F1', 'A1', '/shop/:item', '/shop/:item|/shop/red-shoes', 'Shop / Blue Hat', 'route-bound-value'),\n  ('F5', 'A5', '/:a/:b', '/:a/:b|/north/east', 'North / West', 'runtime-route-structure'), ('F6', 'A7', '/:id', '/:id|/:opaque', '/:id', 'route-pattern'), ('F7', 'A8', '/', '/|/', 'Root', 'route-literal')) v(feature_id, result_id, pattern, identity_key, name, source)",
    'feature_route_names': "SELECT * FROM (VALUES ('F1', 'Item'), ('F2', 'About'), ('F4', 'Item'), ('F5', 'B'), ('F6', 'Id'), ('F7', 'Root')) v(feature_id, name)",
    'html_operations': "SELECT * FROM (VALUES (3, 'query', 'item & more', 'Item!', 'id:ID!'), (3, 'mutation', 'drop', NULL, '')) v(doc_id, type, name, return_type, arguments)",
    'module_aliases': "SELECT * FROM (VALUES (13, 'app/tsconfig.json', 'path-alias', 'resolved', 'lib/x.ts'), (14, 'app/tsconfig.json', 'path-alias', 'configured-path-alias-target-not-found', NULL), (15, 'app/tsconfig.json', 'path-alias', 'configured-path-alias-outside-repository', NULL),\n  (17, 'app/tsconfig.json', 'path-alias', 'resolved', 'lib/x.ts'), (18, 'app/tsconfig.json', 'path-alias', 'configured-path-alias-target-not-found', NULL)) v(import_id, config, kind, status, path)",
    'module_configuration_errors': "SELECT * FROM (VALUES ('x/b.json', 'Circular configuration extends chain'), ('y/tsconfig.json', 'Unsupported or missing extends target: none.json')) v(path, message)",
    'module_configurations': "SELECT * FROM (VALUES ('app/tsconfig.json', 'lib', 4), ('base/tsconfig.json', 'lib', 4), ('x/a.json', 'x', 0), ('x/b.json', 'x/in', 0), ('x/c.json', 'x/in', 0), ('y/tsconfig.json', NULL, 0)) v(path, base_url, n_paths)",
    'module_packages': "SELECT * FROM (VALUES (7, '@org/ui', 'resolved', 'packages/ui/main.ts'), (8, '@org/ui', 'resolved', 'packages/ui/button.tsx'), (9, '@org/core', 'resolved', 'packages/core/index.ts'),\n  (10, '@org/core', 'resolved', 'packages/core/deep/part.js'), (11, '@org/twin', 'ambiguous-module', NULL)) v(import_id, package, status, path)",
    'module_relative': "SELECT * FROM (VALUES (1, 'resolved', 'src/a.ts'), (2, 'ambiguous-module', NULL), (3, 'resolved', 'lib/x.ts'), (4, 'resolved', 'src/b/index.tsx'), (5, 'module-not-found', NULL), (6, 'module-not-found', NULL)) v(import_id, status, path)",
    'pattern_stars': "SELECT * FROM (VALUES (1, 'deep'), (2, NULL), (3, ''), (4, NULL), (5, '')) v(id, star)",
    'resolved_exports': "SELECT * FROM (VALUES ('m1', 'a', 'resolved', 'd1'), ('m2', 'a', 'resolved', 'd1'), ('m3', 'a', 'ambiguous', NULL), ('m4', 'b', 'resolved', 'd2'), ('m5', 'x', 'circular', NULL), ('m6', 'x', 'circular', NULL), ('m7', 'y', 'not-found', NULL)) v(module, name, status, target)",
    'review_states': "SELECT * FROM (VALUES ('d1', 1, 'draft', true), ('d1', 2, 'needs-review', true), ('d1', 3, 'approved', true), ('d2', 1, 'draft', true), ('d2', 2, 'approved', false), ('d3', 1, 'approved', false)) v(doc_id, number, state, legal)",
    'route_bindings': "SELECT * FROM (VALUES (1, '/shop/:item/:id?|/shop/red-shoes/:opaque', '/shop/red-shoes/[opaque]', 'item:stable-slug:red-shoes,id:opaque-identifier:'), (2, '/:a/:b|/blue/:opaque', '/Blue/[opaque]', 'a:stable-slug:Blue,b:opaque-identifier:'),\n  (3, '/plain|/plain/more', '/plain/more', ''), (4, '/u/:token|/u/:opaque', '/u/[opaque]', 'token:opaque-identifier:')) v(id, key, path, bindings)",
    'text_operations': "SELECT * FROM (VALUES (1, 3, 'query', 'listOrders', '[Order!]', 'Lists orders', 'page:Int:1,filter:OrderFilter!:'), (1, 4, 'mutation', 'addOrder', 'Order', NULL, 'input:NewOrder!:'), (1, 7, 'mutation', 'dropOrder', 'Boolean', NULL, 'id:ID!:'),\n  (1, 15, 'unknown', 'GET /v1/orders/{id}', NULL, NULL, '')) v(doc_id, line, type, name, return_type, description, arguments)",
}
