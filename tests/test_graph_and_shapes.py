"""The evidence graph, chains, orders, trees, scans and rules on hand-made cases."""

import os
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tracelake.functions import routes as R
from tracelake.functions.variants import canonical_json
from tracelake.operators import chains, evidence_graph, fingerprints, graph, modules, ordering, projections, rules, trees
from tracelake.sources import repository


def frames(spark, **tables):
    return {name: spark.createDataFrame(rows, evidence_graph.MANIFESTS[name]) for name, rows in tables.items()}


def example(spark, resolved=True):
    """A page with a list that loads and opens what its rows show."""
    tables = frames(
        spark,
        components=[
            (1, "List", "list.tsx", "list.tsx:1-20", "named", [("list.tsx:2-9", "div", None, None), ("list.tsx:3-3", "button", "Load it", "list.tsx:2-9"), ("list.tsx:3-3", "i", "", "list.tsx:3-3")], [("Row", "Row", "list.tsx", "list.tsx:5-5"), ("Row", "Row", "list.tsx", "list.tsx:6-6"), ("Lost", "Lost", "list.tsx", "list.tsx:7-7"), ("Ui", "Ui.Box", "list.tsx", "list.tsx:8-8"), ("Far", "Far", "list.tsx", "list.tsx:8-8"), ("Odd", "Odd", "list.tsx", "list.tsx:9-9")]),
            (2, "Row", "list.tsx", "list.tsx:30-40", None, None, None), (3, "FarAway", "far.tsx", "far.tsx:1-2", None, [], []),
        ],
        callables=[("f", "load", "list.tsx:50-52", "function"), ("g", "open", "far.tsx:5-6", "function"), ("h", "<inline-callback>", "list.tsx:4-4", "arrow")],
        routes=[(1, "object", "app.tsx", "app.tsx:1-1", "/", "static", "List", "list.tsx", "list.tsx:1-20", None, None), (2, "object", "app.tsx", "app.tsx:2-2", "/far", "static", "Far", "app.tsx", "app.tsx:2-2", None, None), (3, "object", "app.tsx", "app.tsx:3-3", "/far", "static", None, None, None, "lazy()", "It is loaded"), (4, "object", "app.tsx", "app.tsx:4-4", "p", "dynamic", "No", "app.tsx", "app.tsx:4-4", None, None)],
        navigations=[(1, "nav.tsx:1-1", "Link", "", "/", "static"), (2, "nav.tsx:2-2", "Link", "Far", "/far", "static"), (3, "nav.tsx:3-3", "a", "No", "/no", "static"), (4, "nav.tsx:4-4", "a", "x", "to", "dynamic")],
        actions=[
            (1, "List", "list.tsx:3-3", "onClick", "list.tsx:3-3", "list.tsx", "local", "load", "list.tsx:50-52", None, "load"), (2, "List", "list.tsx:3-3", "onClick", "list.tsx:3-3", "list.tsx", "inline", None, "list.tsx:4-4", None, "() => 1"),
            (3, "List", "list.tsx:3-3", "onKey", "list.tsx:3-3", "list.tsx", "imported", "open", None, "./far", None), (4, "List", "list.tsx:3-3", "onX", "list.tsx:3-3", "list.tsx", "member", None, None, None, "a.b"), (5, "None", "list.tsx:3-3", "onClick", "list.tsx:3-3", "list.tsx", "local", "load", "list.tsx:50-52", None, None),
        ],
        calls=[(1, "f", "local", "g", None, None, None, "list.tsx", "list.tsx:51-51"), (2, "f", "local", "g", None, None, None, "list.tsx", "list.tsx:52-52"), (3, "f", "local", "gone", None, None, None, "list.tsx", "list.tsx:52-52"), (4, "f", "imported", None, "open", "./far", None, "list.tsx", "list.tsx:52-52"), (5, "g", "member-expression", None, None, None, "ns.go", "far.tsx", "far.tsx:6-6"), (6, "g", "dynamic", None, None, None, "x()", "far.tsx", "far.tsx:6-6")],
        requests=[(1, "list.tsx:51-51", "GET", "/api", "f"), (2, "list.tsx:51-51", "GET", "/api", None)],
        documents=[("D", "ITEMS", "q.ts:1-9", "ok", [("query", "items", "q.ts:2-3"), ("mutation", None, "q.ts:4-5"), ("mutation", "two", "q.ts:6-7")]), ("E", "BAD", "e.ts:1-1", "invalid", [("query", "x", "e.ts:1-1")])],
        executions=[(1, "x.ts:1-1", "hook", "useQuery", "query", "f", "static", "D", None), (2, "x.ts:2-2", "hook", "useMutation", "mutation", None, "static", "D", None), (3, "x.ts:3-3", "hook", "useQuery", "query", None, "static", "gone", None), (4, "x.ts:4-4", "hook", "useQuery", "query", None, "dynamic", None, "doc"), (5, "x.ts:5-5", "hook", "useQuery", "query", None, "static", "E", None)],
    )
    if resolved:
        tables |= frames(spark, symbols=[("import", "list.tsx", "open", "./far", None, "callable", "g", "far.tsx:5-6"), ("import", "list.tsx", "Far", "./far", None, "component", None, "far.tsx:1-2"), ("import", "list.tsx", "Odd", "./odd", None, "component", None, "odd.tsx:1-2"), ("namespace-member", "far.tsx", "go", "./ns", "far.tsx:6-6", "callable", "f", "list.tsx:50-52")], failures=[(1, "import", "list.tsx", "Lost", "./lost", "module-not-found"), (2, "import", "app.tsx", "Far", "./far", "ambiguous-module")])
    return tables


def test_graph_of_an_application(spark):
    found = evidence_graph.build_graph(example(spark))
    nodes = {r.id: (r.type, r.label) for r in found.nodes.collect()}
    assert nodes["ui-element:list.tsx:3-3:button"] == ("ui-element", 'button "Load it"') and nodes["navigation:nav.tsx:1-1:Link%3A/"] == ("navigation", "Link") and nodes["ui-element:list.tsx:3-3:i"] == ("ui-element", "i")
    assert sum(t == "ui-event" for t, _ in nodes.values()) == 4 and "ui-event:list.tsx:3-3:onClick#2" in nodes and "http-request:list.tsx:51-51:GET%3A/api#2" in nodes
    assert "graphql-document:D:operation:1:mutation:anonymous" in nodes and not any(k.startswith("graphql-document:E:op") for k in nodes)
    edges = {(r.type, r.src.split(":")[-1], r.dst.split(":")[-1], len(r.evidence)) for r in found.edges.collect()}
    ids = {r.id for r in found.edges.collect()}
    assert {("COMPONENT_RENDERS_COMPONENT", "List", "Row", 2), ("COMPONENT_RENDERS_COMPONENT", "List", "FarAway", 2), ("CALLS", "f", "g", 1), ("CALLS", "f", "g", 2), ("CALLS", "g", "f", 2)} <= edges
    assert {"edge:CALLS:callable:f->callable:g", "edge:CALLS:callable:f->callable:g#2", "edge:CALLS:callable:f->callable:g#3"} <= ids
    assert ("CONTAINS_ELEMENT", "div", "button", 1) in edges and ("CONTAINS_ELEMENT", "List", "div", 1) in edges and ("BINDS_TO", "onClick#2", "h", 1) in edges and ("BINDS_TO", "onKey", "g", 2) in edges
    reasons = sorted((r.type, r.reference, r.reason, r.source) for r in found.unresolved.collect())
    assert reasons == sorted([
        ("COMPONENT_RENDERS_COMPONENT", "Lost", "Module resolution failed: module-not-found", "module-resolution"), ("COMPONENT_RENDERS_COMPONENT", "Ui.Box", "JSX member component could not be uniquely resolved", "ui-structure"), ("COMPONENT_RENDERS_COMPONENT", "Odd", "Resolved render symbol has no matching UI component", "module-resolution"),
        ("ROUTE_RENDERS_COMPONENT", "Far", "Module resolution failed: ambiguous-module", "route-navigation"), ("ROUTE_RENDERS_COMPONENT", "lazy()", "It is loaded", "route-navigation"), ("ROUTE_RENDERS_COMPONENT", "No", "Associated route component is not a same-file UI component", "route-navigation"),
        ("NAVIGATES_TO", "/far", "Multiple routes have this path", "route-navigation"), ("NAVIGATES_TO", "/no", "No discovered route has this path", "route-navigation"), ("NAVIGATES_TO", "to", "Navigation destination is dynamic", "route-navigation"),
        ("BINDS_TO", "a.b", "Handler binding is member", "action-binding"), ("CALLS", "x()", "Call binding is dynamic", "function-call"), ("EXECUTES_OPERATION", "mutation", "Document has multiple matching operations", "graphql-operation"), ("EXECUTES_OPERATION", "query", "Document has no matching operation", "graphql-operation"),
        ("USES_DOCUMENT", "gone", "Referenced GraphQL document is absent", "graphql-operation"), ("USES_DOCUMENT", "doc", "GraphQL document reference is dynamic", "graphql-operation"),
    ])
    assert evidence_graph.graph_issues(found).collect() == []


def test_graph_without_symbols_and_its_tables(spark, tmp_path):
    found = evidence_graph.write_graph(evidence_graph.build_graph(example(spark, resolved=False)), str(tmp_path))
    reasons = {(r.type, r.reference, r.reason) for r in found.unresolved.collect()}
    assert {("BINDS_TO", "open from ./far", "Handler binding is imported"), ("CALLS", "open from ./far", "Call binding is imported"), ("CALLS", "ns.go", "Call binding is member-expression"), ("COMPONENT_RENDERS_COMPONENT", "Lost", "Rendered component reference could not be resolved")} <= reasons
    assert "PartitionFilters: [isnotnull(type" in found.nodes.filter("type = 'route'")._jdf.queryExecution().toString()
    assert evidence_graph.node(found, "callable:f").count() == 1 and evidence_graph.outgoing(found, "callable:f").filter("type = 'CALLS'").count() == 2 and evidence_graph.incoming(found, "callable:g").count() == 2
    broken = found._replace(nodes=found.nodes.filter("id <> 'callable:g'"), unresolved=found.unresolved.withColumn("src", F.lit("no")))
    kinds = {r.rule for r in evidence_graph.graph_issues(broken).collect()}
    assert kinds == {"missing-source", "missing-target", "unresolved-missing-source"} - ({"missing-source"} if not found.edges.filter("src = 'callable:g'").count() else set())
    with pytest.raises(ValueError):
        evidence_graph.build_graph({"pictures": found.nodes})


def test_empty_manifests_and_roots(spark):
    found = evidence_graph.build_graph(frames(spark, components=[], calls=[]))
    assert [part.count() for part in found] == [0, 0, 0]
    roots = spark.createDataFrame([("a", "/r"), ("b", "/r"), ("c", "/x"), ("d", None)], "manifest string, root string")
    assert {r.subject for r in evidence_graph.root_issues(roots).collect()} == {"c", "d"}


def test_each_manifest_is_scanned_once(spark, tmp_path):
    for name, rows in example(spark).items():
        rows.write.parquet(str(tmp_path / name))
    tables = {name: spark.read.parquet(str(tmp_path / name)) for name in example(spark)}
    parts = [evidence_graph._facts(name, rows, True) for name, rows in tables.items()]
    plan = rules.union(*parts)._jdf.queryExecution().executedPlan().toString()
    assert all(plan.count(f"{tmp_path}/{name}]") + plan.count(f"{tmp_path}/{name},") <= 1 for name in tables) and plan.count("FileScan parquet") == len(tables)


def test_trace_names_the_discovering_edge(spark):
    edges = [("e1", "a", "b"), ("e2", "a", "c"), ("e3", "c", "d"), ("e0", "b", "d"), ("e4", "d", "a"), ("e5", "d", "e"), ("e6", "c", "e"), ("e7", "x", "c")]
    frame = spark.createDataFrame(edges, "id string, src string, dst string")

    def brute(root):
        out, queue = {root: (0, None)}, [root]
        for at in queue:
            for e, s, t in sorted(edges):
                if s == at and t not in out:
                    out[t] = (out[at][0] + 1, e)
                    queue.append(t)
        return out

    found = graph.trace_via(frame, spark.createDataFrame([("a",), ("x",)], "node string")).collect()
    assert {r: {x.node: (x.depth, x.via) for x in found if x.root == r} for r in "ax"} == {"a": brute("a"), "x": brute("x")}


def test_chains_and_circles(spark):
    n = 10_000
    rows = [(f"c{i:05}", f"c{i + 1:05}" if i < n - 1 else None) for i in range(n)] + [("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("t1", "t2"), ("t2", "r3"), ("s", "s"), ("out", "nowhere")]
    found = chains.follow(spark.createDataFrame(rows, "node string, next string"))
    ended = {r.node: (r.end, r.steps) for r in found.ended.collect()}
    assert len(ended) == n + 1 and all(ended[f"c{i:05}"] == (f"c{n - 1:05}", n - 1 - i) for i in range(0, n, 371)) and ended["out"] == ("nowhere", 1)
    assert {(r.node, r.ring, r.entry) for r in found.circular.collect()} == {("r1", "r1", "r1"), ("r2", "r1", "r2"), ("r3", "r1", "r3"), ("t1", "r1", "r3"), ("t2", "r1", "r3"), ("s", "s", "s")}
    assert chains.follow(spark.createDataFrame([], "node string, next string")).ended.count() == 0


def test_what_rests_on_chains_has_no_cap(spark):
    deep = [(f"n{i}", f"n{i - 1}" if i else None, "fragment" if i % 5 == 3 else "element") for i in range(300)] + [("text", "n0", "text")]
    tree = {r.id: (r.owner, r.depth) for r in graph.ui_tree(spark.createDataFrame(deep, "id string, parent string, kind string")).collect()}
    assert len(tree) == 240 and tree["n299"] == ("n0", sum(i % 5 != 3 for i in range(1, 300)))
    exports = [(f"m{i}", "a", None, f"m{i + 1}", "a") for i in range(500)] + [("m500", "a", "decl", None, None)]
    exports += [("x", "a", None, "m0", "a"), ("x", "a", None, "y", "b"), ("y", "b", None, "x", "a"), ("z", "q", None, "w", "q"), ("z", "q", None, "z", "q"), ("two", "a", None, "m3", "a"), ("two", "a", "other", None, None), ("via", "a", None, "two", "a")]
    found = {(r.module, r.name): (r.status, r.target) for r in graph.resolve_exports(spark.createDataFrame(exports, "module string, name string, target string, from_module string, from_name string")).collect()}
    assert all(found[f"m{i}", "a"] == ("resolved", "decl") for i in range(501)) and found["x", "a"] == found["y", "b"] == ("resolved", "decl")
    assert found["z", "q"] == ("circular", None) and found["two", "a"] == found["via", "a"] == ("ambiguous", None)
    configs = [(f"p{i:03}/t.json", f"p{i + 1:03}/t.json" if i < 99 else None, "src" if i in (50, 99) else None) for i in range(100)]
    held, errors = modules.inherited(spark.createDataFrame([(*c, None) for c in configs], "path string, extends string, base_url string, paths array<struct<pattern:string,targets:array<string>>>"))
    assert {r.path: r.base_url for r in held.collect()} == {p: "p050/src" if i <= 50 else "p099/src" for i, (p, _, _) in enumerate(configs)} and errors.count() == 0


def test_orders_and_numbers(spark):
    rng = random.Random(2)
    rows = [(i, "hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}" if rng.random() < 0.8 else None, rng.randrange(10**6)) for i in range(500)]
    frame = spark.createDataFrame(rows, "id int, key string, at int").repartition(5)
    found = {r.id: r.number for r in ordering.numbers_within(frame, ["key"], [F.col("at"), F.col("id")]).collect()}
    for key in {k for _, k, _ in rows}:
        mine = sorted((at, i) for i, k, at in rows if k == key)
        assert [found[i] for _, i in mine] == list(range(1, len(mine) + 1))
    words = ["b", "A", "a", "B", "é", "e", "f", "a b"]
    told = {r.w: r.place for r in ordering.total_order(spark.createDataFrame([(w,) for w in words], "w string"), [ordering.collated(F.col("w"))]).collect()}
    assert sorted(words, key=told.get) == ["a", "A", "a b", "b", "B", "e", "é", "f"]


def test_canonical_json(spark):
    same = [('{"a":1,"b":{"x":[1,2.50],"y":null}}', '{ "b" : {"y":null,"x":[1.0,2.5]}, "a":1.0 }'), ('"x 1.0"', ' "x 1\\u002e0" '), ("[1e2]", "[100]"), ("{}", "{ }")]
    apart = [('{"a":1}', '{"a":"1"}'), ("[1,2]", "[2,1]"), ('"1.0"', '"1"'), ("null", '"null"')]
    rows = spark.createDataFrame([(a, b, True) for a, b in same] + [(a, b, False) for a, b in apart], "a string, b string, same boolean")
    assert rows.filter((canonical_json(F.col("a")) == canonical_json(F.col("b"))) != F.col("same")).collect() == []
    odd = spark.createDataFrame([("nope",), ('{"a":1,"a":2}',), (None,)], "a string")
    assert odd.filter(canonical_json(F.col("a")).isNotNull()).count() == 0
    seen = spark.createDataFrame([(1, 1, '{"a":1,"b":2}'), (1, 2, '{"b":2,"a":1}'), (2, 1, "[1]"), (2, 2, "[2]"), (3, 1, "bad"), (3, 2, "bad"), (4, 1, None)], "k int, i int, o string")
    found = {r.k: (r.status, r.n, r.observation) for r in projections.retained_observations(seen, ["k"], "o", ["i"]).collect()}
    assert found == {1: ("duplicate", 2, '{"a":1,"b":2}'), 2: ("conflict", 2, "[1]"), 3: ("duplicate", 2, "bad"), 4: ("single", 1, None)}


def test_fingerprints_are_of_multisets(spark):
    states = {1: ["a", "b", "b"], 2: ["b", "a", "b"], 3: ["a", "a", "b"], 4: ["a", "b"], 5: ["ab", ""], 6: ["", "ab"]}
    rows = spark.createDataFrame([(s, x, None) for s, xs in states.items() for x in xs], "state int, x string, y string").repartition(4)
    found = {(r.first_state, r.states, r.n, r.verified) for r in fingerprints.fingerprint_groups(rows, "state", ["x", "y"]).collect()}
    assert found == {(1, 2, 3, True), (3, 1, 3, True), (4, 1, 2, True), (5, 2, 2, True)}


def test_line_trees(spark):
    rng, lines = random.Random(4), []
    for i in range(3000):
        lines.append(" " * rng.choice([0, 2, 2, 4, 4, 5, 8]) + f'- item "n {i}"' if rng.random() < 0.95 else rng.choice(["", "words", "-x"]))
    text = "\n".join(lines)
    found = {r.line: (r.indent, r.name, r.parent) for r in trees.line_tree(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string"), "id", "text").collect()}
    stack = []
    for i, line in enumerate(lines):
        if "- item" in line:
            indent = len(line) - len(line.lstrip())
            stack = [(d, j) for d, j in stack if d < indent]
            assert found.pop(i) == (indent, f"n {i}", stack[-1][1] if stack else None)
            stack.append((indent, i))
    assert not found
    big = "\n".join(" " * (2 * (i % 5)) + "- a" for i in range(100_000))
    assert trees.line_tree(spark.createDataFrame([(1, big)], "id int, text string"), "id", "text").filter("parent = line - 1").count() == 80_000


def test_snapshots(spark):
    text = '\n  - textbox "User \\"x\\"" [active]: secret\n  - searchbox: find\n  - button "Go": fine'
    row = spark.range(1).select(trees.sanitized_snapshot(F.lit(text)).alias("s"), trees.snapshot_identity(F.lit(text)).alias("i"), trees.snapshot_identity(F.lit("none")).alias("n")).first()
    assert row.s == '\n  - textbox "User \\"x\\"" [active]\n  - searchbox\n  - button "Go": fine' and tuple(row.i) == ("textbox", 'User "x"') and tuple(row.n) == (None, None)


def test_routes_of_files(spark):
    given = [("app/page.tsx", "/"), ("src/app/(shop)/item/[id]/page.jsx", "/item/[id]"), ("app/@side/x/page.ts", "/x"), ("app/x/layout.tsx", None), ("lib/app/page.tsx", None), ("app/x/page.css", None)]
    rows = spark.createDataFrame(given, "path string, route string")
    assert rows.filter(~R.app_page_route(F.col("path")).eqNullSafe(F.col("route"))).collect() == []
    joined = [("/a//b/", None, True, "/a/b"), ("x", "/p/", True, "/p/x"), ("x", None, True, None), ("x", None, False, "/x"), ("", None, False, "/")]
    rows = spark.createDataFrame(joined, "d string, p string, n boolean, w string")
    assert rows.filter(~R.joined_route(F.col("d"), F.col("p"), F.col("n")).eqNullSafe(F.col("w"))).collect() == []


def test_repository_scan_never_opens_ignored_folders(spark, tmp_path):
    for path in ["a.ts", "b.txt", "src/c.TSX", "src/deep/er/d.json", "node_modules/e.ts", "src/dist/f.js", "src/deep/package.json"]:
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x" * len(path))
    os.symlink(tmp_path / "src", tmp_path / "loop")
    opened = []
    real = os.scandir
    for folders in ("1", "64"):
        reader = repository.RepositoryReader({"path": str(tmp_path), "folders": folders})
        try:
            os.scandir = lambda p: (opened.append(str(p)), real(p))[1]
            rows = [row for part in reader.partitions() for row in reader.read(part)]
        finally:
            os.scandir = real
        assert sorted(r[1] for r in rows) == ["a.ts", "src/c.TSX", "src/deep/er/d.json", "src/deep/package.json"]
    assert not any("node_modules" in p or "dist" in p or "loop" in p for p in opened)
    found = repository.scan_repository(spark, str(tmp_path)).collect()
    assert sorted((r.path, r.type, r.size_bytes) for r in found) == [("a.ts", "typescript", 4), ("src/c.TSX", "typescript-react", 9), ("src/deep/er/d.json", "json", 18), ("src/deep/package.json", "json", 21)]
    assert [r.path for r in repository.named_files(spark, str(tmp_path), "package.json").collect()] == ["src/deep/package.json"]
    gone = repository.RepositoryReader({"path": str(tmp_path)})
    assert [r[1:] for r in gone.read(repository.Folder(str(tmp_path / "no"), True))] == [("no", None, None, None, "Cannot read repository directory: No such file or directory")]
    for path, why in ((tmp_path / "no", "does not exist"), (tmp_path / "a.ts", "not a directory")):
        with pytest.raises(Exception, match=why):
            repository.scan_repository(spark, str(path)).collect()


def test_every_rule_is_found_once(spark):
    kind = "id string, domain string, status string, strength string, static array<string>, runtime string, reasons array<string>"
    good = ("g", "http", "corroborated", "exact", ["n"], "r", ["x"])
    bad = [("1", "http", "runtime-only", None, [], "r", []), ("2", "http", "odd", None, [], "r", ["x"]), ("3", "odd", "runtime-only", None, [], "r", ["x"]), ("4", "http", "corroborated", None, ["n"], "r", ["x"]), ("5", "http", "static-only", None, ["n"], "r", ["x"]), ("6", "http", "runtime-only", None, ["n"], "r", ["x"]), ("7", "ui", "static-only", None, ["lost"], None, ["x"]), ("8", "ui", "runtime-only", None, [], "lost", ["x"]), ("9", "http", "corroborated", "exact", ["n"], "r", ["x"]), ("9", "route", "corroborated", "exact", ["n"], "r", ["x"]), ("10", "route", "ambiguous", None, ["n"], "r", ["x"])]
    names = spark.createDataFrame([("n",)], "ref string"), spark.createDataFrame([("r",)], "ref string")
    candidates = spark.createDataFrame([("9", "n", "other"), ("10", "lost", "equally-specific")], "id string, node string, selection string")
    found = sorted(tuple(r) for r in rules.reconciliation_issues(spark.createDataFrame([good, *bad], kind), *names, candidates).collect())
    assert found == sorted([("no-reasons", "1"), ("unknown-status", "2"), ("unknown-domain", "3"), ("corroborated-incomplete", "4"), ("static-only-references", "5"), ("runtime-only-references", "6"), ("missing-static-reference", "7"), ("missing-runtime-reference", "8"), ("duplicate-result", "9"), ("duplicate-exact-match", "n"), ("corroborated-selection", "9"), ("corroborated-selection", "9"), ("ambiguous-selection", "10"), ("missing-candidate", "10")])
    assert rules.reconciliation_issues(spark.createDataFrame([good], kind), *names).collect() == []
    with pytest.raises(ValueError, match="no-reasons: 1"):
        rules.strict(rules.reconciliation_issues(spark.createDataFrame([good, *bad], kind), *names), ["no-reasons"])
    watch = Observation("rules")
    rows = spark.createDataFrame([("a", 1), ("b", 5), ("c", 9)], "id string, n int")
    assert rules.row_issues(rows, "id", [rules.RowRule("large", F.col("n") > 4), rules.RowRule("huge", F.col("n") > 8)], watch).count() == 3
    assert watch.get == {"large": 2, "huge": 1}


def test_contract_rules(spark):
    items = spark.createDataFrame([("a", "api", None, None, "unknown"), ("o", "operation", "query", None, None), ("o2", "operation", "odd", None, None), ("e", "endpoint", None, "https://a.test/x", None), ("e2", "endpoint", None, "ftp://x", None), ("e2", "type", None, None, None)], "id string, part string, type string, value string, style string")
    told = spark.createDataFrame([("p", "u", "s", "l", "t"), ("p2", "u", "", "l", "t"), ("p3", "u", "s", "l", "Authorization: Basic abc")], "id string, source_url string, section string, location string, source_text string")
    refs = spark.createDataFrame([("o", "p"), ("o2", "gone")], "subject string, ref string")
    assert sorted(tuple(r) for r in rules.contract_issues(items, told, refs).collect()) == [("duplicate-contract-id", "e2"), ("invalid-endpoint", "e2"), ("invalid-operation-type", "o2"), ("invalid-provenance", "p2"), ("missing-provenance", "o2"), ("style-without-operations", "api"), ("unsafe-secret", "p3")]
    results = spark.createDataFrame([("r1", "corroborated", "exact"), ("r2", "odd", "odd"), ("r3", "ambiguous", None), ("r3", "ambiguous", None)], "id string, status string, strength string")
    ref = "id string, kind string, ref string"
    contract, product = spark.createDataFrame([("r1", "operation", "o"), ("r2", "type", "lost")], ref), spark.createDataFrame([("r1", "node", "n"), ("r3", "state", "lost")], ref)
    dimensions = spark.createDataFrame([("r1", "conflict", "a", "b"), ("r2", "conflict", None, "b"), ("r3", "match", None, None)], "id string, status string, contract_value string, product_value string")
    links = spark.createDataFrame([("l1", "f", "n", "r1", "o"), ("l2", "lost", "n", "r1", "o"), ("l3", "f", "lost", "r1", "o"), ("l4", "f", "n", "r1", "x")], "id string, feature_id string, node_id string, result_id string, operation_id string")
    known = spark.createDataFrame([("operation", "o"), ("node", "n"), ("feature", "f")], "kind string, ref string")
    found = sorted(tuple(r) for r in rules.contract_reconciliation_issues(results, contract, product, dimensions, links, known).collect())
    assert found == sorted([("unsupported-status", "r2"), ("unsupported-strength", "r2"), ("duplicate-result", "r3"), ("invalid-contract-reference", "r2"), ("invalid-product-reference", "r3"), ("impossible-conflict", "r2"), ("invalid-feature-reference", "l2"), ("invalid-static-reference", "l3"), ("invalid-feature-path", "l3"), ("invalid-feature-path", "l4")])
