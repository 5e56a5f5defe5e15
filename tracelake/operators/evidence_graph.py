"""The product evidence graph: nodes, edges and unresolved references of all manifests of an application, in one call.

Every manifest is read once. Each of its rows gives facts: nodes with the keys by which they are found, references from a node
to the first key that answers, resolved symbols, and failed resolutions. The facts are written once, partitioned by part, and
read pruned: what follows joins references to keys, never manifests to each other.

A reference names keys in their order. A key answers if exactly one node has it (keys of MAPS: the last node that has it); a
symbol's key answers if exactly one symbol has it and its own key answers. A reference that no key answers becomes an
unresolved row with a reason, or nothing where the code proves nothing (a call to what is no known callable).

Identifiers are numbered (#2, #3, ...) where nodes, edges or unresolved rows would have the same, by place; rows of one place by
label, evidence or reason. Evidence of components that
one component renders several times is collected on one edge. Manifests and their columns are in MANIFESTS; one that is left
out counts as empty, and without `symbols` imports are unresolved by their binding. A location is a text
`path:first line-last line`.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.names import uri_component

from . import ordering
from .graph import violations
from .ordering import numbers_within
from .storage import cut

#: The manifests with the columns that they must have.
MANIFESTS = {
    "components": "place long, name string, file string, at string, export_status string, elements array<struct<at:string,name:string,text:string,parent_at:string>>, renders array<struct<local_name:string,expression:string,file:string,at:string>>",
    "callables": "id string, name string, at string, kind string",
    "routes": "place long, source string, file string, at string, path string, path_kind string, component string, component_file string, component_at string, issue string, issue_reason string",
    "navigations": "place long, at string, element string, label string, destination string, destination_kind string",
    "actions": "place long, component string, element_at string, event string, event_at string, file string, binding string, handler string, handler_at string, handler_source string, expression string",
    "calls": "place long, caller string, binding string, callee string, local_name string, source string, expression string, file string, at string",
    "requests": "place long, at string, method string, url string, caller string",
    "documents": "id string, name string, at string, status string, operations array<struct<type:string,name:string,at:string>>",
    "executions": "place long, at string, phase string, executor string, type string, caller string, document_kind string, document string, expression string",
    "symbols": "kind string, file string, local_name string, source string, usage_at string, target_kind string, target_id string, target_at string",
    "failures": "place long, kind string, file string, local_name string, source string, reason string",
}
#: Edge types with the node types that they join.
ENDPOINTS = [
    ("ROUTE_RENDERS_COMPONENT", "route", "component"), ("COMPONENT_RENDERS_COMPONENT", "component", "component"), ("NAVIGATES_TO", "navigation", "route"),
    ("CONTAINS_ELEMENT", "component", "ui-element"), ("CONTAINS_ELEMENT", "ui-element", "ui-element"), ("HAS_EVENT", "ui-element", "ui-event"),
    ("BINDS_TO", "ui-event", "callable"), ("CALLS", "callable", "callable"), ("PERFORMS_HTTP_REQUEST", "callable", "http-request"),
    ("DEFINES_OPERATION", "graphql-document", "graphql-operation"), ("PERFORMS_GRAPHQL_EXECUTION", "callable", "graphql-execution"),
    ("USES_DOCUMENT", "graphql-execution", "graphql-document"), ("EXECUTES_OPERATION", "graphql-execution", "graphql-operation"),
]
#: Kinds of keys under which the last node counts; of all others exactly one must be there.
MAPS = ["row", "component", "element", "callable", "document"]
#: Kinds of the keys of symbols, of those that a fact may need, of references' sources, and of nodes that are tried among
#: several keys; no other kinds stand there. Rows of a manifest are a kind of their own.
SYMBOLS, NEEDED, TRIED = ["import-component", "import-callable", "namespace"], ["element", "document"], ["component", "in-file"]
SOURCES = ["row|components", "row|routes", "row|navigations", "row|actions", "row|executions", "inner", "element", "callable", "document"]
#: Fixed value: so many repeated identifiers are sent to all tasks.
FEW = 10_000

#: What a fact may say, in the order of the stored columns.
FIELDS = {
    "part": "string", "type": "string", "place": "bigint", "step": "int", "base": "string", "counted": "boolean", "label": "string", "at": "string", "source": "string",
    "keys": "array<string>", "needs": "string", "src": "string", "tries": "array<string>", "reference": "string", "strength": "string", "none": "string", "many": "string",
    "symbol_none": "string", "failure": "string", "quiet": "boolean", "reason": "string",
}


class Graph(NamedTuple):
    """nodes (id, type, label, location, source), edges (id, type, src, dst, evidence) and unresolved (id, type, src, reference,
    reason, source)."""

    nodes: DataFrame
    edges: DataFrame
    unresolved: DataFrame


def _key(kind: str, *parts: Column | str) -> Column:
    """A key; null if one of its parts is."""
    return F.concat(F.lit(kind), *[x for p in parts for x in (F.lit("|"), F.col(p) if isinstance(p, str) else p.cast("string"))])


def _fact(part: str, kind: Column | str, **given: Column | str | bool | int | list) -> Column:
    values = {"part": part, "type": kind, **given}

    def column(name: str) -> Column:
        value = values.get(name)
        if isinstance(value, list):
            return F.filter(F.array(*value), lambda x: x.isNotNull()) if value else F.array().cast("array<string>")
        return value if isinstance(value, Column) else F.lit(value)

    return F.struct(*[column(name).cast(kind_).alias(name) for name, kind_ in FIELDS.items()])


def _node(kind: str, base: Column, label: Column, source: str, keys: list[Column], place: Column, at: str | Column = "at", counted: bool = True, **more) -> Column:
    return _fact("node", kind, base=base, label=label, at=F.col(at) if isinstance(at, str) else at, source=source, keys=keys, place=place, counted=counted, **more)


def _located(kind: str, at: str | Column, label: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(at) if isinstance(at, str) else at, F.lit(":"), uri_component(F.coalesce(label, F.lit(""))))


def _facts(name: str, rows: DataFrame, resolved: bool) -> DataFrame:
    """The facts of one manifest, as rows, from one pass over it."""
    c = F.col
    place = c("place") if "place" in rows.columns else F.lit(0).cast("bigint")
    row = _key("row", F.lit(name), place)
    out: list[Column] = []
    arrays: list[Column] = []
    if name == "components":
        own = _key("row", F.lit(name), place)
        keys = [own, _key("component", "name", "at"), _key("in-file", "name", "file"), _key("component-at", "at")]
        out.append(_node("component", _located("component", "at", c("name")), c("name"), "ui-structure", keys, place))

        def element(x: Column, i: Column) -> Column:
            mine = _key("row", F.lit("elements"), place, i)
            label = F.concat(x["name"], F.when(F.coalesce(x["text"], F.lit("")) != "", F.concat(F.lit(' "'), x["text"], F.lit('"'))).otherwise(F.lit("")))
            return _fact("node", "ui-element", base=_located("ui-element", x["at"], x["name"]), label=label, at=x["at"], source="ui-structure", keys=[mine, _key("element", c("name"), x["at"]), _key("inner", own, x["at"])], place=place, step=i, counted=True)

        def inside(x: Column, i: Column) -> Column:
            above = F.coalesce(_key("inner", own, x["parent_at"]), own)
            return _fact("reference", "CONTAINS_ELEMENT", src=above, tries=[_key("row", F.lit("elements"), place, i)], at=x["at"], source="ui-structure", strength="direct", quiet=True, place=place, step=i)

        def render(x: Column, i: Column) -> Column:
            member = F.contains(x["expression"], F.lit("."))
            names = [_key("component", x["local_name"], x["at"]), _key("in-file", x["local_name"], x["file"]), _key("import-component", c("file"), x["local_name"])]
            tries = [F.when(~member, k) for k in names]
            none = F.when(member, F.lit("JSX member component could not be uniquely resolved")).otherwise(F.lit("Rendered component reference could not be resolved"))
            return _fact("reference", "COMPONENT_RENDERS_COMPONENT", src=own, tries=tries, at=x["at"], source="ui-structure", strength="resolved", reference=x["expression"], none=none, many=none, symbol_none="Resolved render symbol has no matching UI component", failure=F.when(~member, _key("import", c("file"), x["local_name"])), place=place, step=i)

        arrays = [F.transform(F.coalesce(a, F.array().cast(rows.schema[n].dataType)), f) for a, n, f in ((c("elements"), "elements", element), (c("elements"), "elements", inside), (c("renders"), "renders", render))]
    elif name == "callables":
        out.append(_node("callable", _key("", "id").substr(F.lit(2), F.length("id")), c("name"), "function-call", [_key("callable", "id"), _key("callable-at", "name", "at")], place, counted=False))
        out[-1] = out[-1].withField("base", F.concat(F.lit("callable:"), "id"))
    elif name == "routes":
        label = F.concat(c("source"), F.lit(":"), c("path"))
        out.append(_node("route", _located("route", "at", label), c("path"), "route-navigation", [row, F.when(c("path_kind") == "static", _key("route", "path"))], place))
        tries = [_key("component", "component", "component_at"), _key("in-file", "component", "component_file"), _key("import-component", "file", "component")]
        none = "Associated route component is not a same-file UI component"
        renders = _fact("reference", "ROUTE_RENDERS_COMPONENT", src=row, tries=tries, at=c("component_at"), source="route-navigation", strength="resolved", reference=c("component"), none=none, many=none, failure=_key("import", "file", "component"), place=place, step=0)
        out += [F.when(c("component").isNotNull() & c("component_at").isNotNull(), renders)]
        out += [F.when(c("issue").isNotNull(), _fact("reference", "ROUTE_RENDERS_COMPONENT", src=row, tries=[], source="route-navigation", reference=c("issue"), none=c("issue_reason"), place=place, step=1))]
    elif name == "navigations":
        out.append(_node("navigation", _located("navigation", "at", F.concat(c("element"), F.lit(":"), c("destination"))), F.coalesce(F.nullif("label", F.lit("")), "element"), "route-navigation", [row], place))
        dynamic = c("destination_kind") == "dynamic"
        none = F.when(dynamic, F.lit("Navigation destination is dynamic")).otherwise(F.lit("No discovered route has this path"))
        out.append(_fact("reference", "NAVIGATES_TO", src=row, tries=[F.when(~dynamic, _key("route", "destination"))], at=c("at"), source="route-navigation", strength="resolved", reference=c("destination"), none=none, many="Multiple routes have this path", place=place))
    elif name == "actions":
        element = _key("element", "component", "element_at")
        out.append(_node("ui-event", _located("ui-event", "event_at", c("event")), c("event"), "action-binding", [row], place, at="event_at", needs=element))
        out.append(_fact("reference", "HAS_EVENT", src=element, tries=[row], at=c("event_at"), source="action-binding", strength="direct", quiet=True, place=place))
        local, inline, imported = (c("binding") == b for b in ("local", "inline", "imported"))
        through = imported & F.lit(resolved)
        named = F.concat("handler", F.lit(" from "), "handler_source")
        tries = [F.when(local, _key("callable-at", "handler", "handler_at")).when(inline, _key("callable-at", F.lit("<inline-callback>"), c("handler_at"))).when(through, _key("import-callable", "file", "handler", "handler_source"))]
        none = F.when(local, F.lit("Local handler has no matching callable identity")).when(inline, F.lit("Inline handler has no matching callable identity")).when(through, F.lit("Imported handler did not resolve to a callable")).otherwise(F.concat(F.lit("Handler binding is "), c("binding")))
        source = F.when(through, F.lit("module-resolution")).otherwise(F.lit("action-binding"))
        told = F.when(local, c("handler")).when(imported, named).otherwise(c("expression"))
        out.append(_fact("reference", "BINDS_TO", src=row, tries=tries, at=F.coalesce(F.when(local | inline, c("handler_at")), c("event_at")), source=source, strength="resolved", reference=told, none=none, many=none, failure=F.when(through, _key("import", "file", "handler", "handler_source")), needs=element, place=place))
    elif name == "calls":
        local, imported, member = (c("binding") == b for b in ("local", "imported", "member-expression"))
        tries = [F.when(local, _key("callable", "callee")).when(F.lit(resolved) & imported, _key("import-callable", "file", "local_name", "source")).when(F.lit(resolved) & member, _key("namespace", "at"))]
        through = F.lit(resolved) & (imported | member)
        none = F.when(F.lit(resolved) & imported, F.lit("Imported call did not resolve to a callable")).when(F.lit(resolved) & member, F.lit("Member call could not be resolved as a local namespace import")).otherwise(F.concat(F.lit("Call binding is "), c("binding")))
        told = F.when(imported, F.concat("local_name", F.lit(" from "), "source")).otherwise(c("expression"))
        source = F.when(through, F.lit("module-resolution")).otherwise(F.lit("function-call"))
        out.append(_fact("reference", "CALLS", src=_key("callable", "caller"), tries=tries, at=c("at"), source=source, strength="direct", reference=told, none=none, many=none, failure=F.when(F.lit(resolved) & imported, _key("import", "file", "local_name", "source")), quiet=local, place=place))
    elif name == "requests":
        label = F.concat_ws(":", "method", "url")
        out.append(_node("http-request", _located("http-request", "at", label), F.concat_ws(" ", "method", "url"), "http-request", [row], place))
        out.append(_fact("reference", "PERFORMS_HTTP_REQUEST", src=_key("callable", "caller"), tries=[row], at=c("at"), source="http-request", strength="direct", quiet=True, place=place))
    elif name == "documents":
        own = F.concat(F.lit("graphql-document:"), "id")
        out.append(_node("graphql-document", own, c("name"), "graphql-operation", [_key("document", "id")], place, counted=False))

        def names(x: Column, i: Column) -> tuple[Column, Column]:
            title = F.coalesce(x["name"], F.lit("anonymous"))
            return F.concat(own, F.lit(":operation:"), i.cast("string"), F.lit(":"), x["type"], F.lit(":"), title), _key("row", F.lit("operations"), c("id"), i)

        def operation(x: Column, i: Column) -> Column:
            title = F.concat(x["type"], F.lit(" "), F.coalesce(x["name"], F.lit("<anonymous>")))
            return _fact("node", "graphql-operation", base=names(x, i)[0], label=title, at=x["at"], source="graphql-operation", keys=[names(x, i)[1], _key("operation", c("id"), x["type"])], place=place, step=i, counted=False)

        def defines(x: Column, i: Column) -> Column:
            return _fact("reference", "DEFINES_OPERATION", src=_key("document", "id"), tries=[names(x, i)[1]], at=x["at"], source="graphql-operation", strength="direct", quiet=True, place=place, step=i)

        held = F.when(c("status") == "ok", c("operations"))
        arrays = [F.transform(F.coalesce(held, F.array().cast(rows.schema["operations"].dataType)), f) for f in (operation, defines)]
    elif name == "executions":
        out.append(_node("graphql-execution", _located("graphql-execution", "at", F.concat("phase", F.lit(":"), "executor")), c("executor"), "graphql-operation", [row], place))
        out.append(_fact("reference", "PERFORMS_GRAPHQL_EXECUTION", src=_key("callable", "caller"), tries=[row], at=c("at"), source="graphql-operation", strength="direct", quiet=True, place=place))
        dynamic = c("document_kind") == "dynamic"
        none = F.when(dynamic, F.lit("GraphQL document reference is dynamic")).otherwise(F.lit("Referenced GraphQL document is absent"))
        out.append(_fact("reference", "USES_DOCUMENT", src=row, tries=[F.when(~dynamic, _key("document", "document"))], at=c("at"), source="graphql-operation", strength="resolved", reference=F.when(dynamic, c("expression")).otherwise(c("document")), none=none, place=place))
        executes = _fact("reference", "EXECUTES_OPERATION", src=row, tries=[_key("operation", "document", "type")], at=c("at"), source="graphql-operation", strength="resolved", reference=c("type"), none="Document has no matching operation", many="Document has multiple matching operations", needs=_key("document", "document"), place=place)
        out.append(F.when(~dynamic, executes))
    elif name == "symbols":
        target = F.when(c("target_kind") == "callable", _key("callable", "target_id"))
        imported = c("kind") == "import"
        for keys, tried in (([_key("import-component", "file", "local_name")], _key("component-at", "target_at")), ([_key("import-callable", "file", "local_name", "source")], target)):
            out.append(F.when(imported, _fact("symbol", "import", keys=keys, tries=[tried], at=c("target_at"))))
        out.append(F.when(c("kind") == "namespace-member", _fact("symbol", "namespace-member", keys=[_key("namespace", "usage_at")], tries=[target], at=c("target_at"))))
    else:
        out.append(F.when(c("kind") == "import", _fact("failure", "import", keys=[_key("import", "file", "local_name"), _key("import", "file", "local_name", "source")], reason=c("reason"), place=place)))
    if len(out) == 1 and not arrays:
        return rows.select(out[0].alias("f")).filter("f is not null").select("f.*")
    facts = F.filter(F.array(*out), lambda x: x.isNotNull()) if out else None
    for more in arrays:
        facts = more if facts is None else F.concat(facts, more)
    return rows.select(F.explode(facts).alias("f")).select("f.*")


def collect_facts(manifests: dict[str, DataFrame], kept: list[str] | None = None) -> DataFrame:
    """The facts of all manifests, or those of the kept parts, in one plan that scans each of them once, stored by part."""
    unknown = set(manifests) - set(MANIFESTS)
    if unknown:
        raise ValueError(f"no such manifests: {sorted(unknown)}")
    parts = [_facts(name, rows, "symbols" in manifests or "failures" in manifests) for name, rows in manifests.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return cut(out if kept is None else out.filter(F.col("part").isin(kept)), "facts", by=["part"])


def build_graph(manifests: dict[str, DataFrame], only: str | None = None) -> Graph:
    """Nodes, edges and unresolved references of the manifests (see MANIFESTS). Null places count as one place. only: the one
    table of the graph that is asked for; the others are None then, and what only they need is not worked out."""
    facts = collect_facts(manifests, ["node"] if only == "nodes" else None)
    rows = _identified(facts.filter("part = 'node'"))
    if only == "nodes":
        return Graph(_nodes(rows), None, None)
    targets = _targets(rows)
    found = _answered(facts.filter("part = 'reference'"), targets, _symbols(facts.filter("part = 'symbol'"), targets), facts.filter("part = 'failure'"), only)
    return Graph(None if only else _nodes(rows), None if only == "unresolved" else _edges(found), None if only == "edges" else _unresolved(found))


def _numbered(rows: DataFrame, base: str, order: list[str], counted: Column | None = None, store: bool = False) -> DataFrame:
    """The rows with id: the base, and #2, #3, ... from its second row on. Bases are counted by a hash, of which only those that
    stand more than once are kept. With few of them only their rows are put in order and all others are not moved; with many,
    rows are numbered where their base is. store: what has repeats is stored."""
    rows = rows.withColumn("__counted", F.lit(True) if counted is None else counted)
    hashed, columns = F.xxhash64(base), [c for c in rows.columns if c != "__counted"]
    repeats = cut(rows.filter("__counted").groupBy(hashed.alias("__hash")).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1"), "repeats")
    n = repeats.count()
    if not n:
        return rows.select(*columns, F.col(base).alias("id"))
    few = F.broadcast(repeats.select("__hash"))  # at most FEW rows
    if n <= FEW:
        again = rows.filter("__counted").join(few, hashed == F.col("__hash"), "left_semi")
        once = rows.join(few, F.col("__counted") & (hashed == F.col("__hash")), "left_anti")
        placed = once.withColumn("__number", F.lit(1).cast("long")).unionByName(numbers_within(again, [base], [F.col(c) for c in order], "__number"))
    else:
        large = rows.filter("__counted").join(repeats.filter(F.col("__n") > ordering.LARGE), hashed == F.col("__hash"), "left_semi")
        placed = numbers_within(rows, [base, "__counted"], [F.col(c) for c in order], "__number", ordering.large_keys(large, [base, "__counted"]))
    told = F.when(F.col("__counted") & (F.col("__number") > 1), F.concat(base, F.lit("#"), F.col("__number").cast("string"))).otherwise(F.col(base))
    out = placed.select(*columns, told.alias("id"))
    return cut(out, "numbered") if store else out


def _of(keys: DataFrame, kinds: list[str]) -> DataFrame:
    """The keys of some kinds."""
    kind = F.when(F.startswith("key", F.lit("row|")), F.substring_index("key", "|", 2)).otherwise(F.substring_index("key", "|", 1))
    return keys.filter(kind.isin(kinds))


def _identified(facts: DataFrame) -> DataFrame:
    """The facts of nodes with their identifiers."""
    columns = ["type", "base", "counted", "label", "at", "source", "keys", "needs", "place", F.coalesce("step", F.lit(0)).alias("step")]
    return _numbered(facts.select(*columns), "base", ["place", "step", "label"], F.coalesce("counted", F.lit(False)), store=True)


def _nodes(rows: DataFrame) -> DataFrame:
    known = _of(rows.select(F.explode("keys").alias("key")), NEEDED).select(F.col("key").alias("needs"))
    free, bound = rows.filter("needs is null"), rows.filter("needs is not null").join(known, "needs", "left_semi")
    return free.unionByName(bound).select("id", "type", "label", F.col("at").alias("location"), "source")


def _targets(rows: DataFrame) -> DataFrame:
    """(key, n, id) of the keys by which nodes are found, stored."""
    keys = rows.select(F.struct("place", "step", "id").alias("last"), F.explode("keys").alias("key"))
    mapped = F.substring_index("key", "|", 1).isin(MAPS)
    targets = keys.groupBy("key").agg(F.when(mapped, F.lit(1)).otherwise(F.count(F.lit(1))).alias("n"), F.max("last")["id"].alias("id"))
    return cut(targets.select("key", F.col("n").cast("bigint").alias("n"), "id"), "keys")


def _symbols(facts: DataFrame, targets: DataFrame) -> DataFrame:
    """(key, n, id, symbol_at): the symbols' own keys; id only where one symbol has the key and its target is there; stored."""
    rows = cut(facts.select(F.explode("keys").alias("key"), F.get("tries", F.lit(0)).alias("tried"), "at"), "symbols")
    aims = cut(rows.filter("tried is not null").select("tried").distinct(), "aims")
    held = targets.filter("n = 1").join(aims, F.col("key") == F.col("tried")).select("tried", "id")
    aimed = rows.join(cut(held, "held"), "tried", "left")
    found = aimed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"), F.coalesce(F.min("at"), F.lit("")).alias("symbol_at"))
    return cut(found, "symbols")


def _answered(references: DataFrame, targets: DataFrame, symbols: DataFrame, failures: DataFrame, only: str | None = None) -> DataFrame:
    """The references with src_id and dst, the symbol that they passed, and what tells the reason if no key answers, without the
    silent ones that none answers; stored. A reference that tries one key meets the nodes or the symbols as a row; only those
    that try several keys are taken apart."""
    said = ["at", "reference", "none", "many", "symbol_none", "failure"]
    columns = ["src", "type", "place", "step", *said, "source", "strength", "quiet"]
    known = _of(targets, NEEDED).select(F.col("key").alias("needs"))
    needed = cut(references.filter("needs is not null").join(known, "needs", "left_semi").select(*columns, "tries"), "needed")
    rows = references.filter("needs is null").select(*columns, "tries").unionByName(needed).withColumn("key", F.get("tries", F.lit(0)))
    none = F.lit(None).cast("string")
    symbol = F.coalesce(F.substring_index("key", "|", 1).isin(SYMBOLS), F.lit(False))
    hit = (F.col("n") == 1) & F.col("id").isNotNull()
    told = {"dst": F.when(hit, F.col("id")), "passed": F.when(hit, F.col("symbol_at")), "symbol_at": F.when(F.col("n") == 1, F.col("symbol_at")), "several": F.col("n") > 1}
    one = rows.filter((F.size("tries") == 1) & ~symbol).join(targets.withColumn("symbol_at", none), "key", "left")
    through = rows.filter((F.size("tries") == 1) & symbol).join(symbols, "key", "left")
    silent = rows.filter(F.size("tries") == 0).withColumns({"dst": none, "passed": none, "symbol_at": none, "several": F.lit(False)})
    parts = [df.select(*columns, *[c.alias(name) for name, c in told.items()]) for df in (one, through)]
    found = parts[0].unionByName(parts[1]).unionByName(silent.select(*columns, *told)).unionByName(_tried(rows.filter(F.size("tries") > 1).select(*columns, "tries"), targets, symbols))
    found = found.filter({"edges": "dst is not null", "unresolved": "dst is null and not coalesce(quiet, false)"}.get(only, "dst is not null or not coalesce(quiet, false)"))
    why = failures.select(F.explode("keys").alias("failure"), "place", "reason").groupBy("failure").agg(F.min_by("reason", "place").alias("failed"))
    found = found.withColumns({c: F.when(F.col("dst").isNotNull() if c == "at" else F.col("dst").isNull(), F.col(c)) for c in said})  # the rest is not asked for
    found = found.join(cut(why, "failed"), "failure", "left").drop("failure")
    found = found.join(_of(targets, SOURCES).filter("n = 1").select(F.col("key").alias("src"), F.col("id").alias("src_id")), "src").drop("src")
    return cut(found, "answered")


def _tried(rows: DataFrame, targets: DataFrame, symbols: DataFrame) -> DataFrame:
    """References with what the first of their keys that answers says."""
    rows = cut(rows.withColumn("ref", F.monotonically_increasing_id()), "references")  # the numbers must not change when a lost task runs again
    keys = rows.select("ref", F.posexplode("tries").alias("pos", "key"))
    symbol = F.substring_index("key", "|", 1).isin(SYMBOLS)
    tries = keys.filter(~symbol).join(_of(targets, TRIED).withColumn("symbol_at", F.lit(None).cast("string")), "key").unionByName(keys.filter(symbol).join(symbols, "key"))
    answers = F.when((F.col("n") == 1) & F.col("id").isNotNull(), F.struct("pos", "id", "symbol_at"))
    best = tries.groupBy("ref").agg(F.min(answers).alias("hit"), F.max(F.when(F.col("n") > 1, F.lit(True))).alias("several"), F.max(F.when((F.col("n") == 1) & F.col("symbol_at").isNotNull(), F.struct("symbol_at"))).alias("symbol"))
    told = [F.col("hit.id").alias("dst"), F.col("hit.symbol_at").alias("passed"), F.col("symbol.symbol_at").alias("symbol_at"), "several"]
    return rows.join(best, "ref", "left").select(*[c for c in rows.columns if c not in ("ref", "tries")], *told)


def _edges(found: DataFrame) -> DataFrame:
    """(id, type, src, dst, evidence): what was answered."""
    kind = F.col("type")
    symbol_at = F.when(kind == "ROUTE_RENDERS_COMPONENT", F.col("symbol_at")).otherwise(F.col("passed"))
    own_source = F.when(F.col("source") == "module-resolution", F.when(kind == "CALLS", F.lit("function-call")).otherwise(F.lit("action-binding"))).otherwise(F.col("source"))
    own = F.struct(own_source.alias("source"), F.coalesce("at", F.lit("")).alias("at"), "strength")
    other = F.struct(F.lit("module-resolution").alias("source"), F.coalesce(symbol_at, F.lit("")).alias("at"), F.lit("resolved").alias("strength"))
    rows = found.filter("dst is not null").select("type", F.col("src_id").alias("src"), "dst", "place", F.coalesce("step", F.lit(0)).alias("step"), F.when(symbol_at.isNull(), F.array(own)).otherwise(F.array(own, other)).alias("evidence"))
    base = F.concat(F.lit("edge:"), "type", F.lit(":"), "src", F.lit("->"), "dst")
    merged = rows.filter("type = 'COMPONENT_RENDERS_COMPONENT'").groupBy("type", "src", "dst").agg(F.flatten(F.collect_list("evidence")).alias("evidence"))  # places in the code of one component
    rest = _numbered(rows.filter("type <> 'COMPONENT_RENDERS_COMPONENT'").withColumn("base", base), "base", ["place", "step", "evidence"])
    out = rest.unionByName(merged.withColumn("id", base), allowMissingColumns=True)
    return out.select("id", "type", "src", "dst", F.array_sort("evidence").alias("evidence"))


def _unresolved(found: DataFrame) -> DataFrame:
    """(id, type, src, reference, reason, source): what was not answered, but for the silent ones."""
    rows = found.filter("dst is null and not coalesce(quiet, false)")
    failed = F.concat(F.lit("Module resolution failed: "), "failed")
    symbol = F.when(F.col("symbol_at").isNotNull(), F.col("symbol_none"))
    reason = F.coalesce(failed, symbol, F.when(F.col("several"), F.col("many")), "none")
    source = F.when((F.col("type") == "COMPONENT_RENDERS_COMPONENT") & (F.col("failed").isNotNull() | F.col("symbol_at").isNotNull()), F.lit("module-resolution")).otherwise(F.col("source"))
    base = F.concat(F.lit("unresolved:"), "type", F.lit(":"), "src_id", F.lit(":"), uri_component(F.coalesce("reference", F.lit(""))))
    rows = rows.select("type", F.col("src_id").alias("src"), "reference", reason.alias("reason"), source.alias("source"), "place", F.coalesce("step", F.lit(0)).alias("step"), base.alias("base"))
    return _numbered(rows, "base", ["place", "step", "reason"]).select("id", "type", "src", "reference", "reason", "source")


def write_graph(graph: Graph, folder: str) -> Graph:
    """The graph as tables partitioned by type, read back: a filter on the type reads only its folders."""
    spark, parts = graph.nodes.sparkSession, []
    for name, rows in zip(Graph._fields, graph):
        rows.write.partitionBy("type").parquet(f"{folder}/{name}")
        parts.append(spark.read.parquet(f"{folder}/{name}").select(*rows.columns))
    return Graph(*parts)


def node(graph: Graph, node_id: str) -> DataFrame:
    return graph.nodes.filter(F.col("id") == node_id)


def outgoing(graph: Graph, node_id: str) -> DataFrame:
    return graph.edges.filter(F.col("src") == node_id)


def incoming(graph: Graph, node_id: str) -> DataFrame:
    return graph.edges.filter(F.col("dst") == node_id)


def graph_issues(graph: Graph) -> DataFrame:
    """(rule, subject): repeated identifiers, edges without their nodes or between wrong types, and unresolved rows whose
    source is no node. Empty for a sound graph."""
    found = violations(graph.nodes, graph.edges, ENDPOINTS)
    repeats = graph.unresolved.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("duplicate-unresolved").alias("rule"), F.col("id").alias("subject"))
    lost = graph.unresolved.join(graph.nodes.select(F.col("id").alias("src")), "src", "left_anti").select(F.lit("unresolved-missing-source").alias("rule"), F.col("id").alias("subject"))
    return found.unionByName(repeats).unionByName(lost)


def root_issues(roots: DataFrame) -> DataFrame:
    """(rule, subject): the manifests of roots (manifest, root) whose root is not that of the first manifest by name."""
    first = roots.agg(F.min_by(F.struct("root"), "manifest")["root"].alias("__first"))
    rows = roots.join(F.broadcast(first))  # one row
    return rows.filter(~F.col("root").eqNullSafe(F.col("__first"))).select(F.lit("root-mismatch").alias("rule"), F.col("manifest").alias("subject"))
