"""Hand-made cases of the evidence operators."""

from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracelake.functions import routes as R
from tracelake.functions import text as X
from tracelake.functions import urls as U
from tracelake.operators import contracts, documents, graph, matching, routes, sequences


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def reconciled(spark, patterns, urls):
    states = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "state_id int, url string")
    declared = spark.createDataFrame([(f"route-{i}", p) for i, p in enumerate(patterns)], "route_id string, pattern string")
    return sorted((r.status, r.state_id or "", r.route_ids, r.reason) for r in routes.reconcile_routes(states, declared).collect())


def test_most_specific_route_is_selected(spark):
    declared = ["/*", "/:area/:key", "/garden/:key", "/garden/roses"]
    assert reconciled(spark, declared, ["https://plants.test/#/garden/roses?season=3"]) == [("corroborated", "0", "route-3", "hash-route-match")]
    assert reconciled(spark, declared[:3], ["https://plants.test/garden/roses"]) == [("corroborated", "0", "route-2", "route-parameter-match")]


def test_equally_specific_routes_are_ambiguous(spark):
    assert reconciled(spark, ["/*", "/garden/:key", "/:area/roses"], ["https://plants.test/garden/roses"]) == [("ambiguous", "0", "route-1|route-2", "multiple-equally-specific-routes")]


def test_wildcards_static_only_and_dynamic(spark):
    found = reconciled(spark, [None, "/", "/*", "/empty"], ["https://plants.test", "https://plants.test/far/away/", "https://plants.test/shelf#top"])
    assert [("corroborated", "0", "route-1", "route-path-exact"), ("corroborated", "1", "route-2", "route-parameter-match"), ("corroborated", "2", "route-2", "route-parameter-match")] == [r for r in found if r[0] == "corroborated"]
    assert [("ambiguous", "", "route-0", "dynamic-static-evidence"), ("static-only", "", "route-3", "no-runtime-state-for-route")] == sorted(r for r in found if r[0] != "corroborated")
    assert reconciled(spark, ["/shed"], ["https://plants.test/gone"]) == [("runtime-only", "0", "", "no-static-route-match"), ("static-only", "", "route-0", "no-runtime-state-for-route")]


def test_readiness_as_stream_and_as_table(spark, tmp_path):
    from datetime import datetime, timedelta

    from tracelake.plans.shape_queries import polls
    from tracelake.streaming import readiness

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    told = [("a", 1, "x", 1, 0), ("a", 2, "y", 1, 1), ("a", 3, "y", 1, 0), ("a", 4, "y", 1, 0), ("b", 1, "x", 0, 0), ("b", 2, "x", 0, 0), ("c", 1, "z", 2, 0), ("c", 9, "z", 2, 0), ("d", 1, "z", 2, 3), ("d", 2, "z", 2, 3), ("e", 1, "q", 1, 0), ("e", 2, "r", 1, 0)]
    rows = spark.createDataFrame([(s, datetime(2024, 1, 1, 0, 0, k), sig, e, n) for s, k, sig, e, n in told], "state_id string, polled_at timestamp, signature string, evidence int, loaders int")
    wanted = [("a", "ready", None, 3, 2000), ("b", "partial", "no-substantive-destination-content", 2, 1000), ("c", "partial", "unstable-destination-content", 1, 0), ("d", "partial", "visible-loading-state", 2, 1000), ("e", "partial", "unstable-destination-content", 2, 1000)]
    shown = lambda df: sorted((r.state_id, r.status, r.timeout_reason, r.polls, r.elapsed_ms) for r in df.collect() if r.state_id != "end")
    assert shown(readiness.readiness_table(rows, timeout_ms=5000)) == wanted
    given = polls(spark, "/root/testdata/sf0.001").withColumn("polled_at", F.col("polled_at").cast("timestamp"))
    for name, table, timeout in (("small", rows, 5000), ("events", given, 36_000_000)):
        last = table.agg(F.max("polled_at")).first()[0] + timedelta(days=60)
        end = spark.createDataFrame([("end", last, "x", 0, 0)], table.schema)  # so that the watermark passes all timeouts
        table.unionByName(end).coalesce(1).write.parquet(str(tmp_path / name))
        stream = readiness.readiness_states(spark.readStream.schema(table.schema).parquet(str(tmp_path / name)), timeout_ms=timeout)
        run = stream.writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
        run.awaitTermination()
        assert shown(spark.read.parquet(str(tmp_path / f"{name}-out"))) == shown(readiness.readiness_table(table, timeout_ms=timeout))


@pytest.mark.parametrize("pattern,path,ranks", [("/a/:x?", "/a", [2]), ("/a/:x?", "/a/b", [2, 1]), ("/a/:x+", "/a", None), ("/a/:x*", "/a", [2]), ("/:x+", "/a/b", [0, 0]), ("/*", "/", [0]), ("/*/b", "/a/b", None), ("/a", "/a/b", None), ("/:x?", "/", [])])
def test_route_fit(spark, pattern, path, ranks):
    found = one(spark, R.route_fit(F.lit(pattern), F.lit(path)))
    assert (found.ranks if found else None) == ranks


def test_long_paths_are_whole(spark):
    long = "x" * 100_000
    assert one(spark, R.segments(F.lit(f"/{long}/end"))) == [long, "end"]
    assert one(spark, U.application_path(F.lit(f"https://a.test/#/{long}/end"))) == f"/{long}/end"
    assert one(spark, R.title_of(F.lit(f"{long}yz end"))) == f"X{long[1:]}yz End"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=4), min_size=2, max_size=4))
def test_dominance_is_a_strict_partial_order(spark, ranks):
    rows = [(False, r) for r in ranks]
    pairs = spark.createDataFrame([(i, j, rows[i], rows[j]) for i, j in permutations(range(len(rows)), 2)], "i int, j int, a struct<exact:boolean,ranks:array<int>>, b struct<exact:boolean,ranks:array<int>>")
    above = {(r.i, r.j) for r in pairs.filter(R.dominates(F.col("a"), F.col("b"))).collect()}
    assert not any((j, i) in above for i, j in above)
    assert all((i, k) in above for i, j in above for j2, k in above if j == j2 and i != k)


def test_reconcile_table(spark):
    declared = spark.createDataFrame([("one",), ("two",), ("two",), ("lone",), (None,)], "key string")
    observed = spark.createDataFrame([("one",), ("one",), ("two",), ("new",)], "key string")
    found = {(r.key, r.status, r.results) for r in matching.reconcile(declared, observed, "key").collect()}
    assert found == {("one", "corroborated", 1), ("two", "ambiguous", 1), ("lone", "static-only", 1), ("new", "runtime-only", 1), (None, "ambiguous", 1)}


def test_unique_left_join_and_first_match(spark):
    left = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    right = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "k string, v int")
    assert {(r.k, r.m, r.n_m) for r in matching.unique_left_join(left, right, ["k"], "v", "m").collect()} == {("a", 1, 1), ("b", None, 2), ("c", None, 0)}
    assert {tuple(r) for r in matching.first_match(right, ["k"], [-F.col("v")]).collect()} == {("a", 1), ("b", 3)}


def test_trace_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    found = graph.trace(edges, spark.createDataFrame([("a",)], "node string"))
    assert {(r.node, r.depth) for r in found.collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}


def test_violations(spark):
    nodes = spark.createDataFrame([("r", "route"), ("c", "component"), ("c", "component")], "id string, type string")
    edges = spark.createDataFrame([("e1", "RENDERS", "r", "c"), ("e2", "RENDERS", "c", "x")], "id string, type string, src string, dst string")
    found = {tuple(r) for r in graph.violations(nodes.dropDuplicates(), edges, [("RENDERS", "component", "route")]).collect()}
    assert found == {("missing-target", "x"), ("edge-endpoint-type", "e1")}
    assert ("duplicate-node", "c") in {tuple(r) for r in graph.violations(nodes, edges, []).collect()}


def test_argument_diff_and_blocks(spark):
    kind = "operation string, argument string, type string, required boolean, default_value string"
    a = spark.createDataFrame([("o", "x", "Int", True, "1"), ("o", "y", "Int", True, None)], kind)
    b = spark.createDataFrame([("o", "x", "Int", False, "1")], kind)
    assert {(r.argument, r.dimension, r.status) for r in contracts.argument_diff(a, b).collect()} == {("x", "presence", "match"), ("x", "type", "match"), ("x", "required", "conflict"), ("x", "default", "match"), ("y", "presence", "conflict")}
    found = one(spark, documents.blocks(F.lit("# Title\nfirst\r\nsecond\n\n- item\n2) two\nlast")))
    assert [(x.kind, x.text) for x in found] == [("heading", "Title"), ("paragraph", "first second"), ("list-item", "item"), ("list-item", "two"), ("paragraph", "last")]


def test_stable_runs(spark):
    rows = spark.createDataFrame([("p", i, s, e, l) for i, (s, e, l) in enumerate([("a", 0, 1), ("b", 1, 1), ("b", 1, 0), ("b", 1, 0)])], "k string, at int, sign string, e int, l int")
    assert [r.stable_polls for r in sequences.stable_runs(rows, "k", ["at"], "sign").orderBy("at").collect()] == [1, 1, 2, 3]
    assert sequences.first_ready(rows, "k", ["at"], "sign", "e", "l").first().ready_at.at == 2


@pytest.mark.parametrize("value,wanted", [("42", "opaque-identifier"), ("my-page", "stable-slug"), ("[id]", "redacted"), ("a" * 65, "opaque-identifier"), ("deadbeefdeadbeef", "opaque-identifier")])
def test_value_class(spark, value, wanted):
    assert one(spark, R.value_class(F.lit(value))) == wanted


def test_text_and_urls(spark):
    assert one(spark, U.sanitized_url(F.lit("https://a.test/p?token=x&b=1#/r?code=2"))) == "https://a.test/p?token=%5BREDACTED%5D&b=1#/r?code=%5BREDACTED%5D"
    assert one(spark, U.application_path(F.lit("https://a.test"))) == "/"
    assert one(spark, X.masked(F.lit("jo@mail.example.com"))) == "j***@***.com"
    assert one(spark, X.redacted(F.lit("Authorization: Bearer abc, api_key = 'k'"))) == "Authorization: Bearer [REDACTED], api_key = '[REDACTED]'"
    assert one(spark, X.mutation_term(F.lit("Please DELETE this"))) == "delete" and one(spark, X.mutation_term(F.lit("undeleted"))) is None
