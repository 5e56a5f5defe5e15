"""Ways that depend on size give the rows of the general way, and move less."""

import re

from pyspark.sql import functions as F

from tracelake.operators import apidocs, evidence_graph, ordering, reports, storage, trees


def held_reports(spark):
    """Reports 1 to 3 and one without results; 4 is no report. A link leads to no result, two results have no identifier."""
    results = spark.createDataFrame(
        [(r, p, None if r == 2 and p < 3 else r * 10 + 9 - p, f"s{p}", ["corroborated", "conflicting", "odd"][p % 3], None if p % 2 else f"d{p}", None if p % 3 else f"n{p}", [True, False, None][p % 3]) for r in (1, 2, 3, 4) for p in range(1, 6)] + [(None, 1, 1, "s", "corroborated", None, None, True)],
        "report_id long, place long, result_id long, subject string, status string, documented string, static string, unproven boolean",
    )
    links = spark.createDataFrame([(1, 2, 18, "f2", None), (1, 1, 18, "f1", "one"), (1, 1, 15, None, None), (2, 1, None, "x", None), (2, 1, 25, "f1", "b"), (2, 1, 25, "f1", "a"), (3, 1, 77, "f1", None), (4, 1, 45, "f1", None)], "report_id long, place long, result_id long, feature_id string, name string")
    return spark.createDataFrame([(1,), (2,), (2,), (3,), (5,), (None,)], "report_id long"), results, links


def test_reports_by_windows_are_those_by_the_total_order(spark):
    given = held_reports(spark)
    rows = lambda df: sorted(map(tuple, df.collect()))
    wanted = rows(reports.contract_reconciliation_report(given[0].distinct(), *given[1:]))
    assert len(wanted) > 200 and {r[0] for r in wanted} == {1, 2, 3, 5}
    for large in ([], [(1,)], [(2,), (5,)]):
        found = reports.contract_reconciliation_report(given[0].distinct(), *given[1:], large=spark.createDataFrame(large, "report_id long"))
        assert rows(found) == wanted
    plan = found._jdf.queryExecution().executedPlan().toString()
    none = reports.contract_reconciliation_report(*given, large=spark.createDataFrame([], "report_id long"))
    above = none._jdf.queryExecution().executedPlan().toString().split("Generate")[0]
    assert "Generate" in plan and not re.search("Exchange|Sort|Window", above)


def test_numbers_of_large_keys(spark, monkeypatch):
    monkeypatch.setattr(ordering, "LARGE", 10)
    data = spark.range(100).select(F.when(F.col("id") >= 15, F.col("id") % 20).alias("k"), (100 - F.col("id")).alias("v"))
    large = ordering.large_keys(data, ["k"])
    assert [r.k for r in large.collect()] == [None]
    wanted = sorted(tuple(r) for r in ordering.numbers_within(data, ["k"], [F.col("v")], "n").select("v", "n").collect())
    for known in (large, large.filter("k = 1")):
        assert sorted(tuple(r) for r in ordering.numbers_within(data, ["k"], [F.col("v")], "n", known).select("v", "n").collect()) == wanted


def rows_of(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_one_table_of_the_graph_and_repeats_by_either_way(spark, monkeypatch):
    from tests.test_graph_and_shapes import example

    whole = evidence_graph.build_graph(example(spark))
    assert any("#2" in r.id for r in whole.nodes.collect()) and any("#2" in r.id for r in whole.edges.collect())
    for name in whole._fields:
        one = evidence_graph.build_graph(example(spark), name)
        assert [x is None for x in one] == [x != name for x in whole._fields] and rows_of(getattr(one, name)) == rows_of(getattr(whole, name))
    monkeypatch.setattr(evidence_graph, "FEW", 0)
    many = evidence_graph.build_graph(example(spark))
    assert all(rows_of(a) == rows_of(b) for a, b in zip(many, whole))


def test_kinds_of_keys_are_told(spark):
    from tests.test_graph_and_shapes import example

    facts = evidence_graph.collect_facts(example(spark))
    refs = facts.filter("part = 'reference'")
    kinds = lambda df: {r.key if not r.key.startswith("row|") else "|".join(r.key.split("|")[:2]) for r in df.filter("key is not null").select(F.when(F.startswith("key", F.lit("row|")), F.col("key")).otherwise(F.substring_index("key", "|", 1)).alias("key")).distinct().collect()}
    assert kinds(refs.select(F.col("src").alias("key"))) <= set(evidence_graph.SOURCES)
    assert kinds(facts.filter("needs is not null").select(F.col("needs").alias("key"))) <= set(evidence_graph.NEEDED)
    assert kinds(refs.filter("size(tries) > 1").select(F.explode("tries").alias("key"))) <= {*evidence_graph.TRIED, *evidence_graph.SYMBOLS}
    assert kinds(facts.filter("part = 'symbol'").select(F.explode("keys").alias("key"))) <= set(evidence_graph.SYMBOLS)
    assert not kinds(facts.filter("part = 'node'").select(F.explode("keys").alias("key"))) & set(evidence_graph.SYMBOLS)


def test_tables_give_up_what_was_shuffled_for_them_and_leave_the_session_as_it_was(spark):
    keys = ["spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.maxConcurrentOutputFileWriters"]
    was = [spark.conf.get(k) for k in keys]
    rows = storage.cut(spark.range(1000).select((F.col("id") % 3).alias("k"), "id"), "x", by=["k"])
    assert rows.columns == ["k", "id"] and rows.filter("k = 1").count() == 333 and [spark.conf.get(k) for k in keys] == was


ELEMENTS = "id string, parent string, kind string, name string, title string, place long, destination_kind string, destination string, text string"


def test_links_are_climbed_from_what_has_elements_below(spark, monkeypatch):
    def element(i, parent, name="div", title=None, destination=None, kind="element", place=0, text=None):
        return (i, parent, kind, name, title, place, destination and "static", destination, text)

    def said(i, parent, text, place, kind="text"):
        return element(i, parent, None, None, None, kind, place, text)

    rows = [
        element("top", None, "main"), element("menu", "top", "nav", "Menu"), element("a1", "menu", "a", None, "/1"), element("b", "a1", "b"), said("t1", "b", "one", 2), said("t2", "a1", "zero", 1), element("a2", "b", "X.Link", None, "/2"),
        said("t3", "a2", "x()", 3, "dynamic"), element("lone", None, "a", None, "/3"), said("t4", "lone", "alone", 4), said("t5", None, "nobody's", 5), element("lost", "gone", "a", None, "/4"), element("c1", "c2"), element("c2", "c1"), element("a3", "c1", "a", None, "/5"),
        element("no", "menu", "a"), said("t6", "menu", "no link", 6), element("bare", "menu", "Link", None, "/6"),
    ]
    seen = []
    real = trees.follow
    monkeypatch.setattr(trees, "follow", lambda df, **k: seen.append({r.node for r in df.select("node").collect()}) or real(df, **k))
    found = lambda rows: {r.id: (r.label_kind, r.label, r.ancestors) for r in trees.navigation_records(spark.createDataFrame(rows, ELEMENTS)).collect()}
    way = ["main", "nav: Menu"]
    wanted = {"a1": ("dynamic", "x()", way), "a2": ("dynamic", "x()", [*way, "b"]), "lone": ("static", "alone", []), "bare": ("static", "", way)}
    assert found(rows) == wanted and seen == [{"top", "menu", "a1", "b", "a2", "lone", "c1", "c2"} - {"a2", "lone"}]
    below = [*rows, element("in", "t3", "a", None, "/7"), said("t7", "in", "deep", 7)]
    assert found(below) == {**wanted, "in": ("static", "deep", [*way, "b"])}


def test_facts_of_documentation_that_may_be_there(spark):
    texts = [
        "See Pagination here. No paginations.x pagination\npagination of " + "a" * 200, "x" * 150 + " PAGINATION " + "y" * 200 + " pagination. pagination", None, "", "Graph&#81;L it is", "Graph<b>QL</b>", "see graphql.", "a&amp;b", "x\n  get  /v1/a", "get v1",
        "Query:\nop(a: Int): T", "op(a: Int): T\nQuery:", "op(a: Int): T", "query op(a: Int): T - what", "Mutation\n\n(not one): x\n go (): T", "Subscription\r\nx(a): b", "(:)",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")
    plain = docs.select("doc_id", F.explode(F.regexp_extract_all("content", F.lit(apidocs.PAGINATION), F.lit(0))).alias("text")).select("doc_id", apidocs.normal_space(F.col("text")).alias("text"))
    assert rows_of(apidocs.pagination(docs)) == rows_of(plain) and plain.count() > 4
    assert rows_of(apidocs.signed(docs)) == rows_of(apidocs.text_operations(docs).filter("type <> 'unknown'").select("doc_id").distinct())
    style = {r[0]: r[1] for r in docs.select("doc_id", apidocs.api_style(F.col("content"), F.lit(0))).collect()}
    assert {k for k, v in style.items() if v == "graphql"} == {4, 6} and {k for k, v in style.items() if v == "rest"} == {8}
