"""Reports against texts written out by hand, and the sink."""

from tracelake.operators import reports


def text(rows, report):
    return [r.line for r in sorted(rows, key=lambda r: r.place) if r.report_id == report]


def test_article_with_all_parts_and_without_any(spark):
    articles = spark.createDataFrame([("a", "Open", "It opens.", "Opened"), ("b", "Bare", None, None)], "report_id string, title string, summary string, expected string")
    items = spark.createDataFrame(
        [("a", "step", 2, "Click"), ("a", "step", 1, "Go"), ("a", "prerequisite", 1, "A key"), ("a", "note", 1, "n"), ("a", "writer-limitation", 1, "w"), ("a", "screenshot", 1, "a.png"), ("a", "limitation", 1, "l"), ("lost", "step", 1, "x"), (None, "step", 1, "x")],
        "report_id string, kind string, place int, text string",
    )
    evidence = spark.createDataFrame([("a", 4, "steps", 0, "Go", ["c1", "c2"], ["e"]), ("a", 7, "notes", 0, "n", [], [])], "report_id string, place int, section string, index int, text string, claim_ids array<string>, refs array<string>")
    rows = reports.article_report(articles, items, evidence).collect()
    assert text(rows, "a") == """# Open

It opens.

## Prerequisites

- A key

## Steps

1. Go
2. Click

## Expected result

Opened

## Notes

- n

## Limitations

- w

## Screenshots

- a.png

## Evidence limitations

- l

## Evidence / Review

STEPS 1: Go
Claims: c1, c2
Evidence: e

NOTES 1: n
Claims: 
Evidence: """.split("\n")
    assert text(rows, "b") == ["# Bare", "", "", "", "## Steps", "", "", "## Evidence / Review"] and {r.report_id for r in rows} == {"a", "b"}
    assert "## Evidence / Review" not in text(reports.article_report(articles, items).collect(), "a")


def test_empty_inputs_and_a_report_of_one_key(spark):
    nothing = spark.createDataFrame([], "report_id long, domain string, status string")
    coverage = spark.createDataFrame([(1, 2, 3, 4, 5)], "report_id long, states int, max_depth int, mutation_stops int, origin_boundaries int")
    zeros = "0 corroborated, 0 static-only, 0 runtime-only, 0 ambiguous"
    wanted = ["RECONCILIATION", f"ROUTE {zeros}", f"UI {zeros}", f"NAVIGATION {zeros}", f"HTTP {zeros}", f"GRAPHQL {zeros}", "RUNTIME COVERAGE 2 states / depth 3", "4 mutation stops, 5 origin boundaries"]
    assert text(reports.reconciliation_report(nothing, coverage).collect(), 1) == wanted
    assert reports.reconciliation_report(nothing, coverage.limit(0)).count() == 0
    many = spark.range(1, 20001).selectExpr("1L as report_id", "'step' as kind", "id as place", "concat('s', id) as text")
    rows = reports.article_report(spark.createDataFrame([(1, "t", "s", "")], "report_id long, title string, summary string, expected string"), many).collect()
    assert text(rows, 1) == ["# t", "", "s", "", "## Steps", "", *[f"{i}. s{i}" for i in range(1, 20001)]]


def test_written_reports_read_back(spark, tmp_path):
    rows = spark.range(1, 501).selectExpr("id % 2 as report_id", "floor((id + 1) / 2) as place", "concat('line ', id) as line")
    reports.write(rows, str(tmp_path / "out"), 5)
    for report, first in ((1, 1), (0, 2)):
        files = sorted((tmp_path / "out" / f"report_id={report}").glob("part-*"))
        assert [x for f in files for x in f.read_text().splitlines()] == [f"line {i}" for i in range(first, 501, 2)]
