"""Every query against its SQL, and the entry module without the training-data folder."""

import importlib
import math
import sys

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(rows):
    def value(v):
        return float(f"{v:.9g}") if isinstance(v, float) and not math.isnan(v) else v

    return sorted(repr([value(v) for v in row]) for row in rows)


QUERIES = {name: function for module in __spark_entry__.CORE for name, function in module.queries().items()}
SQL = {name: sql for module in __spark_entry__.CORE for name, sql in module.oracle_sql().items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    told = duck.execute(SQL[name])
    names = [x[0] for x in told.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert plain(found.select(*columns).collect()) == plain([[row[i] for i in places] for row in told.fetchall()])


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_entry_without_training_data(monkeypatch):
    monkeypatch.setitem(sys.modules, "tracelake.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    module = importlib.reload(__spark_entry__)
    assert set(module.queries()) == set(SQL)
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
