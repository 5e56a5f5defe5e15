"""The queries of projections over small tables that reach every branch."""

import duckdb
import pytest

from tests import literals
from tests.test_queries import plain
from tracelake.plans import evidence_queries, model_queries

CASES = [(module, tables, name) for module, tables in ((evidence_queries, literals.EVIDENCE), (model_queries, literals.MODEL)) for name in module.queries()]


@pytest.mark.parametrize("module,tables,name", CASES, ids=[name for _, _, name in CASES])
def test_query_over_small_tables(spark, monkeypatch, module, tables, name):
    sql = literals.EXPECTED.get(name, module.oracle_sql()[name])
    for table in tables.tables:
        sql = sql.replace(module.T.table_sql(table), tables.table_sql(table))
    query = module.queries()[name]
    monkeypatch.setattr(module, "T", tables)
    found = query(spark, "")
    told = duckdb.connect().execute(sql)
    names = [x[0] for x in told.description]
    assert sorted(names) == sorted(found.columns)
    places = [names.index(c) for c in sorted(names)]
    assert plain(found.select(*sorted(names)).collect()) == plain([[row[i] for i in places] for row in told.fetchall()])
