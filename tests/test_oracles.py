"""Every query with SQL gives the rows that DuckDB gives."""

import pytest
from conftest import canonical

from revlens import catalogue

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = catalogue.queries()[name](spark, sf_dir)
    found = duck.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(found.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_query_runs(spark, sf_dir, name):
    assert catalogue.queries()[name](spark, sf_dir).count() >= 1
