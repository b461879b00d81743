"""Each query of the catalogue against its SQL, on the smallest tables."""

import pytest
from support import DATA, rows_of, rows_of_sql

import __spark_entry__

CATALOG = {name: query for catalog in __spark_entry__._CATALOGS for name, query in catalog.queries.items()}
SQL = {name: sql for catalog in __spark_entry__._CATALOGS for name, sql in catalog.sql.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, spark, duck):
    assert rows_of(CATALOG[name](spark, f"{DATA}/sf0.001")) == rows_of_sql(duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(CATALOG) - set(SQL)))
def test_runs(name, spark):
    df = CATALOG[name](spark, f"{DATA}/sf0.001")
    assert df.schema == df.schema and df.count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 40
