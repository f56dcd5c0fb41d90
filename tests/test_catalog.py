"""Every query with SQL agrees with DuckDB on the small tables."""

import pytest
from conftest import duck, rows_of

from tallymix.plans import catalog

ORACLE = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_agrees_with_sql(spark, sf, name):
    got, want = catalog.queries()[name](spark, sf).toPandas(), duck(sf).execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_names_match():
    assert set(ORACLE) <= set(catalog.queries())


def test_flagship(spark, sf):
    rows = catalog.flagship(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/supplier.parquet").count()
    assert all(abs(sum(r.w) - 1) < 1e-9 for r in rows)
