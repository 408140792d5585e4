"""Every registered query against its DuckDB form."""

import pytest

from support import same_rows
from strandloom.plans.catalog import oracle_sql, queries

SQL = oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, duck, name):
    ours, theirs = same_rows(queries()[name](spark, sf_dir), duck, SQL[name])
    assert len(ours) == len(theirs)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(queries()) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert queries()[name](spark, sf_dir).count() > 0
