"""Every registered query of the panel engine against its SQL, or, without SQL, for rows and a stable schema."""

import pytest

from inkgrid import registry
from tests.compare import rows_of_duck, rows_of_spark

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, data, duck, name):
    assert rows_of_spark(QUERIES[name](spark, data)) == rows_of_duck(duck.sql(ORACLE[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_rows(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns and df.count() > 0


def test_entry_works_without_the_optional_subpackage(spark):
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).limit(1).count() == 1
