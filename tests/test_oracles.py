"""Every registered query with SQL gives what DuckDB gives on the same tables."""

import pytest
from conftest import SF, rows

from arborix.plans import registry


#: At this size the volumes are too thin for a median to leave anything; test_tracks.py has a known answer.
EMPTY = {"v10_clean_up"}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name not in registry.ORACLE_SQL:
        assert len(got) or name in EMPTY
        return
    assert rows(got) == rows(duck.sql(registry.ORACLE_SQL[name]).df())


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
