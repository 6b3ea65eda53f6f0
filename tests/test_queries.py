"""Every registered query of the engine's own operators against its SQL, or its rows alone."""

import pytest

from catalith.plans import registry
from tests.oracle import rows_of, same

FOLDER = "/root/testdata/sf0.01"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, FOLDER)
    if name in SQL:
        same(df, SQL[name], FOLDER)
        assert df.limit(1).count() == 1
    else:
        assert sum(rows_of(df)[1].values()) > 0


def test_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
