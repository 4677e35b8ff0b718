import pytest

from ledgerfold.queries import ORACLE_SQL, QUERIES
from tests.oracle import agree


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE_SQL.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query_gives_what_its_sql_gives(spark, name):
    agree(spark, QUERIES[name], ORACLE_SQL[name])
