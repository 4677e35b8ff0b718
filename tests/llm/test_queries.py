import pytest

from ledgerfold.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import agree


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_gives_what_its_sql_gives(spark, name):
    agree(spark, QUERIES[name], ORACLE_SQL[name])
