import pytest

from stemma.llm.queries import QUERIES, SQL
from tests.test_queries import compare


@pytest.mark.parametrize("name", list(SQL))
def test_against_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name])
