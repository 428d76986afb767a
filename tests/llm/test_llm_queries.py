import pytest

from taleloom.llm import queries
from tests.test_queries import agrees, db  # noqa: F401


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, db, name):  # noqa: F811
    agrees(spark, db, name, queries.QUERIES[name], queries.SQL.get(name))
