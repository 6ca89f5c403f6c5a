import pytest

from relweave.llm import queries
from tests.test_queries import compare, db, pytestmark  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, db, name):  # noqa: F811
    compare(spark, db, name)
