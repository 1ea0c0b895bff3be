import pytest

from lorewell.llm import queries
from tests.oracle import compare

from . import fixtures


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    compare(spark, fixtures.SMALL, queries.queries()[name], queries.oracle_sql()[name])
