"""The training-data queries that SQL can state give DuckDB's rows."""

import pytest

from lumenflow.llm import queries
from tests import oracle


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, sf, name):
    oracle.same(queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name], oracle.connect(sf))
