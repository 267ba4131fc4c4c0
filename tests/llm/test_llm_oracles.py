import pytest

from pairwright.llm.queries import ORACLE_SQL, QUERIES

from ..conftest import DATA
from ..oracle import compare, connection


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    sf = f"{DATA}/sf0.001"
    assert compare(spark, connection(sf), sf, name, QUERIES[name], ORACLE_SQL[name])
