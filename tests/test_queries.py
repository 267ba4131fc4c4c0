"""Every query whose meaning SQL can express gives the rows of its SQL; the others give rows and repeat themselves."""

import pytest

from pairwright.plans.queries import ORACLE, QUERIES

from .conftest import DATA
from .oracle import compare, connection

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = connection(SF)
    c.execute("SET TimeZone = 'UTC'")
    yield c
    c.close()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, con, name):
    compare(spark, con, SF, name, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_repeats(spark, name):
    first = sorted(map(str, QUERIES[name](spark, SF).collect()))
    assert first
    assert first == sorted(map(str, QUERIES[name](spark, SF).collect()))
