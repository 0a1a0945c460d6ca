import pytest

from tessera.llm.registry import ORACLES, QUERIES
from tests.conftest import DATA
from tests.oracle import connection, differs


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    folder = f"{DATA}/sf0.01"
    assert differs(spark, connection(folder), QUERIES[name], ORACLES[name], folder) is None
