import pytest

from proofmill.plans.catalogue import ORACLE, QUERIES
from tests.oracle_check import same


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_duckdb(spark, sf_dir, name):
    same(QUERIES[name](spark, sf_dir), ORACLE[name], sf_dir)
