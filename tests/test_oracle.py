"""Every registered query against its DuckDB statement on the smallest test tables."""

import pytest

from bomscope.registry import QUERIES
from compare import compare, connect
from oracle.queries import ORACLE
from settings import SF


@pytest.fixture(scope="session")
def con():
    return connect(SF)



@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches(name, bound, con):
    diff, _ = compare(QUERIES[name](bound), con, ORACLE[name])
    assert diff is None, diff


def test_every_query_has_a_check():
    assert set(QUERIES) == set(ORACLE)
