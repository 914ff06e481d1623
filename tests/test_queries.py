import pytest

from quire import queries as q
from tests.oracle import both, connect

CONSTANT = {"first_render_error"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query_and_sql_agree(spark, con, sf, name):
    assert name in q.oracle_sql()
    got, want = both(spark, con, sf, q.queries()[name], q.oracle_sql()[name])
    assert got[0] == want[0]
    assert got[1] == want[1]
    assert len({r for r in got[1]}) > 1, "the result must vary"
