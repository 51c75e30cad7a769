"""Every core query with an SQL twin gives its rows; the others run."""

import pytest

from tests.compare import duck, same
from voxloom.oracles import ORACLES
from voxloom.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    if name in ORACLES:
        same(df, con, ORACLES[name])
    else:
        rows = df.collect()
        assert len({str(r) for r in rows}) == len(rows)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
