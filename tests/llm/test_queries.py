import pytest

from tests.compare import duck, same
from voxloom.llm.oracles import ORACLES
from voxloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, FOLDER)
    if name in ORACLES:
        same(df, duck(FOLDER), ORACLES[name])
    else:
        rows = df.collect()
        assert len({str(r) for r in rows}) == len(rows)
