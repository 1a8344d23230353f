"""Every query of the engine's own operators: against its SQL where it has one, else that it runs."""

import os

import pytest

from scopeframe.plans import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"create view {f.split('.')[0]} as select * from '{FOLDER}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    got = sorted(map(tuple, df.collect()), key=lambda r: [str(x) for x in r])
    if name in registry.SQL:
        columns = ", ".join(f'"{c}"' for c in df.columns)
        assert got == sorted(duck.execute(f"select {columns} from ({registry.SQL[name]})").fetchall(), key=lambda r: [str(x) for x in r])
