"""Every query of the core library against its SQL over the smallest tables, whole."""

import decimal
import glob
import math
import os

import duckdb
import pytest

from quire import queries

SF = "/root/testdata/sf0.001"
Q, O = queries.all_queries(), queries.all_oracles()


def norm(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (float, int, decimal.Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else f"{v:.6g}" if v else "0"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(Q))
def test_query(spark, con, name):
    df = Q[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if name in O:
        want = con.sql(O[name])
        assert sorted(want.columns) == cols
        ix = [want.columns.index(c) for c in cols]
        assert got == sorted(tuple(norm(x[i]) for i in ix) for x in want.fetchall())
