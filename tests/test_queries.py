"""Each registered query with an oracle against DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tracewell.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        v = float(v)
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    assert glob.glob(f"{SF}/*")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, con, name):
    found = registry.QUERIES[name](spark, SF)
    want = con.execute(registry.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(found.columns) == sorted(names)
    order = sorted(names)
    a = sorted(tuple(plain(r[c]) for c in order) for r in found.collect())
    b = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in want.fetchall())
    assert a == b
