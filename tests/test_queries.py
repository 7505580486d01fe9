"""Every query with SQL gives what DuckDB gives on the same tables."""

import decimal
import math

import duckdb
import pytest

from tallyforge.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


#: Characters of a physical plan beyond which expressions have multiplied: planning takes seconds then, and hundreds of MB.
LONGEST_PLAN = 300_000


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return str(int(v)) if isinstance(v, decimal.Decimal) and v == int(v) else f"{float(v):.9g}" if math.isfinite(v) else str(float(v))
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    assert len(df._jdf.queryExecution().executedPlan().toString()) < LONGEST_PLAN
    cols = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    r = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    assert got == sorted(str([plain(row[names.index(c)]) for c in cols]) for row in r.fetchall())
