"""Every query of the subpackage with SQL gives what DuckDB gives on the same tables."""

import duckdb
import pytest

from tallyforge.llm import queries

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name, sf):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"create view {t} as select * from '/root/testdata/{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, f"/root/testdata/{sf}")
    cols = sorted(df.columns)
    r = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    got = sorted(str([x[c] for c in cols]) for x in df.collect())
    assert got == sorted(str([row[names.index(c)] for c in cols]) for row in r.fetchall()) and got


def test_revisits_refer_to_other_pages_captures(spark):
    rows = queries.op1_revisits(spark, "/root/testdata/sf0.01").collect()
    far = [r for r in rows if r["refers_to"] is not None and r["refers_to"] != r["record_id"] - 1]
    kinds = {r["verdict"] for r in rows}
    assert len(far) > 50 and {"etag", "last-modified", "digest", "changed", "unresolved"} <= kinds
