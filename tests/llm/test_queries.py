"""The registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

from digestry.llm import catalog

DIR = "/root/testdata/sf0.001"


def test_all_queries():
    assert sorted(int(name[2:].split("_")[0]) for name in catalog.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    want = con.execute(catalog.ORACLE[name])
    columns = [c[0] for c in want.description]
    got = catalog.QUERIES[name](spark, DIR).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))
