import duckdb

import __spark_entry__ as E
from digestry.sources.testdata import TABLES

SMOKE = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "title" in df.columns


def test_every_query_has_columns_matching_its_oracle(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    for name in ["q0_signal_digest", "d4_composite_dedup", "a03_rss_extract", "m2_keyword_score", "f12_due_subscriptions"]:
        sdf = qs[name](spark, SMOKE).toPandas()
        odf = con.execute(sqls[name]).fetchdf()
        assert sorted(sdf.columns) == sorted(odf.columns), name
        assert len(sdf) == len(odf), name
