"""Delivery by group, the bucketed table and the file sinks."""

import os

import pytest
from pyspark.sql import functions as F

from digestry.operators import digest, store


def stored(spark, rows):
    return spark.createDataFrame([(t, i, i, "u", "s", "c", "sum", "cat", None, 1, "2024-01-01", d) for t, i, d in rows],
                                 "tenant string, id string, title string, url string, source string, content string, summary string, category string, "
                                 "published_at string, score long, digest_date string, delivered int")


def test_delivery_marks_only_the_committed_digests_of_a_tenant(spark):
    table = stored(spark, [("a", "1", 0), ("b", "1", 0), (None, "1", 0), ("a", "2", 0), ("a", "3", 0), ("b", "4", 1)])
    items = spark.createDataFrame([("a", "d1", "1"), ("a", "d1", "1"), ("a", "d2", "2"), ("b", "d1", "1"), (None, "d1", "1")], "tenant string, digest string, id string")
    outcomes = spark.createDataFrame([("a", "d1", "error"), ("a", "d1", "ok"), ("a", "d2", "error"), ("b", "d2", "ok"), (None, "d1", "ok")],
                                     "tenant string, digest string, status string")
    ledger = store.delivery_ledger(items, ["tenant"])
    assert ledger.count() == 4
    out = store.commit_deliveries(table, ledger, outcomes, ["tenant"])
    assert out.columns == table.columns
    assert {(r["tenant"], r["id"]) for r in out.where("delivered = 1").collect()} == {("a", "1"), (None, "1"), ("b", "4")}


def test_marks_per_source(spark):
    schema = "id string, source string, published_at string, digest_date string"
    old = spark.createDataFrame([("1", "a", "2024-01-05T00:00:00Z", "2024-01-05"), ("2", "b", "2024-01-01T00:00:00Z", "2024-01-02"), ("3", "c", None, "2024-01-04")], schema)
    new = spark.createDataFrame([("4", "a", "2024-01-04T00:00:00Z", ""), ("5", "b", "2024-01-02T00:00:00Z", ""), ("6", "d", "2020-01-01", ""), ("7", "a", None, ""),
                                 ("8", "b", "no date", ""), ("9", "d", "no date", ""), ("10", "c", "2024-01-03", ""), ("11", None, "2024-01-03", "")], schema)
    kept = store.incremental_filter_by_source(new, store.merge_marks(store.source_marks(old), store.source_marks(old.limit(0))))
    assert {r["id"] for r in kept.collect()} == {"5", "6", "7", "9", "11"}
    assert kept.columns == new.columns


def files(root, version):
    return sorted(b for b in os.listdir(f"{root}/data/v={version:08d}") if b.startswith("bucket="))


def test_bucketed_table_writes_what_a_run_touches(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    table = store.BucketedTable(spark, root, ["tenant", "id"], 32)
    rows = [(t, str(i), 0) for t in ("a", "b") for i in range(100)]
    assert table.create(stored(spark, rows)) == 1
    new = stored(spark, [("a", "7", 0), ("a", "new", 0)]).withColumn("title", F.lit("changed")).withColumn("pos", F.lit(1))
    assert table.upsert(new, "pos", ["tenant"]) == 2
    assert 1 <= len(files(root, 2)) <= 2 and len(files(root, 1)) == 32
    got = {(r["tenant"], r["id"]): r["title"] for r in table.read().collect()}
    assert len(got) == 201 and got["a", "7"] == got["a", "new"] == "changed" and got["b", "7"] == "7"
    assert table.read(1).count() == 200  # an older version stays as it was
    delivered = spark.createDataFrame([("b", "7")], "tenant string, id string")
    # a run stopped before its manifest is written leaves the table as it was, and its retry completes it
    monkeypatch.setattr(store.BucketedTable, "MANIFEST", "no schema")
    with pytest.raises(Exception):
        table.mark_delivered(delivered)
    monkeypatch.undo()
    assert table.versions() == 2 and table.read().where("delivered = 1").count() == 0
    assert table.mark_delivered(delivered) == 3
    assert [(r["tenant"], r["id"]) for r in table.read().where("delivered = 1").collect()] == [("b", "7")]
    assert table.mark_delivered(delivered.limit(0)) == 3  # nothing to do: no version
    with pytest.raises(ValueError, match="32 buckets"):
        store.BucketedTable(spark, root, ["tenant", "id"], 8).read()


def test_bucketed_table_without_rows(spark, tmp_path):
    table = store.BucketedTable(spark, str(tmp_path / "t"), ["tenant", "id"], 4)
    table.create(stored(spark, []))
    assert table.read().count() == 0
    table.upsert(stored(spark, [("a", "1", 0)]).withColumn("pos", F.lit(1)), "pos", ["tenant"])
    assert [(r["tenant"], r["id"]) for r in table.read().collect()] == [("a", "1")]


def test_documents_as_files(spark, tmp_path):
    docs = spark.createDataFrame([("01", '{"a":"x\\n"}'), ("1", "{}"), (None, "[]"), ("a/b =", '{"é":1}')], "g string, json string")
    path = digest.write_documents(docs, str(tmp_path / "out"), ["g"])
    digest.write_documents(docs.where("g = '1'").withColumn("json", F.lit("{2}")), path, ["g"])
    want = {("01", '{"a":"x\\n"}'), ("1", "{2}"), (None, "[]"), ("a/b =", '{"é":1}')}
    assert {tuple(r) for r in digest.read_documents(spark, path, ["g"]).collect()} == want
    assert sum(f.startswith("part-") for _, _, names in os.walk(path) for f in names) == 4
    one = digest.write_documents(docs.limit(1).select("json"), str(tmp_path / "one"))
    assert digest.read_documents(spark, one).count() == 1


def test_a_cooled_source_is_not_scanned(spark, tmp_path):
    payloads = spark.createDataFrame([(s, i, "x" * 10) for s in ("cold", "old", "never") for i in range(20)], "source_id string, page int, payload string")
    path = store.write_payloads(payloads, str(tmp_path / "p"))
    health = spark.createDataFrame([("cold", 1, "2024-01-10 07:59:00"), ("cold", 0, "2023-01-01"), ("old", 2, "2024-01-10 07:00:00")], "source string, id int, at string")
    health = health.selectExpr("source", "id", "CAST(at AS timestamp) AS last_check")
    sources = payloads.selectExpr("source_id AS id")
    whole = spark.read.parquet(path)
    kept = store.active_payloads(whole, sources, health, "2024-01-10 08:00:00", 5.0)
    assert {r[0] for r in kept.select("source_id").distinct().collect()} == {"old", "never"}
    assert "dynamicpruning" in kept._jdf.queryExecution().executedPlan().toString()
    for file in (tmp_path / "p" / "source_id=cold").glob("part-*"):
        file.write_bytes(b"not parquet")  # reading it would fail
    assert kept.count() == 40
    forced = store.active_payloads(whole, sources, health, "2024-01-10 08:00:00", 5.0, force=True)
    with pytest.raises(Exception):
        forced.count()


def test_funnel_of_one_digest(spark):
    from digestry.params import DigestParams
    from digestry.plans.signal_digest import run_digest

    rows = [(str(i), f"kilo {'abcdefghij'[i] * 9}", f"https://u.example/{i % 4}", "s", "lima" if i else "", None, i) for i in range(6)]
    articles = spark.createDataFrame(rows, "id string, title string, url string, source string, content string, published_at string, ord long")
    run = run_digest(articles, {"kilo": 70, "aaa": 10}, {}, DigestParams(max_items=1, enable_model_scoring=False), "2024-01-10 08:00:00", finish=False)
    row = run.funnel(articles).first().asDict()
    assert (row["raw"], row["new_items"], row["unique_items"], row["pruned"], row["selected"]) == (6, 6, 4, 4, 1)
    assert row["fuzzy_kept"] == run.fuzzy.count() and row["candidates"] == run.candidates.count()
