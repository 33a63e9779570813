import random

import duckdb
import pandas as pd

from digestry.llm import mixing
from digestry.llm.common import written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(n, seed=1):
    pick = random.Random(seed)
    out = []
    for i in range(n):
        source = pick.choice(["a", "a", "a", "a", "b", "c", "", "é", None])
        text = pick.choice([None, "", " \t", "w " * pick.randint(1, 60)])
        out.append((pick.choice([i, i, i, None, 7]), text, "en", source, 0))
    return out


def taken(spark, data, ranged=None):
    docs = spark.createDataFrame(data, SCHEMA)
    sizes = written(mixing.queue_sizes(docs))
    _, cuts = mixing.mixture(sizes)
    from pyspark.sql import functions as F

    met = sizes.join(cuts, F.col("source").eqNullSafe(F.col("its_source")))
    return met.select("doc_id", "size", "source_size", "target", (F.col("size") * mixing.copies(F.col("key"), F.col("size"))).alias("taken"))


def check(spark, data):
    got = taken(spark, data)
    con = duckdb.connect()
    frame = pd.DataFrame(data, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64", "text": "string", "source": "string"})
    con.register("frame", frame)
    con.execute("CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(text AS VARCHAR) AS text, CAST(source AS VARCHAR) AS source FROM frame")
    want = con.execute(mixing.ORACLE["op8_mix_sources"]).fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    return got.toPandas()


def test_against_sql(spark):
    check(spark, rows(700))


def test_many_ranges_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 5)
    check(spark, rows(700, 2))


def test_many_slots_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 3)
    monkeypatch.setattr(mixing, "SLOTS_TOGETHER", 7)
    data = [(i, "w " * (i % 9), "en", f"s{i % 50}", 0) for i in range(300)] + [(1000 + i, "w " * 30, "en", "half", 0) for i in range(100)]
    data += [(pick, "w " * (i % 4), "en", "half", 0) for pick in (None, 5) for i in range(150)]
    check(spark, data)


def test_targets_and_caps(spark):
    data = [(i, "w " * 10, "en", "big", 0) for i in range(300)] + [(1000 + i, "w " * 10, "en", "tiny", 0) for i in range(3)]
    got = check(spark, data)
    by = got.groupby("source_size").agg(target=("target", "first"), taken=("taken", "sum"), most=("taken", "max"))
    assert by.loc[30, "target"] == 90 and by.loc[30, "taken"] == 90  # three times its size, and no more
    assert by.loc[3000, "target"] == 3030 - 90
    assert abs(by.loc[3000, "taken"] - 2940) <= 10
    assert (got.taken <= 3 * got["size"]).all()


def test_empty_and_wordless(spark):
    assert taken(spark, []).count() == 0
    assert [tuple(r) for r in taken(spark, [(1, None, "en", None, 0), (2, "", "en", "a", 0)]).orderBy("doc_id").collect()] == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_mixed_rows_are_the_taken_copies(spark):
    data = [(i, "w " * (i % 17), "en", "ab"[i % 5 == 0], i) for i in range(200)]
    docs = spark.createDataFrame([(*d, "clash") for d in data], SCHEMA + ", passes string")
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    words = out.toPandas().assign(size=lambda f: f.text.str.split().str.len()).groupby("doc_id")["size"].sum()
    want = taken(spark, data).toPandas().set_index("doc_id")["taken"]
    assert all(words.get(i, 0) == want[i] for i in want.index)
