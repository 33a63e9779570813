import pytest

from digestry.operators import store
from digestry.params import DigestParams
from digestry.streaming import incremental as X

POSITIVE = {"kilo": 40, "lima": 30}
OWN_TOPICS = {f"topic{i} ": 70 for i in range(10)}  # one keyword per item: none covers another's
SCHEMA = "id string, title string, url string, source string, content string, published_at string, published_ts timestamp, ord long"


def items(spark, first, last, content="kilo lima"):
    unlike = ["".join(chr(97 + (i * 7 + k * (i + 2)) % 26) for k in range(40)) for i in range(10)]
    rows = [(str(i), f"topic{i} {unlike[i]}", f"https://u.example/{i}", "s", content, f"2024-01-{i + 1:02d}T00:00:00.000Z", i)
            for i in range(first, last)]
    df = spark.createDataFrame(rows, "id string, title string, url string, source string, content string, published_at string, ord long")
    return df.selectExpr(*[c.split()[0] if c.split()[0] != "published_ts" else "to_timestamp(published_at) AS published_ts" for c in SCHEMA.split(", ")])


def selection(spark, tmp_path, files, batch_files, state=None, run="1", mark=None, **more):
    src = str(tmp_path / "in")
    stream = X.file_stream(spark, src, items(spark, 0, 1).schema, batch_files)
    state = state or str(tmp_path / f"state-{batch_files}")
    out = X.incremental_digest(stream, POSITIVE, {}, mark, run, f"{state}-out", state, f"{state}-ckpt", 60.0, 10, **more)
    return [r["id"] for r in out.orderBy("rank").collect()], state


def test_batch_size_changes_nothing_and_the_mark_moves(spark, tmp_path):
    src = str(tmp_path / "in")
    items(spark, 0, 6).repartition(5).write.mode("append").parquet(src)
    results = {n: selection(spark, tmp_path, src, n)[0] for n in (1, 4, 100)}
    assert results[1] == results[4] == results[100] == [str(i) for i in range(6)]
    # the next run of one of them drains only new files, and takes only what is newer than the mark
    items(spark, 3, 9).coalesce(1).write.mode("append").parquet(src)
    again, state = selection(spark, tmp_path, src, 4, state=str(tmp_path / "state-4"), run="2")
    assert again == ["6", "7", "8"]
    assert X.read_mark(spark, state) == "2024-01-09T00:00:00.000Z"
    # nothing new: an empty selection, and the mark stays
    assert selection(spark, tmp_path, src, 4, state=state, run="3")[0] == []
    assert X.read_mark(spark, state) == "2024-01-09T00:00:00.000Z"


def test_delay_takes_late_items(spark, tmp_path):
    items(spark, 0, 6).write.parquet(str(tmp_path / "in"))
    late, _ = selection(spark, tmp_path, None, 4, mark="2024-01-05T00:00:00.000Z", delay_minutes=2 * 1440.0)
    assert late == ["3", "4", "5"]
    assert X.delayed(None, 5) is None and X.delayed("2024-01-05", 0) == "2024-01-05"


def test_two_runs_of_the_whole_chain(spark, tmp_path):
    src, articles, state, health = (str(tmp_path / x) for x in ("in", "articles", "state", "health"))
    schema = items(spark, 0, 1).schema
    params = DigestParams(cooldown_minutes=5.0)

    def run(n, as_of):
        stream = X.file_stream(spark, src, schema, 1)
        return X.incremental_run(stream, OWN_TOPICS, {}, params, as_of, str(n), articles, state, f"{state}/ckpt", health)

    items(spark, 0, 3).write.mode("append").parquet(src)
    run(1, "2024-01-10 08:00:00")
    assert sorted(r["id"] for r in store.read_latest(spark, articles).collect()) == ["0", "1", "2"]
    items(spark, 1, 5).write.mode("append").parquet(src)
    run(2, "2024-01-10 09:00:00")
    assert sorted(r["id"] for r in store.read_latest(spark, articles).collect()) == ["0", "1", "2", "3", "4"]
    assert store.latest_version(spark, articles) == 2
    # one minute later the source is still cooling down
    items(spark, 5, 6).write.mode("append").parquet(src)
    run(3, "2024-01-10 09:01:00")
    assert store.read_latest(spark, articles).count() == 5
    assert spark.read.parquet(health).count() == 2


class Stopped(Exception):
    pass


@pytest.mark.parametrize(("step", "when"), [("drained", "before"), ("stored", "before")])
def test_a_stopped_run_is_completed_by_the_next(spark, tmp_path, monkeypatch, step, when):
    src, articles, state, health = (str(tmp_path / x) for x in ("in", "articles", "state", "health"))
    schema, params = items(spark, 0, 1).schema, DigestParams(cooldown_minutes=5.0)
    write = X.RunLedger._write

    def run(n, as_of):
        stream = X.file_stream(spark, src, schema, 100)
        return X.incremental_run(stream, OWN_TOPICS, {}, params, as_of, str(n), articles, state, f"{state}/ckpt", health)

    def stops(self, run_id, at, *more):
        if when == "after" or at != step:
            write(self, run_id, at, *more)
        if at == step:
            raise Stopped

    items(spark, 0, 3).coalesce(1).write.mode("append").parquet(src)
    monkeypatch.setattr(X.RunLedger, "_write", stops)
    with pytest.raises(Stopped):
        run(1, "2024-01-10 08:00:00")
    monkeypatch.setattr(X.RunLedger, "_write", write)
    run(2, "2024-01-10 09:00:00")
    run(2, "2024-01-10 09:30:00")  # a run that has ended changes nothing
    rows = store.read_latest(spark, articles).collect()
    assert sorted(r["id"] for r in rows) == ["0", "1", "2"]
    log = spark.read.parquet(health)
    assert [tuple(r) for r in log.select("source", "status", "items_found").collect()] == [("s", "ok", 3)]
    begun_by_1 = not (step == "begun" and when == "before")  # else the second run is the first to know of anything
    assert {str(r["last_check"]) for r in log.collect()} == {"2024-01-10 08:00:00" if begun_by_1 else "2024-01-10 09:00:00"}
    # what comes later is taken once, from the mark of the completed run
    items(spark, 1, 5).coalesce(1).write.mode("append").parquet(src)
    run(3, "2024-01-10 10:00:00")
    assert sorted(r["id"] for r in store.read_latest(spark, articles).collect()) == ["0", "1", "2", "3", "4"]
    assert sorted(r["items_found"] for r in spark.read.parquet(health).collect()) == [3, 4]


def test_a_selection_stopped_while_draining(spark, tmp_path, monkeypatch):
    src = str(tmp_path / "in")
    items(spark, 0, 6).repartition(3).write.parquet(src)
    complete = X.RunLedger.complete

    def stops(self, run_id, step):
        raise Stopped

    monkeypatch.setattr(X.RunLedger, "complete", stops)
    state = str(tmp_path / "state")
    with pytest.raises(Stopped):
        selection(spark, tmp_path, src, 1, state=state, run="1")
    monkeypatch.setattr(X.RunLedger, "complete", complete)
    assert selection(spark, tmp_path, src, 1, state=state, run="2")[0] == []
    assert sorted(r["id"] for r in spark.read.parquet(f"{state}-out/run=1").collect()) == [str(i) for i in range(6)]


def test_payload_stream_reports_failed_and_empty_sources(spark, tmp_path):
    from digestry.sources import payloads as P

    registry = spark.createDataFrame([(s, s, "json", f"https://{s}.example/", 1, [], None, {"title": "t"}) for s in ("good", "bad", "none", "old")], P.REGISTRY_SCHEMA)
    rows = [("good", 0, '{"items": [{"t": "a", "date": "2024-01-09"}, {"t": "b", "date": "2024-01-08"}]}'), ("bad", 0, "{"), ("none", 0, '{"items": []}'),
            ("old", 0, '{"items": [{"t": "c", "date": "2020-01-01"}]}')]
    df = spark.createDataFrame(rows, "source_id string, page bigint, payload string").selectExpr("*", "timestamp'2024-01-10' AS fetched_at")
    src = str(tmp_path / "in")
    df.coalesce(1).write.parquet(src)

    def parse(batch):
        return P.fan_out(batch, registry, "2024-01-10 08:00:00")

    root = str(tmp_path / "run")
    new = X.drain_new_items(X.file_stream(spark, src, df.schema, 1), "2024-01-01", root, str(tmp_path / "ckpt"), parse=parse)
    assert sorted(r["title"] for r in new.collect()) == ["a", "b"]
    got = {r["source"]: (r["status"], r["items_found"]) for r in X.drained_health(spark, root).collect()}
    assert got == {"good": ("ok", 2), "bad": ("error", 0), "none": ("ok", 0), "old": ("ok", 1)}


def test_staged_files_dont_grow_with_the_tasks_and_the_log_is_read_once(spark, tmp_path):
    rows = [(str(i), "abc"[i % 3], i) for i in range(240)]
    df = spark.createDataFrame(rows, "id string, source string, ord long").repartition(8)
    staged = X.stage_files(df, str(tmp_path / "staged"), "source")
    assert len(list((tmp_path / "staged").rglob("*.parquet"))) <= 4
    assert sorted(r["id"] for r in spark.read.parquet(staged).collect()) == sorted(r[0] for r in rows)
    # sources checked two and ninety minutes ago, and one that was never: only the first is silent
    health = spark.sql("""SELECT 1L AS id, 'a' AS source, timestamp'2024-01-10 07:58:00' AS last_check
                          UNION ALL SELECT 2L, 'b', timestamp'2024-01-10 06:30:00'""")
    schema = "id string, source string, published_at string, ord long"
    df.selectExpr("id", "source", "'2024-01-09' AS published_at", "ord").repartition(3).write.parquet(str(tmp_path / "in"))
    new = X.drain_new_items(X.file_stream(spark, str(tmp_path / "in"), schema, 1), None, str(tmp_path / "run"), str(tmp_path / "ckpt"), health,
                            "2024-01-10 08:00:00", 60.0)
    assert sorted(r["id"] for r in new.collect()) == sorted(r[0] for r in rows if r[1] != "a")
