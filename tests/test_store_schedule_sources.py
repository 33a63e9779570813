from pyspark.sql import functions as F

from digestry.operators import store, subscriptions
from digestry.sources import payloads as P

ART = "id string, title string, url string, source string, content string, summary string, category string, published_at string, score bigint, digest_date string, delivered int"


def test_upsert_updates_only_four_columns(spark):
    s = spark.createDataFrame([("1", "Old", "u", "s", "c", "sum", "Research", "2024-01-01T00:00:00.000Z", 10, "2024-01-01", 1)], ART)
    n = spark.createDataFrame([("1", "New", "u2", "s2", None, "sum2", "Policy", "2024-02-01T00:00:00.000Z", 70, "2024-02-01", 0, 1)],
                              ART + ", pos int")
    out = store.upsert(s, n).first()
    assert (out["title"], out["summary"], out["category"], out["score"]) == ("New", "sum2", "Policy", 70)
    assert (out["url"], out["published_at"], out["delivered"]) == ("u", "2024-01-01T00:00:00.000Z", 1)
    mark = store.read_mark(store.upsert(s, n), strict=True)
    assert mark == "2024-01-01T00:00:00.000Z"


def test_upsert_repeated_id_in_one_run(spark):
    s = spark.createDataFrame([], ART)
    n = spark.createDataFrame([("9", "First", "u1", "s", None, None, "A", None, 1, "d", 0, 1),
                               ("9", "Second", "u2", "s", None, None, "B", None, 2, "d", 0, 2)], ART + ", pos int")
    out = store.upsert(s, n).first()
    assert (out["title"], out["url"], out["category"], out["score"]) == ("Second", "u1", "B", 2)


def test_incremental_filter(spark):
    df = spark.createDataFrame([("a", None), ("b", "2024-01-02T00:00:00Z"), ("c", "2023-12-31T00:00:00Z"), ("d", "junk")],
                               "id string, published_at string")
    assert sorted(r["id"] for r in store.incremental_filter(df, "2024-01-01").collect()) == ["a", "b"]
    assert store.incremental_filter(df, None).count() == 4


def test_pending_selection(spark):
    rows = [("1", "t", "u", "s", None, "sum", "c", "2024-01-20T10:00:00.000Z", 70, "2024-01-19", 0),
            ("2", "t", "u", "s", None, None, "c", "2024-01-20T10:00:00.000Z", 70, "2024-01-20", 0),
            ("3", "t", "u", "s", None, "sum", "c", None, 70, "2024-01-20", 1),
            ("4", "t", "u", "s", None, "sum", "c", None, 50, "2024-01-20", 0),
            ("5", "t", "u", "s", None, "sum", "c", None, 90, "2024-01-20", 0)]
    df = spark.createDataFrame(rows, ART)
    got = sorted(r["id"] for r in store.pending(df, 60, "2024-01-20 18:00:00", 24).collect())
    assert got == ["1", "5"]


def test_cooldown(spark):
    src = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    h = spark.createDataFrame([(1, "a", "ok", F_ts := "2024-01-01 11:58:00"), (2, "b", "error", "2024-01-01 10:00:00")],
                              "id int, source string, status string, last_check string").withColumn("last_check", F.to_timestamp("last_check"))
    kept = sorted(r["id"] for r in store.cooldown_filter(src, h, "2024-01-01 12:00:00", 5).collect())
    assert kept == ["b", "c"]
    assert store.cooldown_filter(src, h, "2024-01-01 12:00:00", 5, force=True).count() == 3


SUBS = "id string, name string, cron string, scheduled_time string, active int, last_run string"


def test_due_rules(spark):
    rows = [
        ("never", "n", "daily", "08:00", 1, None),
        ("early", "n", "daily", "08:00", 1, "2024-01-09T08:05:00.000Z"),
        ("late", "n", "daily", "08:00", 1, "2024-01-09T08:05:00.000Z"),
        ("today", "n", "daily", "08:00", 1, "2024-01-10T00:30:00.000Z"),
        ("h24", "n", "hourly", None, 1, "2024-01-09T06:00:00.000Z"),
        ("h23", "n", "hourly", None, 1, "2024-01-09T07:00:00.000Z"),
        ("off", "n", "daily", None, 0, None),
    ]
    df = spark.createDataFrame(rows, SUBS)
    at6 = {r["id"]: r["due"] for r in subscriptions.due(df, "2024-01-10 06:00:00").collect()}
    at9 = {r["id"]: r["due"] for r in subscriptions.due(df, "2024-01-10 09:00:00").collect()}
    assert at6["never"] and not at6["early"] and not at9["today"] and at9["late"]
    assert at6["h24"] and not at6["h23"] and not at6["off"]


def test_runs_are_recorded_for_finished_groups_only(spark):
    rows = [("a", "en", "hourly", None, 1, None), ("b", "de", "hourly", None, 1, None), ("c", None, "hourly", None, 1, "2024-01-01T00:00:00.000Z"),
            ("d", "en", "hourly", None, 1, "2024-01-10T05:00:00.000Z")]
    df = spark.createDataFrame(rows, SUBS)
    at = "2024-01-10 06:00:00"
    assert {r["name"] for r in subscriptions.due_groups(df, at, ["name"]).collect()} == {"en", "de", None}
    finished = spark.createDataFrame([("en",), ("en",), (None,)], "name string")
    after = {r["id"]: r["last_run"] for r in subscriptions.record_runs(df, at, finished, ["name"]).collect()}
    now = "2024-01-10T06:00:00.000Z"
    assert after == {"a": now, "b": None, "c": now, "d": "2024-01-10T05:00:00.000Z"}  # b failed and stays due, d wasn't due
    assert [r["name"] for r in subscriptions.due_groups(df.withColumn("last_run", F.lit(now)), at, ["name"]).collect()] == []


def _payloads(spark, rows):
    return spark.createDataFrame(rows, "source string, page bigint, source_url string, mapping map<string,string>, payload string")


def test_unsupported_api_source_and_parser_failure(spark):
    p = _payloads(spark, [("other-api", 0, "https://x", None, '{"hits":[]}')])
    items, env = P.parse_news_api(p)
    assert items.count() == 0 and env.first()["error"] == P.MSG_UNSUPPORTED_API
    bad = _payloads(spark, [("rss-a", 0, "https://x", None, "<rss><channel><item><title>x</title></item>")])
    items, env = P.parse_rss(bad)
    assert items.count() == 0 and env.first()["status"] == "error"


def test_rss_fallbacks(spark):
    xml = ("<rss><channel><item><title>T1</title><link>https://l/1</link><description>&lt;b&gt;Hi&lt;/b&gt; there</description>"
           "<pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate></item><item><description>only</description></item></channel></rss>")
    items, env = P.parse_rss(_payloads(spark, [("feed", 0, "https://x", None, xml)]))
    got = items.orderBy("item_pos").collect()
    assert (got[0]["id"], got[0]["content"], got[0]["published_at"]) == ("https://l/1", "Hi there", "2024-01-02T03:04:05.000Z")
    assert (got[1]["id"], got[1]["title"], got[1]["url"]) == ("feed-undefined", "No Title", "")


def test_atom_ignores_default_namespace(spark):
    xml = ('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id> http://a/1 </id><title>A\n  long   title</title>'
           "<summary>s</summary><published>2024-01-01T00:00:00Z</published></entry></feed>")
    items, _ = P.parse_atom(_payloads(spark, [("arxiv-x", 0, "https://x", None, xml)]))
    r = items.first()
    assert (r["id"], r["title"]) == ("http://a/1", "A long title")


def test_mapped_json_and_reddit(spark):
    m = {"title": "heading", "url": "link"}
    rows = [("j", 0, "https://src", m, '[{"heading":"H","link":""},{"id":"x7"}]'),
            ("j2", 0, "https://src", {"items": "results"}, '{"results": {"not": "a list"}}'),
            ("reddit-r", 0, "https://r", None, '{"data":{"children":[{"data":{"name":"t3_1","title":"R","url":"/r/x","selftext":"","created_utc":1700000000}}]}}'),
            ("plain", 0, "https://p", None, "{}")]
    items, env = P.parse_json(_payloads(spark, rows), "2024-01-01 00:00:00")
    got = {(r["source"], r["item_pos"]): r for r in items.collect()}
    assert got[("j", 0)]["id"] == "json-j-0" and got[("j", 0)]["url"] == "https://src"
    assert got[("j", 1)]["id"] == "x7" and got[("j", 1)]["title"] == "No Title"
    assert got[("reddit-r", 0)]["url"] == "https://reddit.com/r/x"
    status = {r["source"]: (r["status"], r["error"]) for r in env.collect()}
    assert status["j2"] == ("ok", None) and status["plain"] == ("error", P.MSG_UNSUPPORTED_JSON)


def test_routing(spark):
    reg = spark.createDataFrame([("hn", "rss"), ("arxiv-cs", "rss"), ("reddit-x", "json"), ("z", "ftp"), ("github_trending", "rss")],
                                "id string, type string")
    got = {r["id"]: r["parser"] for r in P.route(reg).collect()}
    assert got == {"hn": "api", "arxiv-cs": "arxiv", "reddit-x": "json", "z": None, "github_trending": "scrape"}


def test_upsert_broadcast_and_shuffle_paths_agree(spark):
    s = spark.createDataFrame([(str(i), f"t{i}", "u", "s", None, "x", "c", None, i, "d", i % 2) for i in range(50)], ART)
    n = spark.createDataFrame([(str(i), f"n{i}", "u2", "s2", None, "y", "c2", None, 100 + i, "d2", 0, i) for i in range(40, 70)],
                              ART + ", pos int")
    fast = sorted(tuple(r) for r in store.upsert(s, n).collect())
    old = store.MAX_BROADCAST_NEW_ROWS
    try:
        store.MAX_BROADCAST_NEW_ROWS = 0
        slow = sorted(tuple(r) for r in store.upsert(s, n).collect())
    finally:
        store.MAX_BROADCAST_NEW_ROWS = old
    assert fast == slow and len(fast) == 70


def test_digest_run_skips_cooling_sources(spark):
    from digestry.params import DigestParams
    from digestry.plans.signal_digest import run_digest

    arts = spark.createDataFrame(
        [(str(i), f"headline number {i} about agents", f"https://s{i % 2}.example/{i}", f"s{i % 2}", "agents agents",
          None, i) for i in range(6)],
        "id string, title string, url string, source string, content string, published_at string, ord bigint")
    health = spark.createDataFrame([(1, "s0", "ok", "2024-01-01 11:59:00")], "id int, source string, status string, last_check string") \
        .withColumn("last_check", F.to_timestamp("last_check"))
    params = DigestParams(signal_threshold=0, max_items=10, enable_model_scoring=False, fuzzy_threshold=0.99)
    run = run_digest(arts, {"agents": 10}, {}, params, "2024-01-01 12:00:00", health=health, finish=False)
    assert {r["id"] for r in run.selected.collect()} <= {"1", "3", "5"}
    forced = run_digest(arts, {"agents": 10}, {}, params, "2024-01-01 12:00:00", health=health, force=True, finish=False)
    assert any(r["id"] in {"0", "2", "4"} for r in forced.selected.collect())


FEEDS = [
    ("enc", "<rss><channel><item><title>a</title><link>l1</link><content:encoded>&lt;p&gt;x &amp;#233;&amp;#x27; &amp;#0; &amp;#z;&lt;/p&gt;</content:encoded></item></channel></rss>"),
    ("atom", '<?xml version="1.0"?><!-- c --><feed xmlns="http://www.w3.org/2005/Atom"><entry><id>i</id><title> t </title><link rel="self" href="s"/>'
             '<link href="l2"/><summary>sum</summary><updated>2024-01-02T03:04:05Z</updated></entry></feed>'),
    ("rdf", '<rdf:RDF xmlns:rdf="r"><channel><title>c</title></channel><item><title>b</title><link>l3</link><dc:date>2024-01-02T03:04:05Z</dc:date></item></rdf:RDF>'),
    ("html", "<html><body>404</body></html>"),
    ("null", None),
]


def test_feed_variants_by_root_element(spark):
    df = _payloads(spark, [(name, 0, "https://x", None, text) for name, text in FEEDS])
    items, env = P.parse_rss(df)
    got = {r["source"]: r for r in items.collect()}
    assert sorted(got) == ["atom", "enc", "rdf"]
    assert (got["enc"]["id"], got["enc"]["content"]) == ("l1", "x \u00e9' &#0; &#z;")
    assert [got["atom"][c] for c in ("id", "title", "url", "content", "published_at")] == ["l2", "t", "l2", "sum", "2024-01-02T03:04:05.000Z"]
    assert [got["rdf"][c] for c in ("title", "url", "published_at")] == ["b", "l3", "2024-01-02T03:04:05.000Z"]
    assert {r["source"]: r["status"] for r in env.collect()} == {"enc": "ok", "atom": "ok", "rdf": "ok", "html": "error", "null": "error"}


def test_rss_behind_an_id_prefix(spark):
    reg = spark.createDataFrame([("arxiv-x", "n", "rss", "https://x", 1, None, None, None)], P.REGISTRY_SCHEMA)
    pay = spark.createDataFrame([("arxiv-x", 0, FEEDS[0][1])], "source_id string, page bigint, payload string")
    assert P.fan_out(pay, reg, "2024-01-01 00:00:00")[0].count() == 1
    assert P.fan_out(pay, reg, "2024-01-01 00:00:00", strict_routing=True)[0].count() == 0


def test_href_resolution(spark):
    from digestry.functions import urls as U

    base = "https://h.example/a/b/c?q=1#f"
    cases = {"../x": "https://h.example/a/x", "./x": "https://h.example/a/b/x", "../../../x": "https://h.example/x", "/p/./q/../r?s=../t": "https://h.example/p/r?s=../t",
             "..": "https://h.example/a/", "mailto:a@b.example": "mailto:a@b.example", "ftp://f/x": "ftp://f/x", "x": "https://h.example/a/b/x", "//o/x": "https://o/x",
             "#z": "https://h.example/a/b/c#z", "": base}
    rows = spark.createDataFrame([(h, base) for h in cases], "h string, b string").select("h", U.resolve_url("h", "b").alias("r")).collect()
    assert {r["h"]: r["r"] for r in rows} == cases


def test_blocks_by_the_sources_own_selector(spark):
    page = ('<ul><li><a href="/nav">nav</a></li></ul><div class="wide post"><h2>T &#49;</h2><a class="more" href="../x">go</a><p>one</p><p>two</p></div>'
            '<div class="posting"><h2>no</h2></div><DIV class=\'post\'><h2></h2></DIV>')
    mapping = {"title": "h2", "url": "a.more", "content": "p"}
    rows = [("a", 0, "https://h.example/d/e/", mapping, ".post", page), ("b", 0, "https://h.example/", mapping, "div > .post", page),
            ("c", 0, "https://h.example/", mapping, "li", page), ("d", 0, "https://h.example/", mapping, ".post", None)]
    df = spark.createDataFrame(rows, "source string, page bigint, source_url string, mapping map<string,string>, selector string, payload string")
    items, env = P.parse_html_selected(df)
    got = {(r["source"], r["item_pos"]): (r["title"], r["url"], r["content"]) for r in items.collect()}
    assert got == {("a", 0): ("T 1", "https://h.example/d/x", "onetwo"), ("a", 1): ("No Title", "https://h.example/d/e/", ""),
                   ("c", 0): ("No Title", "https://h.example/", "")}
    assert {r["source"]: r["status"] for r in env.collect()} == {"a": "ok", "b": "ok", "c": "ok", "d": "error"}


def test_reports_and_digests_as_rows(spark):
    import json

    import pytest

    from digestry.operators import audit, digest, rank

    rows = spark.range(500).selectExpr("IF(id < 400, 'hot', IF(id < 499, 'b', NULL)) AS g", "id", "(id * 7919) % 500 AS key")
    got = rank.numbered(rows, ["g"], ["key"]).collect()
    for group, n in (("hot", 400), ("b", 99), (None, 1)):
        mine = sorted((r for r in got if r["g"] == group), key=lambda r: r["key"])
        assert [(r["pos"], r["total"]) for r in mine] == [(i + 1, n) for i in range(n)]

    feeds = spark.createDataFrame(
        [(f"s{i:03}", "error" if i % 5 == 0 else "ok", i, 10 * i, 10, "bad" if i % 5 == 0 else None) for i in range(60)],
        "source string, status string, item_count bigint, total_characters bigint, average_item_size bigint, error string")
    document = json.loads(audit.audit_report(feeds).first()["json"])
    lines = [json.loads(r["json"]) for r in audit.audit_report(feeds, max_details=59).collect()]
    assert lines[0] == {"summary": document["summary"]} and lines[1:] == document["details"] and len(lines) == 61
    assert [json.loads(r["json"]) for r in audit.report_rows(feeds).orderBy("pos").collect()] == lines

    big = spark.range(digest.MAX_DIGEST_ITEMS + 1).selectExpr(
        "id + 1 AS pos", "id AS total", "'t' AS title", "'u' AS url", "'' AS summary", "'c' AS category", "'s' AS source", "1.0D AS score")
    counts = spark.createDataFrame([(7,)], "total_new_items bigint")
    assert digest.item_rows(big, counts, "2024-01-20").count() == digest.MAX_DIGEST_ITEMS + 1
    with pytest.raises(Exception, match="item rows"):
        digest.assemble(big, counts, "2024-01-20").collect()


def test_payloads_are_routed_once_and_texts_stay_the_same(spark):
    """each parser reads the folder of its own payloads, and texts that need no change skip the patterns."""
    from digestry.sources import payloads as P

    reg = spark.createDataFrame(
        [("a", "a", "rss", "https://a.example/", 1, [], None, None), ("b", "b", "json", "https://b.example/", 1, [], None, {"title": "t"}),
         ("c", "c", "none", "https://c.example/", 1, [], None, None)], P.REGISTRY_SCHEMA)
    rss = "<rss><channel><item><title>one</title><link>https://a.example/1</link><description> &amp;lt;b&amp;gt;x &amp;amp; y </description></item></channel></rss>"
    pay = spark.createDataFrame([("a", 0, rss), ("a", 1, "<rss>"), ("b", 0, '{"items": [{"t": "two"}]}'), ("b", 1, "{"), ("c", 0, "x")],
                                "source_id string, page long, payload string").withColumn("fetched_at", F.current_timestamp())
    items, env = P.fan_out(pay, reg, "2024-01-01 00:00:00")
    files = items.inputFiles()
    assert files and all("/parser=" in f for f in files)
    assert [(r["source"], r["page"], r["title"]) for r in items.orderBy("source", "page").collect()] == [("a", 0, "one"), ("b", 0, "two")]
    assert [(r["source"], r["page"], r["status"], r["items_found"]) for r in env.orderBy("source", "page").collect()] == [
        ("a", 0, "ok", 1), ("a", 1, "error", 0), ("b", 0, "ok", 1), ("b", 1, "error", 0), ("c", 0, "error", 0)]
    texts = ["", " ", "a", " a", "a\t\n", "\x0ba b\f", "a  ", "a \x85", "a \r\n", " a ", "<b>a</b>", "a < b", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = df.select(F.regexp_replace("t", r"^\s+|\s+$", ""), F.regexp_replace("t", r"<[^>]*>", "")).collect()
    assert [tuple(r) for r in df.select(P.js_trim(F.col("t")), P.strip_tags(F.col("t"))).collect()] == [tuple(r) for r in want]
    refs = spark.createDataFrame([("x",), ("&#233; &amp;lt; &quot;",), (None,)], "t string").select(P.html_unescape(F.col("t")).alias("t"))
    assert [r["t"] for r in refs.collect()] == ["x", 'é &lt; "', None]


def test_payloads_are_made_in_the_tasks_of_one_shuffle(spark, tmp_path):
    """each table is read once, its rows are dealt out by page before bodies are made and grouped, and the rows are the formats' own."""
    from digestry.sources import testdata as TD

    tables = {
        "documents": ([(0, "One. a & b", "en", "x"), (1, "Two. c", None, "x"), (2, "Un. <d>", "fr", "x"), (3, 'Drei. "e"', "de", "x"), (4, "Dos. f", "es", "x"),
                       (5, "Six. g", "en", "x"), (20, "Far. h", "en", "x"), (6, "Nul. i", "fr", None), (7, "Nil. j", "de", None)],
                      "doc_id bigint, text string, lang string, source string"),
        "benchmark": ([(1, "Bench. k")], "item_id bigint, text string"),
        "conversations": ([(0, 0, "user", "hi"), (0, 1, "assistant", "yo"), (1, 25, "user", "far")], "conv_id bigint, turn bigint, role string, text string"),
        "pages": ([(0, "https://h.example/", "<ul><li><a href='/x'>x</a></li></ul>"), (1, None, None)], "page_id bigint, url string, html string"),
        "events": ([(3, "view", '{"k": 3}'), (1, "view", '{"k": 1}'), (21, "view", None), (2, None, '{"k": 2}')], "event_id bigint, event_type string, props string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    got = TD.raw_payloads(spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    # the scan of `benchmark`, a small table, is the only one whose bodies are made before the shuffle
    assert plan.count("FileScan") == 5 and plan.count("ENSURE_REQUIREMENTS") == 1 and plan.count("REPARTITION_BY_COL") == 3
    rows = {}
    for r in got.collect():
        rows.setdefault((r["source_id"], r["page"]), []).append(r["payload"])
    assert sorted(k for k in rows if k[0]) == [
        ("api-view", 0), ("api-view", 1), ("arxiv-x", 0), ("evt-view", 0), ("evt-view", 1), ("github_trending", 0), ("github_trending", 3), ("hn", 0),
        ("json-x", 0), ("page-0", 0), ("page-1", 0), ("reddit-x", 0), ("rss-none-x", 0), ("rss-x", 0), ("rss-x", 1)]
    assert rows["evt-view", 0] == rows["api-view", 0] == ['[{"k": 1},{"k": 3}]'] and rows["evt-view", 1] == ["[]"]
    assert sorted(x[:6] for x in rows[None, 0]) == ['<?xml ', '[{"k":', '[{"k":', '{"kind']  # formats without a source stay apart
    rss = rows["rss-x", 0][0]
    assert rss.index("<title>One</title>") < rss.index("<description> a &amp; b</description>") < rss.index("<title>Six</title>") and rss.endswith("</channel></rss>")
    assert "<summary> &lt;d&gt;</summary>" in rows["arxiv-x", 0][0] and rows["json-x", 0][0].startswith('{"results":[{"heading":"Dos"')
    assert TD.payloads(spark, str(tmp_path)).exceptAll(got).isEmpty() and got.exceptAll(TD.payloads(spark, str(tmp_path))).isEmpty()


def test_blocks_of_several_pages_leave_together():
    """batches are as large as their rows ask for, not one per page, and never hold more than the bound."""
    import pyarrow as pa

    from digestry.sources import html_select as H

    names = ["source", "page", "source_url", "selector", "_title", "_url", "_content", "payload"]
    page = "<ul>" + "<li><a href='/x'>x</a></li>" * 2 + "</ul>"
    n = H.BATCH_ROWS // 2 + 10
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in (
        [f"s{i}" for i in range(n)], list(range(n)), ["u"] * n, ["li"] * n, ["a"] * n, ["a"] * n, pa.nulls(n, pa.string()), [page] * n)], names=names)
    out = list(H.blocks_of_pages([batch.slice(0, 7), batch.slice(7)]))
    assert [b.num_rows for b in out] == [H.BATCH_ROWS, 20]
    rows = [r for b in out for r in b.to_pylist()]
    assert [(r["source"], r["item_pos"], r["title"], r["href"]) for r in rows] == [(f"s{i}", k, "x", "/x") for i in range(n) for k in range(2)]
    assert list(H.blocks_of_pages([batch.slice(0, 0)])) == []


def test_health_log_has_as_many_files_as_its_rows_ask_for(spark, tmp_path):
    """few records are appended as few files, whatever the number of shuffle partitions."""
    import glob

    from digestry.session import rewritten

    items = spark.createDataFrame([(f"s{i}",) for i in range(50)], "source string")
    env = spark.createDataFrame([(f"s{i}", "ok", None) for i in range(50)], "source string, status string, error string").groupBy("source").agg(
        F.max("status").alias("status"), F.max("error").alias("error"))
    store.append_health(rewritten(store.health_records(items, env)), str(tmp_path / "h"), "2024-01-30 08:00:00", "first")
    assert len(glob.glob(f"{tmp_path}/h/**/*.parquet", recursive=True)) == 1
    assert spark.read.parquet(str(tmp_path / "h")).count() == 50


def test_a_report_is_one_document_for_any_number_of_sources(spark, monkeypatch):
    """the same document whatever the number of sources, and from one chunk or many."""
    import json

    from digestry.operators import audit

    schema = "source string, status string, item_count bigint, total_characters bigint, average_item_size bigint, error string"
    feeds = spark.range(10_050).selectExpr(
        "lpad(id, 6, '0') AS source", "IF(id % 5 = 0, 'error', 'ok') AS status", "id AS item_count", "10 * id AS total_characters",
        "10L AS average_item_size", "IF(id % 5 = 0, 'a \"b\"', NULL) AS error")
    whole = audit.audit_report(feeds).collect()
    assert len(whole) == 1
    document = json.loads(whole[0]["json"])
    assert [d["source"] for d in document["details"]] == [f"{i:06}" for i in range(10_050)]
    assert document["details"][5] == {"source": "000005", "status": "error", "itemCount": 5, "totalCharacters": 50, "averageItemSize": 10, "error": 'a "b"'}
    assert document["summary"] == {"totalFeeds": 10_050, "successfulFeeds": 8040, "failedFeeds": 2010, "totalItems": sum(range(10_050)), "totalCharacters": 10 * sum(range(10_050))}
    monkeypatch.setattr(audit, "REPORT_CHUNK", 7)
    assert audit.audit_report(feeds).collect() == whole
    none = json.loads(audit.audit_report(spark.createDataFrame([], schema)).first()["json"])
    assert none == {"summary": {"totalFeeds": 0, "successfulFeeds": 0, "failedFeeds": 0}, "details": []}


def test_nested_listings_are_built_and_read_back(spark):
    """21 articles make two pages, read once by each listing's selectors."""
    import __spark_entry__  # noqa: F401  (all queries, in their order)
    from digestry.plans import catalog_sources as C
    from digestry.sources import payloads as P

    arts = spark.createDataFrame([(i, f"T <{i}>", None if i == 3 else f"c & {i}") for i in range(21)], "ord bigint, title string, content string")
    pages = C._nested_listing(arts)
    assert sorted((r["source"], r["page"]) for r in pages.collect()) == [("any", 0), ("any", 1), ("child", 0), ("child", 1)]
    items = {(r["source"], r["page"], r["item_pos"]): (r["title"], r["id"], r["content"]) for r in P.parse_html_selected(pages)[0].collect()}
    assert len(items) == 21 + 42
    assert items["child", 0, 2] == ("T <2>", "https://list.example/x/2", "one inc & 2n")
    assert items["any", 1, 0] == ("T <20>q20", "https://list.example/a/y?n=20", "one ininc & 20Q")
    assert items["any", 1, 1] == ("q20", "https://q.example/20", "Q")
    assert items["child", 0, 3] == ("T <3>", "https://list.example/x/3", "one inn")  # without content
