"""Registered queries for the store, health, digest and model operators
(W1, F1/J1, M1, F2, M5, K2, K3, K7, M7, K4, K5, M9, M10, B1-B4, B7, J3, F11)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from digestry.functions import dates as D
from digestry.operators import digest, model, rank, store
from digestry.plans import catalog
from digestry.plans import sql_q0 as Z
from digestry.plans import sqlgen as Q
from digestry.plans.catalog import register
from digestry.plans.catalog_sources import ALL_ITEMS
from digestry.plans.signal_digest import run_digest
from digestry.session import checkpoint_dir, materialize, rewritten
from digestry.sources import payloads as P
from digestry.sources import testdata as TD

CHAIN = Z.chain()
HEALTH_AS_OF = "2024-01-31 00:00:00"
COOLDOWN_MINUTES = 60.0


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


HEALTH_SQL = """health AS (
  SELECT event_id AS id, 'src' || CAST(user_id AS VARCHAR) AS source,
         CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, ts AS last_check FROM events
)"""


# --------------------------------------------------------------------------------- W1, F1/J1


@register("w1_latest_health", f"""WITH {HEALTH_SQL}
SELECT source, arg_max(id, (last_check, id)) AS id, arg_max(status, (last_check, id)) AS status,
       strftime(max(last_check), '%Y-%m-%dT%H:%M:%S.%gZ') AS last_check FROM health GROUP BY source""")
def w1(spark: SparkSession, sf: str) -> DataFrame:
    latest = store.latest_per_source(TD.health_log(spark, sf))
    return latest.select("source", "id", "status", D.to_iso(F.col("last_check")).alias("last_check"))


@register("f1_cooldown_filter", f"""WITH {HEALTH_SQL},
sources AS (SELECT DISTINCT source AS id FROM documents UNION ALL SELECT 'page-' || CAST(page_id AS VARCHAR) FROM pages),
latest AS (SELECT source, max(last_check) AS last FROM health GROUP BY source)
SELECT s.id FROM sources s LEFT JOIN latest l ON s.id = l.source
WHERE l.last IS NULL OR CAST(epoch_us(TIMESTAMP '{HEALTH_AS_OF}') - epoch_us(l.last) AS DOUBLE) / CAST(6.0e7 AS DOUBLE) >= {Q.dbl(COOLDOWN_MINUTES)}""")
def f1(spark: SparkSession, sf: str) -> DataFrame:
    docs = TD.table(spark, sf, "documents").select(F.col("source").alias("id")).distinct()
    pages = TD.table(spark, sf, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("id"))
    kept = store.cooldown_filter(docs.unionByName(pages), TD.health_log(spark, sf), HEALTH_AS_OF, COOLDOWN_MINUTES)
    return kept.select("id")


# --------------------------------------------------------------------------------- M1, F2, K2, K7


@register("m1_high_water_mark", f"""WITH RECURSIVE {CHAIN}
SELECT (SELECT max(coalesce(published_at, digest_date)) FROM stored) AS hwm_previous,
       (SELECT max(coalesce(published_at, digest_date)) FROM stored_next) AS hwm_strict,
       (SELECT strftime(max(coalesce(CAST(published_at AS TIMESTAMP), CAST(digest_date AS TIMESTAMP))), '%Y-%m-%dT%H:%M:%S.%gZ') FROM stored_next) AS hwm_instant""")
def m1(spark: SparkSession, sf: str) -> DataFrame:
    run = catalog.q0_run(spark, sf)
    cols = ["published_at", "digest_date"]
    both = (TD.stored_articles(spark, sf).select(*cols, F.lit(0).alias("_v"))
            .unionByName(run.stored.select(*cols, F.lit(1).alias("_v"))))
    prev = store.high_water_mark(both.where(F.col("_v") == 0), True).first()["hwm"]
    # one aggregation over the next version gives both marks (no join)
    text_mark = F.max(F.coalesce(F.col("published_at"), F.col("digest_date")))
    inst = F.max(F.coalesce(D.parse_instant(F.col("published_at")), F.to_timestamp(F.col("digest_date"))))
    return both.where(F.col("_v") == 1).agg(
        F.lit(prev).alias("hwm_previous"), text_mark.alias("hwm_strict"), D.to_iso(inst).alias("hwm_instant"))


@register("f2_incremental_filter", f"""WITH RECURSIVE {CHAIN}
SELECT a.lang, count(f2.id) AS kept, count(*) - count(f2.id) AS dropped
FROM articles a LEFT JOIN f2 ON a.id = f2.id GROUP BY a.lang""")
def f2(spark: SparkSession, sf: str) -> DataFrame:
    arts = TD.articles(spark, sf)
    mark = store.read_mark(TD.stored_articles(spark, sf), True)
    kept = store.incremental_filter(arts, mark).select("id").withColumn("_kept", F.lit(1))
    j = arts.select("id", "lang").join(kept, "id", "left")
    return j.groupBy("lang").agg(F.count("_kept").alias("kept"), F.count_if(F.col("_kept").isNull()).alias("dropped"))


@register("k2_mark_delivered", f"""WITH RECURSIVE {CHAIN}
SELECT s.id, CASE WHEN i.id IS NOT NULL THEN 1 ELSE s.delivered END AS delivered
FROM stored_next s LEFT JOIN (SELECT DISTINCT lang, id FROM items) i ON s.id = i.id AND s.lang IS NOT DISTINCT FROM i.lang""")
def k2(spark: SparkSession, sf: str) -> DataFrame:
    run = catalog.q0_run(spark, sf)
    marked = store.mark_delivered(run.stored, run.delivered_items, any_channel_ok=True, key_cols=["lang", "id"])
    return marked.select("id", "delivered")


#: What each channel said of each tenant's digests; fr's digest of tenant a has no outcome yet.
OUTCOMES = [("a", "en", "webhook", "error"), ("a", "en", "slack", "ok"), ("a", "de", "webhook", "error"), ("a", "de", "slack", "error"), ("a", "es", "slack", "ok"),
            ("b", "en", "webhook", "error"), ("b", "de", "webhook", "ok"), ("b", "fr", "webhook", "ok"), ("b", "es", "slack", "error")]
_OUTCOMES_SQL = ", ".join(f"({', '.join(map(Q.q, o))})" for o in OUTCOMES)


@register("m9_k2_delivery_gate", f"""WITH RECURSIVE {CHAIN},
o(tenant, digest, channel, status) AS (VALUES {_OUTCOMES_SQL}),
done AS (SELECT DISTINCT tenant, digest FROM o WHERE status = 'ok'),
hit AS (SELECT DISTINCT d.tenant, i.id FROM items i JOIN done d ON d.digest = i.lang)
SELECT t.tenant, s.id, CASE WHEN h.id IS NOT NULL THEN 1 ELSE s.delivered END AS delivered
FROM stored_next s CROSS JOIN (VALUES ('a'), ('b')) t(tenant) LEFT JOIN hit h ON h.id = s.id AND h.tenant = t.tenant""")
def m9_k2(spark: SparkSession, sf: str) -> DataFrame:
    """Two tenants hold the same articles in one table, one digest per language each; only what a committed digest of the same
    tenant held becomes delivered, from a ledger written before delivery."""
    run = catalog.q0_run(spark, sf)
    tenants = F.explode(F.array(F.lit("a"), F.lit("b"))).alias("tenant")
    root = _scratch(spark, "deliveries")
    store.delivery_ledger(run.delivered_items.select(tenants, F.col("lang").alias("digest"), "id"), ["tenant"]).write.parquet(root)
    outcomes = spark.createDataFrame(OUTCOMES, "tenant string, digest string, channel string, status string")
    out = store.commit_deliveries(run.stored.select("*", tenants), spark.read.parquet(root), outcomes, ["tenant"])
    return out.select("tenant", "id", "delivered")


@register("f2_mark_per_source", f"""WITH {Q.articles_cte()}, {Z.stored_cte()},
st AS (SELECT *, CAST(id AS BIGINT) AS n FROM stored),
marks AS (SELECT source, max(TIMESTAMP '{TD.EPOCH_START}' + to_hours(CAST(n AS INTEGER))) AS mark FROM st GROUP BY source)
SELECT a.source, count(*) AS kept, min(a.id) AS least FROM articles a LEFT JOIN marks m ON m.source IS NOT DISTINCT FROM a.source
WHERE m.mark IS NULL OR a.published_ts > m.mark GROUP BY a.source""")
def f2_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """One mark per source, merged from two halves of the stored articles, each with its own publication date."""
    st = TD.stored_articles(spark, sf).withColumn("published_at", D.to_iso(TD.published_ts(F.col("id").cast("bigint"))))
    odd = F.col("id").cast("bigint") % 2 == 1
    marks = store.merge_marks(store.source_marks(st.where(odd)), store.source_marks(st.where(~odd), strict=True))
    new = store.incremental_filter_by_source(TD.articles(spark, sf), marks)
    return new.groupBy("source").agg(F.count("*").alias("kept"), F.min("id").alias("least"))


@register("k7_schema_evolution", """
SELECT CAST(doc_id AS VARCHAR) AS id, 0 AS delivered_first, CASE WHEN quality = 1 THEN 1 ELSE 0 END AS delivered FROM labels""")
def k7(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshot 1 of the table has no ``delivered`` column (the last migration
    adds it), snapshot 2 has it.  Each is read back as of its version."""
    st = TD.stored_articles(spark, sf)
    root = _scratch(spark, "articles")
    first = store.write_version(st.drop("delivered"), root)
    store.write_version(st, root)
    before = store.read_version(spark, root, first).select("id", F.col("delivered").cast("int").alias("delivered_first"))
    return before.join(store.read_latest(spark, root).select("id", F.col("delivered").cast("int").alias("delivered")), "id", "full_outer")


@register("k1_write_read_latest", f"""WITH RECURSIVE {CHAIN}
SELECT s.id, s.title, s.score, CASE WHEN i.id IS NOT NULL THEN 1 ELSE s.delivered END AS delivered
FROM stored_next s LEFT JOIN (SELECT DISTINCT lang, id FROM items) i ON s.id = i.id AND s.lang IS NOT DISTINCT FROM i.lang""")
def k1_versions(spark: SparkSession, sf: str) -> DataFrame:
    """The table before the run, after it and after delivery are three
    snapshots; the last one is read back whole, and once."""
    root = _scratch(spark, "articles")
    store.write_version(TD.stored_articles(spark, sf), root)
    run = catalog.q0_run(spark, sf)
    store.write_version(run.stored, root)
    store.write_version(store.mark_delivered(store.read_latest(spark, root), run.delivered_items, key_cols=["lang", "id"]), root)
    return store.read_latest(spark, root).select("id", "title", "score", "delivered")


@register("k1_bucketed_table", catalog.ORACLE["k1_write_read_latest"])
def k1_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """The same three states as versions of a bucketed table; the second and third write only the buckets they touch."""
    table = store.BucketedTable(spark, _scratch(spark, "article-buckets"), ["lang", "id"], 64)
    table.create(TD.stored_articles(spark, sf))
    run = catalog.q0_run(spark, sf)
    table.upsert(materialize(run.new_rows), "pos", ["lang"])
    table.mark_delivered(materialize(run.delivered_items))
    return table.read().select("id", "title", "score", "delivered")


@register("k1_two_groups_same_id", f"""WITH {Q.articles_cte()}, {Z.stored_cte()},
known AS (SELECT s.*, l.quality FROM stored s JOIN labels l ON s.id = CAST(l.doc_id AS VARCHAR))
SELECT 'a' AS tenant, id, CASE WHEN quality = 1 THEN 'a: ' || title ELSE title END AS title, delivered FROM known
UNION ALL SELECT 'b', id, 'b: ' || title, 0 FROM known WHERE quality = 1""")
def k1_tenants(spark: SparkSession, sf: str) -> DataFrame:
    """Two tenants share the table: one's rows are updated, the other's inserted under the same ids."""
    st = TD.stored_articles(spark, sf)
    new = st.where(F.col("delivered") == 1).withColumn("pos", F.lit(1)).withColumn("delivered", F.lit(0))
    new = new.withColumn("tenant", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumn("title", F.concat("tenant", F.lit(": "), "title"))
    out = store.upsert(st.withColumn("tenant", F.lit("a")), new, "pos", extra_cols=["tenant"], key_cols=["tenant", "id"])
    return out.select("tenant", "id", "title", "delivered")


@register("k1_content_of_later_duplicate", f"""WITH RECURSIVE {CHAIN}
SELECT id, lang, md5(coalesce(content, '')) AS content_md5 FROM stored_next""")
def k1_later(spark: SparkSession, sf: str) -> DataFrame:
    """Every article comes twice, first without its content: the survivor is
    the second row at the first one's position, and its content is stored."""
    arts = TD.articles(spark, sf)
    twice = arts.withColumn("content", F.lit("")).withColumn("ord", F.col("ord") * 2).unionByName(arts.withColumn("ord", F.col("ord") * 2 + 1))
    run = run_digest(twice, TD.SIGNAL_KEYWORDS, TD.NEGATIVE_KEYWORDS, catalog.q0_params(), catalog.RUN_AS_OF,
                     model_scores=TD.model_scores(spark, sf), analyses=TD.analyses(spark, sf), stored=TD.stored_articles(spark, sf))
    return run.stored.select("id", "lang", F.md5(F.coalesce("content", F.lit(""))).alias("content_md5"))


@register("f1_scan_pruning", f"""WITH {HEALTH_SQL},
cold AS (SELECT source FROM health GROUP BY source
  HAVING CAST(epoch_us(TIMESTAMP '{HEALTH_AS_OF}') - epoch_us(max(last_check)) AS DOUBLE) / CAST(6.0e7 AS DOUBLE) < {Q.dbl(1440.0)})
SELECT source AS source_id, count(*) AS payloads, CAST(sum(length(text)) AS BIGINT) AS characters FROM documents
WHERE source IS NOT NULL AND source NOT IN (SELECT source FROM cold) GROUP BY source""")
def f1_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as payloads, a folder per source; only folders of sources that were not checked within a day are read."""
    docs = TD.table(spark, sf, "documents").select(F.col("source").alias("source_id"), F.col("text").alias("payload"))
    path = store.write_payloads(docs, _scratch(spark, "payloads"))
    sources = docs.select(F.col("source_id").alias("id")).where("id IS NOT NULL")
    kept = store.active_payloads(spark.read.parquet(path), sources, TD.health_log(spark, sf), HEALTH_AS_OF, 1440.0)
    return kept.groupBy("source_id").agg(F.count("*").alias("payloads"), F.sum(F.length("payload")).alias("characters"))


# --------------------------------------------------------------------------------- M5, K3


def _envelopes(spark: SparkSession, sf: str):
    items, env = P.fan_out(TD.raw_payloads(spark, sf), TD.registry(spark, sf), TD.AS_OF)
    per_source = env.groupBy("source").agg(
        F.when(F.max(F.when(F.col("status") == "error", 1).otherwise(0)) == 1, F.lit("error")).otherwise(F.lit("ok")).alias("status"),
        F.min("error").alias("error"))
    return items, per_source


_M5_SQL = """m5 AS (
  SELECT source, CASE WHEN starts_with(source, 'api-') THEN 'error' ELSE 'ok' END AS status,
         CAST(count(*) FILTER (WHERE NOT starts_with(source, 'api-')) AS INTEGER) AS items_found,
         CASE WHEN starts_with(source, 'api-') THEN 'Unsupported API source' END AS error_message
  FROM (SELECT source FROM all_items UNION ALL SELECT DISTINCT 'api-' || event_type FROM events) GROUP BY source
)"""


@register("m5_health_records", f"WITH {ALL_ITEMS}, {_M5_SQL} SELECT * FROM m5")
def m5(spark: SparkSession, sf: str) -> DataFrame:
    items, env = _envelopes(spark, sf)
    return store.health_records(items, env)


@register("k3_health_append", f"""WITH {ALL_ITEMS}, {_M5_SQL}
SELECT d AS check_date, status, count(*) AS rows, CAST(sum(items_found) AS BIGINT) AS items_found
FROM m5, (VALUES ('2024-01-30'), ('2024-01-31')) v(d) GROUP BY 1, 2""")
def k3(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs appended to a health log partitioned by check date, one of them twice (a retry), read back."""
    items, env = _envelopes(spark, sf)
    rec = store.health_records(items, env)
    path = _scratch(spark, "health")
    rec = rewritten(rec)
    store.append_health(rec, path, "2024-01-30 08:00:00", "first")
    for _ in range(2):
        store.append_health(rec, path, "2024-01-31 08:00:00", "second")
    back = spark.read.parquet(path)
    return back.groupBy(F.col("check_date").cast("string").alias("check_date"), "status").agg(
        F.count("*").alias("rows"), F.sum("items_found").cast("bigint").alias("items_found"))


# --------------------------------------------------------------------------------- M7, K4, K5, M9, M10


@register("m7_digest_assembly", f"""WITH RECURSIVE {CHAIN}
SELECT lang, count(*) AS n_items, md5(string_agg(title, chr(10) ORDER BY pos)) AS titles_md5,
       max(total_new_items) AS total_new_items, max(total_selected) AS total_selected, max(digest_date) AS digest_date
FROM digest_items GROUP BY lang""")
def m7(spark: SparkSession, sf: str) -> DataFrame:
    docs = catalog.q0_run(spark, sf).digests
    return docs.select(
        "lang", F.size("items").cast("bigint").alias("n_items"),
        F.md5(F.array_join(F.transform("items", lambda x: x["title"]), "\n")).alias("titles_md5"),
        F.col("metadata.total_new_items").alias("total_new_items"), F.col("metadata.total_selected").alias("total_selected"),
        F.col("metadata.date").alias("digest_date"))


def _json_value(expr: str) -> str:
    return f"coalesce(CAST(to_json({expr}) AS VARCHAR), 'null')"


_K4_ITEM = ("'{' || " + " || ',' || ".join(
    f"'\"{name}\":' || {_json_value(name)}" for name in ("title", "url", "summary", "category", "source", "score")) + " || '}'")


@register("k4_digest_json", f"""WITH RECURSIVE {CHAIN}
SELECT lang, '{{"items":[' || string_agg({_K4_ITEM}, ',' ORDER BY pos) || '],"metadata":{{"total_new_items":'
       || CAST(max(total_new_items) AS VARCHAR) || ',"total_selected":' || CAST(max(total_selected) AS VARCHAR)
       || ',"date":"' || max(digest_date) || '"}}}}' AS json
FROM digest_items GROUP BY lang""")
def k4(spark: SparkSession, sf: str) -> DataFrame:
    return digest.to_json_doc(catalog.q0_run(spark, sf).digests, ["lang"])


def _block(kind: str, text_kind: str, text_expr: str, more: str = "") -> str:
    return (f"'{{\"type\":\"{kind}\",\"text\":{{\"type\":\"{text_kind}\",\"text\":' || "
            f"CAST(to_json({text_expr}) AS VARCHAR) || '{more}}}}}'")


_K5_LINE = ("'*<' || url || '|' || title || '>*' || chr(10) || '_' || category || '_ • ' || source || ' • Score: ' "
            f"|| CAST(score AS VARCHAR) || chr(10) || coalesce(nullif(summary, ''), {Q.q('No summary available.')})")
_K5_HEADER = _block("header", "plain_text", f"replace({Q.q(digest.HEADER_TEXT)}, '{{date}}', max(digest_date))", ',"emoji":true')
_K5_SUMMARY = _block("section", "mrkdwn", f"replace(replace({Q.q(digest.SUMMARY_TEXT)}, '{{selected}}', CAST(max(total_selected) AS VARCHAR)), "
                                          f"'{{new}}', CAST(max(total_new_items) AS VARCHAR))")
_K5_FOOTER = ("'{\"type\":\"context\",\"elements\":[{\"type\":\"mrkdwn\",\"text\":' || "
              f"CAST(to_json({Q.q(digest.FOOTER_TEXT)}) AS VARCHAR) || '}}]}}'")


@register("k5_chat_blocks", f"""WITH RECURSIVE {CHAIN}
SELECT lang, '{{"blocks":[' || {_K5_HEADER} || ',' || {_K5_SUMMARY} || ',{{"type":"divider"}},'
       || string_agg({_block('section', 'mrkdwn', _K5_LINE)}, ',' ORDER BY pos) || ',' || {_K5_FOOTER} || ']}}' AS json
FROM digest_items GROUP BY lang""")
def k5(spark: SparkSession, sf: str) -> DataFrame:
    return digest.chat_blocks(catalog.q0_run(spark, sf).digests, ["lang"])


def _sink(spark: SparkSession, docs: DataFrame, name: str) -> DataFrame:
    """Written, one digest written again as a retry does, and read back."""
    docs = materialize(docs)
    path = digest.write_documents(docs, _scratch(spark, name), ["lang"])
    digest.write_documents(docs.where(F.col("lang") == "en"), path, ["lang"])
    return digest.read_documents(spark, path, ["lang"])


@register("k4_file_sink", catalog.ORACLE["k4_digest_json"])
def k4_files(spark: SparkSession, sf: str) -> DataFrame:
    return _sink(spark, k4(spark, sf), "k4")


@register("k5_file_sink", catalog.ORACLE["k5_chat_blocks"])
def k5_files(spark: SparkSession, sf: str) -> DataFrame:
    return _sink(spark, k5(spark, sf), "k5")


@register("m9_delivery_outcome", """
SELECT strftime(ts, '%Y-%m-%d') AS digest, count(*) FILTER (WHERE event_type <> 'error') AS succeeded,
       count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type <> 'error') >= 1 AS commit
FROM events GROUP BY 1""")
def m9(spark: SparkSession, sf: str) -> DataFrame:
    ev = TD.table(spark, sf, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("digest"),
        F.when(F.col("event_type") == "error", F.lit("error")).otherwise(F.lit("ok")).alias("status"))
    return digest.delivery_outcome(ev, ["digest"])


@register("m10_stage_funnel", f"""WITH RECURSIVE {CHAIN}
SELECT a.lang, count(*) AS raw,
  (SELECT count(*) FROM f2 WHERE f2.lang = a.lang) AS new_items,
  (SELECT count(*) FROM d2 WHERE d2.lang = a.lang) AS unique_items,
  (SELECT count(*) FROM t1 WHERE t1.lang = a.lang) AS pruned,
  (SELECT count(*) FROM d3rows d WHERE d.lang = a.lang) AS fuzzy_kept,
  (SELECT count(*) FROM cov c WHERE c.lang = a.lang) AS candidates,
  (SELECT count(*) FROM sel s WHERE s.lang = a.lang) AS selected
FROM articles a GROUP BY a.lang""")
def m10(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.q0_run(spark, sf, finish=False).funnel(TD.articles(spark, sf))


# --------------------------------------------------------------------------------- B1-B4, B7, J3, F11


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """The candidates the model is asked about."""
    return model.to_model(catalog.q0_run(spark, sf, finish=False).candidates)


@register("b1_scoring_batches", f"""WITH RECURSIVE {CHAIN}
SELECT lang, CAST(floor((ask_rank - 1) / 10) AS INTEGER) AS batch, string_agg(title, chr(10) ORDER BY ask_rank) AS titles_text,
       count(*) AS n FROM asked GROUP BY 1, 2""")
def b1(spark: SparkSession, sf: str) -> DataFrame:
    b = model.scoring_batches(_asked(spark, sf), 10, "cov_rank", ["lang"])
    return b.select("lang", "batch", F.array_join("titles", "\n").alias("titles_text"), F.size("titles").cast("bigint").alias("n"))


def _prompt_sql(titles_agg: str, n: str) -> str:
    header = Q.q(model.SCORING_HEADER).replace("{n}", "' || " + f"CAST({n} AS VARCHAR)" + " || '")
    return f"{header} || chr(10) || chr(10) || 'Titles:' || chr(10) || {titles_agg} || chr(10)"


_BATCH_PROMPT = _prompt_sql("string_agg('- ' || title, chr(10) ORDER BY ask_rank)", "count(*)")


@register("b2_scoring_prompt", f"""WITH RECURSIVE {CHAIN}
SELECT lang, CAST(floor((ask_rank - 1) / 10) AS INTEGER) AS batch, md5({_BATCH_PROMPT}) AS prompt_md5
FROM asked GROUP BY 1, 2""")
def b2(spark: SparkSession, sf: str) -> DataFrame:
    b = model.scoring_batches(_asked(spark, sf), 10, "cov_rank", ["lang"])
    return b.select("lang", "batch", F.md5(model.scoring_prompt(F.col("titles"))).alias("prompt_md5"))


@register("b3_analysis_prompt", f"""WITH RECURSIVE {CHAIN}
SELECT lang, md5({Q.q(model.ANALYSIS_HEADER)} || chr(10) || chr(10) || 'Items:' || chr(10)
       || string_agg('ID ' || CAST(sel_rank - 1 AS VARCHAR) || ': ' || title, chr(10) ORDER BY sel_rank) || chr(10)) AS prompt_md5
FROM sel GROUP BY lang""")
def b3(spark: SparkSession, sf: str) -> DataFrame:
    sel = catalog.q0_run(spark, sf, finish=False).selected
    g = sel.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("sel_rank", "title"))), lambda x: x["title"]).alias("t"))
    return g.select("lang", F.md5(model.analysis_prompt(F.col("t"))).alias("prompt_md5"))


def _response_spark(lang, scores):
    """Test responses per batch: exact (en), one short (fr), one extra (de), out of range (es)."""
    as_text = F.transform(scores, lambda s: s.cast("string"))
    body = (F.when(lang == "fr", F.slice(as_text, 1, F.greatest(F.size(as_text) - 1, F.lit(0))))
            .when(lang == "de", F.concat(as_text, F.array(F.lit("50.0"))))
            .when(lang == "es", F.concat(F.array(F.lit("120.0")), F.slice(as_text, 2, 1000)))
            .otherwise(as_text))
    return F.concat(F.lit('{"scores":['), F.array_join(body, ","), F.lit("]}"))


@register("b7_j3_f11_score_alignment", f"""WITH RECURSIVE {CHAIN},
c AS (SELECT asked.lang, asked.id, CAST(floor((ask_rank - 1) / 10) AS INTEGER) AS batch, CAST((ask_rank - 1) % 10 AS INTEGER) AS pos,
             coalesce(ms.model_score, CAST(0 AS DOUBLE)) AS s, count(*) OVER (PARTITION BY asked.lang, floor((ask_rank - 1) / 10)) AS n
      FROM asked LEFT JOIN ms ON asked.id = ms.id)
SELECT lang, batch, pos, id,
  CASE WHEN lang = 'fr' AND pos = n - 1 THEN CAST(0 AS DOUBLE)
       WHEN lang = 'es' THEN CAST(0 AS DOUBLE)
       ELSE s END AS layer2
FROM c""")
def b7(spark: SparkSession, sf: str) -> DataFrame:
    scored = model.lookup_scores(_asked(spark, sf), TD.model_scores(spark, sf))
    b = rank.batch_numbers(scored, 10, "cov_rank", ["lang"])
    batches = b.groupBy("lang", "batch").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("batch_pos", "id"))), lambda x: x["id"]).alias("ids"),
        F.transform(F.array_sort(F.collect_list(F.struct("batch_pos", "layer2"))), lambda x: x["layer2"]).alias("_s"))
    resp = batches.withColumn("response", _response_spark(F.col("lang"), F.col("_s")))
    parsed = resp.withColumn("scores", model.parse_scores(F.col("response")))
    return model.align_scores(parsed, "scores", ["lang"]).select("lang", "batch", F.col("pos").cast("int").alias("pos"), "id", "layer2")


def _title_scorer(titles):
    """A scorer for the tests: the title's length, at most 100; a batch with a very long title has a score out of range."""
    return [float(len(t)) if len(t) > 400 else float(min(100, len(t))) for t in titles]


@register("b4_user_scorer", f"""WITH RECURSIVE {CHAIN}
SELECT lang, id, CASE WHEN max(length(title)) OVER (PARTITION BY lang, floor((ask_rank - 1) / 10)) > 400 THEN CAST(0 AS DOUBLE)
                      ELSE CAST(least(100, length(title)) AS DOUBLE) END AS layer2 FROM asked""")
def b4(spark: SparkSession, sf: str) -> DataFrame:
    """B4 + F11: one score out of 0..100 makes its whole batch 0."""
    return model.apply_scorer(_asked(spark, sf), _title_scorer, 10, "cov_rank", ["lang"]).select("lang", "id", "layer2")


@register("b4_scorer_in_q0", f"""WITH RECURSIVE {CHAIN},
s AS (SELECT lang, id, CASE WHEN max(length(title)) OVER (PARTITION BY lang, floor((ask_rank - 1) / 10)) > 400 THEN CAST(0 AS DOUBLE)
                            ELSE CAST(least(100, length(title)) AS DOUBLE) END AS l2 FROM asked)
SELECT cov.lang, cov.id, {Q.blend('layer1', 's.l2')} AS final_score FROM cov LEFT JOIN s ON cov.lang = s.lang AND cov.id = s.id""")
def b4_q0(spark: SparkSession, sf: str) -> DataFrame:
    run = run_digest(TD.articles(spark, sf), TD.SIGNAL_KEYWORDS, TD.NEGATIVE_KEYWORDS, catalog.q0_params(), catalog.RUN_AS_OF,
                     scorer=_title_scorer, stored=TD.stored_articles(spark, sf), finish=False)
    return run.blended.select("lang", "id", "final_score")


def _numbering_analyser(titles):
    """An analyser for the tests: the last item gets no answer, every other one no category."""
    return [(f"{i}: {t}", "" if i % 2 == 0 else "Odd") for i, t in enumerate(titles[:-1])]


@register("b5_user_analyser", f"""WITH RECURSIVE {CHAIN},
n AS (SELECT *, max(sel_rank) OVER (PARTITION BY lang) AS last FROM sel)
SELECT lang, id, CASE WHEN sel_rank < last THEN CAST(sel_rank - 1 AS VARCHAR) || ': ' || title END AS summary,
  CASE WHEN sel_rank = last THEN {Q.heuristic_category('title')} WHEN (sel_rank - 1) % 2 = 0 THEN 'Uncategorized' ELSE 'Odd' END AS category FROM n""")
def b5(spark: SparkSession, sf: str) -> DataFrame:
    run = run_digest(TD.articles(spark, sf), TD.SIGNAL_KEYWORDS, TD.NEGATIVE_KEYWORDS, catalog.q0_params(), catalog.RUN_AS_OF,
                     model_scores=TD.model_scores(spark, sf), analyser=_numbering_analyser, stored=TD.stored_articles(spark, sf), finish=False)
    return run.selected.select("lang", "id", "summary", "category")


@register("j4_alignment", f"""WITH RECURSIVE {CHAIN},
n AS (SELECT *, max(sel_rank) OVER (PARTITION BY lang) AS last FROM sel)
SELECT lang, id, CASE WHEN sel_rank < last THEN nullif(title, '') END AS summary, CASE WHEN sel_rank < last AND sel_rank % 2 = 0 THEN 'Even' ELSE 'Uncategorized' END AS category
FROM n""")
def j4(spark: SparkSession, sf: str) -> DataFrame:
    """B7 + J4: a JSON response per digest, one answer short, parsed and joined by position."""
    sel = catalog.q0_run(spark, sf, finish=False).selected.select("lang", "id", "title", "sel_rank")
    rows = sel.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("sel_rank", "title"))).alias("_r"))
    signals = F.transform(F.slice("_r", 1, F.size("_r") - 1), lambda r: F.struct(
        r["title"].alias("summary"), F.when(r["sel_rank"] % 2 == 0, "Even").otherwise("").alias("category")))
    resp = rows.select("lang", model.parse_analysis(F.to_json(F.struct(signals.alias("signals")))).alias("_a"))
    items = sel.join(resp, "lang").withColumn("pos", F.col("sel_rank") - 1)
    return model.align_analysis(items, F.col("_a")).select("lang", "id", "summary", "category")


# --------------------------------------------------------------------------------- F8, B6, B8


@register("f8_model_disabled", f"""WITH RECURSIVE {Z.chain(model_enabled=False)}
SELECT lang, CAST(sel_rank AS INTEGER) AS sel_rank, id, final_score FROM sel""")
def f8(spark: SparkSession, sf: str) -> DataFrame:
    """F8: the model layer is skipped; the final score is the layer-1 score."""
    sel = catalog.q0_run(spark, sf, finish=False, model_enabled=False).selected
    return sel.select("lang", "sel_rank", "id", "final_score")


FRACTIONAL = {k: v / 2 + 0.25 for k, v in TD.SIGNAL_KEYWORDS.items()}


@register("f8_fractional_weights", f"""WITH RECURSIVE {Z.chain(model_enabled=False, positive=FRACTIONAL)}
SELECT lang, CAST(sel_rank AS INTEGER) AS sel_rank, id, final_score FROM sel""")
def f8_fractional(spark: SparkSession, sf: str) -> DataFrame:
    """F8 with weights that aren't whole numbers: the score is not rounded before the threshold."""
    run = run_digest(TD.articles(spark, sf), FRACTIONAL, TD.NEGATIVE_KEYWORDS, catalog.q0_params(False), catalog.RUN_AS_OF,
                     stored=TD.stored_articles(spark, sf), finish=False)
    return run.selected.select("lang", "sel_rank", "id", "final_score")


@register("b6_per_item_analysis", f"""WITH RECURSIVE {CHAIN}
SELECT lang, id, NULL::VARCHAR AS summary, {Q.heuristic_category('title')} AS category FROM sel""")
def b6(spark: SparkSession, sf: str) -> DataFrame:
    """B6 + B5 failure path: one call per item (a batch of one); every call
    fails here, so each item gets a null summary and the title heuristic."""
    sel = catalog.q0_run(spark, sf, finish=False).selected.select("lang", "id", "title", "sel_rank")
    b = rank.batch_numbers(sel, 1, "sel_rank", ["lang"])
    return model.fallback_analysis(b).select("lang", "id", F.col("summary").cast("string").alias("summary"), "category")


def _length_of_prompt(prompt: str) -> str:
    return str(len(prompt))


@register("b8_run_audit", f"""WITH RECURSIVE {CHAIN},
p AS (SELECT lang, CAST(floor((ask_rank - 1) / 10) AS INTEGER) AS batch, {_BATCH_PROMPT} AS prompt FROM asked GROUP BY 1, 2)
SELECT lang, batch, md5(prompt) AS prompt_md5, CAST(length(prompt) AS VARCHAR) AS raw_response, true AS timed FROM p""")
def b8(spark: SparkSession, sf: str) -> DataFrame:
    """Prompt, raw response and measured latency of each model call."""
    b = model.scoring_batches(_asked(spark, sf), 10, "cov_rank", ["lang"]).withColumn("prompt", model.scoring_prompt(F.col("titles")))
    audit = model.run_audit(b, _length_of_prompt, ["lang"])
    return audit.select("lang", "batch", F.md5("prompt").alias("prompt_md5"), "raw_response", (F.col("latency_ms") >= 0).alias("timed"))
