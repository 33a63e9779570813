"""Registered queries for the audit, quality rules and subscriptions
(M3, M4, K6, F9, F10, F12, F13)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from digestry.operators import audit, digest, subscriptions
from digestry.plans import catalog
from digestry.plans import sql_q0 as Z
from digestry.plans import sqlgen as Q
from digestry.plans.catalog import register
from digestry.session import checkpoint_dir
from digestry.plans.catalog_sources import ALL_ITEMS, REGISTRY_SQL
from digestry.sources import payloads as P
from digestry.sources import testdata as TD

PI = TD.PAGE_ITEMS
CHAIN = Z.chain()

AUDIT_SQL = f"""{ALL_ITEMS}, {REGISTRY_SQL},
env_err AS (SELECT DISTINCT 'api-' || event_type AS source, '{P.MSG_UNSUPPORTED_API}' AS error FROM events),
per_items AS (SELECT source, count(*) AS n, sum(length(coalesce(content, '')) + length(coalesce(title, ''))) AS chars FROM all_items GROUP BY source),
audit AS (
  SELECT r.id AS source, CASE WHEN e.source IS NOT NULL THEN 'error' ELSE 'ok' END AS status,
         CAST(coalesce(i.n, 0) AS BIGINT) AS item_count, CAST(coalesce(i.chars, 0) AS BIGINT) AS total_characters,
         CAST(CASE WHEN coalesce(i.n, 0) > 0 THEN round(CAST(i.chars AS DOUBLE) / CAST(i.n AS DOUBLE)) ELSE 0 END AS BIGINT) AS average_item_size,
         e.error
  FROM reg r LEFT JOIN env_err e ON r.id = e.source LEFT JOIN per_items i ON r.id = i.source
)"""


def _audit(spark: SparkSession, sf: str) -> DataFrame:
    reg = TD.registry(spark, sf)
    items, env = P.fan_out(TD.raw_payloads(spark, sf), reg, TD.AS_OF)
    return audit.feed_audit(reg, items, env)


@register("m3_feed_audit", f"WITH {AUDIT_SQL} SELECT * FROM audit")
def m3(spark: SparkSession, sf: str) -> DataFrame:
    return _audit(spark, sf)


@register("m4_audit_totals", f"""WITH {AUDIT_SQL}
SELECT count(*) AS total_feeds, count(*) FILTER (WHERE status = 'ok') AS successful_feeds,
       count(*) FILTER (WHERE status = 'error') AS failed_feeds, CAST(sum(item_count) AS BIGINT) AS total_items,
       CAST(sum(total_characters) AS BIGINT) AS total_characters FROM audit""")
def m4(spark: SparkSession, sf: str) -> DataFrame:
    return audit.audit_totals(_audit(spark, sf))


@register("k6_audit_report", f"""WITH {AUDIT_SQL},
d AS (
  SELECT string_agg('{{"source":"' || source || '","status":"' || status || '","itemCount":' || CAST(item_count AS VARCHAR)
         || ',"totalCharacters":' || CAST(total_characters AS VARCHAR) || ',"averageItemSize":' || CAST(average_item_size AS VARCHAR)
         || CASE WHEN error IS NULL THEN '' ELSE ',"error":"' || error || '"' END || '}}', ',' ORDER BY source) AS details FROM audit
), s AS (
  SELECT '{{"totalFeeds":' || CAST(count(*) AS VARCHAR) || ',"successfulFeeds":' || CAST(count(*) FILTER (WHERE status = 'ok') AS VARCHAR)
         || ',"failedFeeds":' || CAST(count(*) FILTER (WHERE status = 'error') AS VARCHAR) || ',"totalItems":' || CAST(sum(item_count) AS VARCHAR)
         || ',"totalCharacters":' || CAST(sum(total_characters) AS VARCHAR) || '}}' AS summary FROM audit
)
SELECT '{{"summary":' || s.summary || ',"details":[' || d.details || ']}}' AS json FROM s, d""")
def k6(spark: SparkSession, sf: str) -> DataFrame:
    return audit.audit_report(_audit(spark, sf))


@register("k6_file_sink", catalog.ORACLE["k6_audit_report"])
def k6_files(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{checkpoint_dir(spark).rstrip('/')}/k6-{uuid.uuid4().hex}"
    return digest.read_documents(spark, digest.write_documents(k6(spark, sf), path))


# --------------------------------------------------------------------------------- F9, F10, F13, F12

_A_RE = r'<a href="([^"]*)">([^<]*)</a>'


def _msg(template: str, **slots: str) -> str:
    """SQL twin of audit._fmt."""
    out, rest = [], template
    while "{" in rest:
        pre, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        if pre:
            out.append(Q.q(pre))
        out.append(f"coalesce(CAST({slots[name]} AS VARCHAR), 'undefined')")
    if rest:
        out.append(Q.q(rest))
    return " || ".join(out)


def _explode_rules(keep: str, scope: str, rules: list[str], src: str) -> str:
    arr = f"list_filter([{', '.join(rules)}], lambda x: x IS NOT NULL)"
    return f"""SELECT {keep}, '{scope}' AS scope, CAST(pos - 1 AS INTEGER) AS rule_pos, message FROM (
  SELECT {keep}, unnest({arr}) AS message, unnest(range(1, len({arr}) + 1)) AS pos FROM {src})"""


_F9_SRC = f"""(SELECT CAST(page_id * (max(pos) OVER ()) + pos - 1 AS BIGINT) AS idx, name, CASE WHEN starts_with(url, 'http') THEN 'scrape' END AS type, url
  FROM (SELECT page_id, unnest(regexp_extract_all(html, {Q.q(_A_RE)}, 1)) AS url, unnest(regexp_extract_all(html, {Q.q(_A_RE)}, 2)) AS name,
               unnest(range(1, len(regexp_extract_all(html, {Q.q(_A_RE)}, 1)) + 1)) AS pos FROM pages))"""
_F9_RULES = [
    f"CASE WHEN coalesce(url, '') = '' THEN {_msg(audit.MSG_FEED_NO_URL, idx='idx')} END",
    f"CASE WHEN coalesce(url, '') <> '' AND NOT {Q.is_valid_url('url')} THEN {_msg(audit.MSG_FEED_BAD_URL, idx='idx', url='url')} END",
    f"CASE WHEN NOT coalesce(type IN ('rss', 'api', 'scrape', 'json'), false) THEN {_msg(audit.MSG_FEED_BAD_TYPE, name='coalesce(nullif(name, ' + chr(39) * 2 + '), url)')} END",
]


@register("f9_registry_rules", _explode_rules("idx", "Feeds", _F9_RULES, _F9_SRC))
def f9(spark: SparkSession, sf: str) -> DataFrame:
    v = audit.registry_violations(TD.href_registry(spark, sf))
    return v.select("idx", "scope", F.col("rule_pos").cast("int").alias("rule_pos"), "message")


_F10_SRC = """(SELECT CAST(page_id * (max(k) OVER () + 1) + k AS BIGINT) AS idx, type, webhook_url FROM (
  SELECT page_id, 0 AS k, 'webhook' AS type, url AS webhook_url FROM pages
  UNION ALL SELECT page_id, unnest(range(1, len(links) + 1)), 'slack', unnest(links) FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS links FROM pages)
  UNION ALL SELECT page_id, 1 + len(coalesce(regexp_extract_all(html, 'href="([^"]*)"', 1), [])), 'webhook', CAST(NULL AS VARCHAR) FROM pages))"""
_F10_RULES = [
    f"CASE WHEN coalesce(trim(webhook_url), '') = '' THEN {_msg(audit.MSG_CHANNEL_NO_URL, idx='idx', type='type')} END",
    f"CASE WHEN coalesce(trim(webhook_url), '') <> '' AND NOT {Q.is_valid_url('webhook_url')} THEN "
    f"{_msg(audit.MSG_CHANNEL_BAD_URL, idx='idx', type='type', url='webhook_url')} END",
]


@register("f10_channel_rules", _explode_rules("idx", "Delivery", _F10_RULES, _F10_SRC))
def f10(spark: SparkSession, sf: str) -> DataFrame:
    v = audit.channel_violations(TD.channels(spark, sf))
    return v.select("idx", "scope", F.col("rule_pos").cast("int").alias("rule_pos"), "message")


SUBS_SQL = """subs AS (
  SELECT 'sub-' || CAST(user_id AS VARCHAR) AS id, 'user ' || CAST(user_id AS VARCHAR) AS name,
         CASE WHEN count(*) FILTER (WHERE event_type = 'signup') > 0 THEN 'daily' ELSE 'hourly' END AS cron,
         replace(CAST(arg_min(value, (ts, event_id)) AS VARCHAR), '.', ':') AS scheduled_time,
         CASE WHEN arg_max(event_type, (ts, event_id)) = 'error' THEN 0 ELSE 1 END AS active,
         strftime(max(ts) FILTER (WHERE event_type = 'purchase'), '%Y-%m-%dT%H:%M:%S.%gZ') AS last_run,
         max(ts) FILTER (WHERE event_type = 'purchase') AS last_ts
  FROM events GROUP BY user_id
)"""


@register("f13_time_rule", f"""WITH {SUBS_SQL}
{_explode_rules('id', 'Schedule', [f"CASE WHEN scheduled_time IS NOT NULL AND NOT regexp_matches(scheduled_time, {Q.q(audit.TIME_RE)}) THEN {Q.q(audit.MSG_BAD_TIME)} END"], 'subs')}""")
def f13(spark: SparkSession, sf: str) -> DataFrame:
    v = audit.time_violations(TD.subscriptions(spark, sf))
    return v.select("id", "scope", F.col("rule_pos").cast("int").alias("rule_pos"), "message")


_NOW = f"TIMESTAMP '{TD.SUBS_AS_OF}'"


_DUE_SQL = f"""SELECT id, cron, scheduled_time, active, last_run,
  CASE WHEN coalesce(active, 0) = 0 THEN false
       WHEN coalesce(last_run, '') = '' THEN true
       WHEN cron = 'daily' AND coalesce(scheduled_time, '') <> '' THEN
            strftime({_NOW}, '%H:%M') >= scheduled_time AND NOT coalesce(strftime(last_ts, '%Y-%m-%d') = strftime({_NOW}, '%Y-%m-%d'), false)
       ELSE coalesce(CAST(epoch_us({_NOW}) - epoch_us(date_trunc('millisecond', last_ts)) AS DOUBLE) / CAST(3.6e9 AS DOUBLE) >= CAST(24.0 AS DOUBLE), false)
  END AS due
FROM subs"""


@register("f12_due_subscriptions", f"WITH {SUBS_SQL} {_DUE_SQL}")
def f12(spark: SparkSession, sf: str) -> DataFrame:
    d = subscriptions.due(TD.subscriptions(spark, sf), TD.SUBS_AS_OF)
    return d.select("id", "cron", "scheduled_time", "active", "last_run", "due")


_DUE_LANGS_SQL = f"""{SUBS_SQL},
langs AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)),
users AS (SELECT DISTINCT user_id FROM events),
first_user AS (SELECT lang, 'sub-' || CAST(min(user_id) AS VARCHAR) AS id FROM langs JOIN users ON user_id % n = k GROUP BY lang),
own AS (SELECT subs.* REPLACE ('hourly' AS cron, CAST(NULL AS VARCHAR) AS scheduled_time) FROM first_user JOIN subs USING (id)),
lang_subs AS (SELECT * FROM first_user JOIN ({_DUE_SQL.replace("FROM subs", "FROM own")}) USING (id))"""


@register("f12_due_digests", f"""WITH RECURSIVE {CHAIN}, {_DUE_LANGS_SQL}
SELECT * FROM digest_items WHERE lang IN (SELECT lang FROM lang_subs WHERE due)""")
def f12_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Q0 for the languages whose subscription is due."""
    groups = subscriptions.due_groups(TD.language_subscriptions(spark, sf), TD.SUBS_AS_OF, ["lang"])
    return catalog.q0_run(spark, sf, groups=groups).digest_items


@register("f12_after_run", f"""WITH {_DUE_LANGS_SQL}
SELECT lang, id, CASE WHEN due THEN strftime({_NOW}, '%Y-%m-%dT%H:%M:%S.%gZ') ELSE last_run END AS last_run FROM lang_subs""")
def f12_after_run(spark: SparkSession, sf: str) -> DataFrame:
    """The subscriptions after all due digests ran."""
    subs = TD.language_subscriptions(spark, sf)
    done = subscriptions.due_groups(subs, TD.SUBS_AS_OF, ["lang"])
    return subscriptions.record_runs(subs, TD.SUBS_AS_OF, done, ["lang"]).select("lang", "id", "last_run")
