"""Registered queries for the sources (A1-A11): payloads derived from the
test tables are parsed back; the oracle computes the expected items from the
base tables directly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from digestry.plans import sqlgen as Q
from digestry.plans.catalog import register
from digestry.plans.catalog_text import _sql_resolve
from digestry.session import checked_broadcast, checkpoint_dir
from digestry.sources import payloads as P
from digestry.sources import testdata as TD

A = Q.articles_cte()
PI = TD.PAGE_ITEMS


def _trimjs(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _unescape(x: str) -> str:
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, {Q.q(ent)}, {Q.q(ch)})"
    return x


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '<[^>]*>', '', 'g')"


def _feed_id_sql() -> str:
    parts = " ".join(f"WHEN {Q.q(lg)} THEN {Q.q(pre)} || source" for lg, (pre, _) in TD.LANG_FEEDS.items())
    return f"CASE lang {parts} ELSE {Q.q(TD.RSS_PREFIX)} || coalesce(lang, 'none') || '-' || source END"


def _feed_type_sql() -> str:
    parts = " ".join(f"WHEN {Q.q(lg)} THEN {Q.q(typ)}" for lg, (_, typ) in TD.LANG_FEEDS.items())
    return f"CASE lang {parts} ELSE 'rss' END"


REGISTRY_SQL = f"""reg AS (
  SELECT {_feed_id_sql()} AS id, source || ' (' || lang || ')' AS name, {_feed_type_sql()} AS type,
         'https://' || source || '.example/' || lang || '/feed' AS url, 1 AS tier, lang AS tags_text,
         CAST(NULL AS VARCHAR) AS selector, CASE WHEN lang = 'es' THEN {Q.q(TD.JSON_MAPPING['title'])} END AS mapping_title
  FROM (SELECT DISTINCT source, lang FROM documents)
  UNION ALL
  SELECT 'page-' || CAST(page_id AS VARCHAR), url, 'scrape', url, 2, 'web', 'li', 'a' FROM pages
  UNION ALL
  SELECT 'evt-' || event_type, event_type, 'json', 'https://events.example/' || event_type, 3, 'events', NULL, 'k'
  FROM (SELECT DISTINCT event_type FROM events)
  UNION ALL
  SELECT 'api-' || event_type, event_type, 'api', 'https://events.example/api/' || event_type, 3, 'events', NULL, NULL
  FROM (SELECT DISTINCT event_type FROM events)
  UNION ALL SELECT 'hn', 'News API', 'api', 'https://hn.example/api/search', 1, 'news', NULL, NULL
  UNION ALL SELECT 'github_trending', 'Trending', 'scrape', 'https://github.com/trending', 1, 'code', NULL, NULL
)"""

ROUTE_SQL = """routed AS (
  SELECT *, CASE WHEN id = 'hn' THEN 'api' WHEN id = 'github_trending' THEN 'scrape'
                 WHEN starts_with(id, 'arxiv') THEN 'arxiv' WHEN starts_with(id, 'reddit') THEN 'json'
                 WHEN type IN ('rss', 'api', 'scrape', 'json') THEN type END AS parser
  FROM reg
)"""


def _prepared(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return TD.payloads(spark, sf), TD.registry(spark, sf)


def _run_parser(spark: SparkSession, sf: str, parser: str, fn) -> DataFrame:
    pl, reg = _prepared(spark, sf)
    r = P.route(reg).select(F.col("id").alias("source_id"), F.col("url").alias("source_url"), "mapping", "selector", "parser")
    p = pl.join(checked_broadcast(r, P.MAX_BROADCAST_SOURCES), "source_id").where(F.col("parser") == parser).withColumn(
        "source", F.col("source_id"))
    items, _ = fn(p)
    return items


def _item_out(df: DataFrame) -> DataFrame:
    return df.select("source", "page", F.col("item_pos").cast("int").alias("item_pos"), "id", "title", "url",
                     F.md5(F.coalesce("content", F.lit(""))).alias("content_md5"), "published_at")


ITEM_SQL_COLS = "source, CAST(page AS BIGINT) AS page, CAST(item_pos AS INTEGER) AS item_pos, id, title, url, md5(coalesce(content, '')) AS content_md5, published_at"


def _paged(src: str, where: str) -> str:
    return (f"SELECT a.*, {_feed_id_sql()} AS src, CAST(floor(ord / {PI}) AS BIGINT) AS page, "
            f"row_number() OVER (PARTITION BY {_feed_id_sql()}, floor(ord / {PI}) ORDER BY ord) - 1 AS item_pos FROM {src} a WHERE {where}")


_RSS_LANG = "coalesce(lang NOT IN ('fr', 'de', 'es'), true)"
_TRENDING_PAGE = f"conv_id * (SELECT floor(max(turn) / {PI}) + 1 FROM conversations) + floor(turn / {PI})"


# --------------------------------------------------------------------------------- A1, A2


@register("a01_registry_scan", f"WITH {REGISTRY_SQL} SELECT * FROM reg")
def a01(spark: SparkSession, sf: str) -> DataFrame:
    """The registry is written as JSON lines under the checkpoint folder and read back (A1)."""
    import uuid

    path = f"{checkpoint_dir(spark).rstrip('/')}/registry-{uuid.uuid4().hex}"
    TD.registry(spark, sf).write.json(path)
    reg = P.read_registry(spark, path, multiline=False)
    return reg.select("id", "name", "type", "url", "tier", F.array_join("tags", ",").alias("tags_text"), "selector",
                      F.col("mapping")["title"].alias("mapping_title"))


@register("a02_parser_routing", f"WITH {REGISTRY_SQL}, {ROUTE_SQL} SELECT id, type, parser FROM routed")
def a02(spark: SparkSession, sf: str) -> DataFrame:
    return P.route(TD.registry(spark, sf)).select("id", "type", "parser")


# --------------------------------------------------------------------------------- A3-A7

RSS_ITEMS = f"""rss_x AS ({_paged('articles', _RSS_LANG)}),
rss_items AS (
  SELECT src AS source, page, item_pos, url AS id, coalesce(nullif({_trimjs('title')}, ''), 'No Title') AS title, url,
         coalesce(nullif({_trimjs(_unescape(_strip(_trimjs('content'))))}, ''), {_trimjs('content')}) AS content, published_at
  FROM rss_x)"""
_A3 = f"WITH {A}, {RSS_ITEMS} SELECT {ITEM_SQL_COLS} FROM rss_items"


@register("a03_rss_extract", _A3)
def a03(spark: SparkSession, sf: str) -> DataFrame:
    return _item_out(_run_parser(spark, sf, "rss", P.parse_rss))


ATOM_ITEMS = f"""atom_x AS ({_paged('articles', "lang = 'fr'")}),
atom_items AS (
  SELECT src AS source, page, item_pos, url AS id, {Q.collapse_ws('title')} AS title, url, {Q.collapse_ws('content')} AS content,
         published_at FROM atom_x)"""


@register("a04_atom_extract", f"WITH {A}, {ATOM_ITEMS} SELECT {ITEM_SQL_COLS} FROM atom_items")
def a04(spark: SparkSession, sf: str) -> DataFrame:
    return _item_out(_run_parser(spark, sf, "arxiv", P.parse_atom))


HN_ITEMS = f"""hn_items AS (
  SELECT 'hn' AS source, floor(item_id / {PI}) AS page,
         row_number() OVER (PARTITION BY floor(item_id / {PI}) ORDER BY item_id) - 1 AS item_pos,
         CAST(item_id AS VARCHAR) AS id, split_part(text, '.', 1) AS title,
         '{P.NEWS_API_ITEM_URL}' || CAST(item_id AS VARCHAR) AS url, coalesce(nullif(text, ''), '') AS content,
         strftime(TIMESTAMP '{TD.EPOCH_START}' + to_hours(CAST(item_id AS INTEGER)), '%Y-%m-%dT%H:%M:%S.%gZ') AS published_at
  FROM benchmark)"""


@register("a05_news_api_extract", f"WITH {HN_ITEMS} SELECT {ITEM_SQL_COLS} FROM hn_items")
def a05(spark: SparkSession, sf: str) -> DataFrame:
    return _item_out(_run_parser(spark, sf, "api", P.parse_news_api))


_NOW_ISO = f"strftime(TIMESTAMP '{TD.AS_OF}', '%Y-%m-%dT%H:%M:%S.%gZ')"


JSON_ITEMS = f"""es AS ({_paged('articles', "lang = 'es'")}),
de AS ({_paged('articles', "lang = 'de'")}),
json_items AS (
  SELECT src AS source, page, item_pos, 'json-' || src || '-' || CAST(item_pos AS VARCHAR) AS id,
         coalesce(nullif(title, ''), 'No Title') AS title,
         coalesce(nullif(url, ''), 'https://' || source || '.example/es/feed') AS url,
         coalesce(nullif(content, ''), '') AS content, coalesce(nullif(published_at, ''), {_NOW_ISO}) AS published_at
  FROM es
  UNION ALL
  SELECT src, page, item_pos, 't3_' || id, title, '{P.REDDIT_HOST}/r/' || source || '/comments/' || id,
         coalesce(nullif(content, ''), ''), published_at
  FROM de
  UNION ALL
  SELECT 'evt-' || event_type, floor(event_id / {PI}),
         row_number() OVER (PARTITION BY event_type, floor(event_id / {PI}) ORDER BY event_id) - 1,
         'json-evt-' || event_type || '-' || CAST(row_number() OVER (PARTITION BY event_type, floor(event_id / {PI}) ORDER BY event_id) - 1 AS VARCHAR),
         coalesce(nullif(json_extract_string(props, '$.k'), ''), 'No Title'),
         'https://events.example/' || event_type, '', {_NOW_ISO}
  FROM events)"""


@register("a06_a07_json_extract", f"WITH {A}, {JSON_ITEMS} SELECT {ITEM_SQL_COLS} FROM json_items")
def a06(spark: SparkSession, sf: str) -> DataFrame:
    return _item_out(_run_parser(spark, sf, "json", lambda d: P.parse_json(d, TD.AS_OF)))


# --------------------------------------------------------------------------------- A8, A9

_LI = r"<li>(.*?)</li>"
_HREF = r'<a[^>]*href="([^"]*)"'
_A_TEXT = r"<a[^>]*>(.*?)</a>"

NAV_ITEMS = f"""nav_b AS (
  SELECT 'page-' || CAST(page_id AS VARCHAR) AS source, 0 AS page, url AS base,
         unnest(regexp_extract_all(html, {Q.q(_LI)}, 1)) AS block,
         unnest(range(0, len(regexp_extract_all(html, {Q.q(_LI)}, 1)))) AS item_pos FROM pages
), nav_x AS (
  SELECT source, page, item_pos, {_sql_resolve(f"nullif(regexp_extract(block, {Q.q(_HREF)}, 1), '')", 'base')} AS url,
         coalesce(nullif({_trimjs(_unescape(_strip(f"regexp_extract(block, {Q.q(_A_TEXT)}, 1)")))}, ''), 'No Title') AS title
  FROM nav_b
), nav_items AS (SELECT source, page, item_pos, url AS id, title, url, '' AS content, CAST(NULL AS VARCHAR) AS published_at FROM nav_x)"""


@register("a08_html_blocks", f"WITH {NAV_ITEMS} SELECT {ITEM_SQL_COLS} FROM nav_items")
def a08(spark: SparkSession, sf: str) -> DataFrame:
    def selected(d):
        return P.parse_html_selected(d.where(F.col("selector").isNotNull()))

    return _item_out(_run_parser(spark, sf, "scrape", selected).where(F.col("source") != "github_trending"))


#: How the nested listings below are read.
LISTINGS = {
    "child": ("div.list > div.post", {"title": ".head h2 > a", "url": "a[rel=bookmark]", "content": ".body .para, p.note"}),
    "any": ("div.list .post", {"title": "h2", "url": ".head a ~ a, .quote a", "content": "div.body div"}),
}


def _nested_listing(articles: DataFrame) -> DataFrame:
    """One page per 20 articles: posts in posts, blocks of one tag name in each other, a post outside the list."""
    t, c = (TD.xml_escape(F.coalesce(x, F.lit(""))) for x in ("title", "content"))
    i = F.col("ord").cast("string")
    post = F.concat(
        F.lit('<div class="wide post" id="d'), i, F.lit('"><div class="head"><!-- <h2>no</h2> --><h2><b></b><a href="/x/'), i, F.lit('" rel=bookmark>'), t,
        F.lit('</a></h2><a href=first>1</a><a href="../y?n='), i, F.lit('">2</a></div><div class="body"><div class="para">one '),
        F.lit('<div>in</div></div><p>o<div class="para">'), c,
        F.lit('</div></div><p class="note">n<div class="post quote"><h2>q'), i, F.lit('</h2><a href="https://q.example/'), i, F.lit('">q</a><div class=body><div>Q</div></div></div></div>'))
    body = TD._pages_of(articles.withColumn("_page", F.floor(F.col("ord") / PI)), ["_page"], "ord", post,
                        TD._framed('<html><body><div class="post"><h2>outside</h2></div><div class="list"><script>"<div class=post>"</script>', "</div></body></html>"))
    of = [F.struct(F.lit(name).alias("source"), F.lit(selector).alias("selector"), F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]).alias("mapping"))
          for name, (selector, mapping) in LISTINGS.items()]
    return body.select(F.explode(F.array(*of)).alias("s"), F.col("_page").cast("bigint").alias("page"), "payload").select(
        "s.*", "page", F.lit("https://list.example/a/b/").alias("source_url"), "payload")


_POST_NO = f"row_number() OVER (PARTITION BY floor(ord / {PI}) ORDER BY ord) - 1"


@register("a08_nested_selectors", f"""WITH {A},
posts AS (SELECT CAST(floor(ord / {PI}) AS BIGINT) AS page, {_POST_NO} AS n, CAST(ord AS VARCHAR) AS i, title, coalesce(content, '') AS content FROM articles),
items AS (
  SELECT 'child' AS source, page, n AS item_pos, 'https://list.example/x/' || i AS id, {_trimjs('title')} AS title, {_trimjs("'one in' || content || 'n'")} AS content FROM posts
  UNION ALL
  SELECT 'any', page, 2 * n, 'https://list.example/a/y?n=' || i, {_trimjs("title || 'q' || i")}, {_trimjs("'one inin' || content || 'Q'")} FROM posts
  UNION ALL
  SELECT 'any', page, 2 * n + 1, 'https://q.example/' || i, 'q' || i, 'Q' FROM posts)
SELECT source, page, CAST(item_pos AS INTEGER) AS item_pos, id, coalesce(nullif(title, ''), 'No Title') AS title, id AS url, md5(content) AS content_md5, CAST(NULL AS VARCHAR) AS published_at FROM items""")
def a08_nested(spark: SparkSession, sf: str) -> DataFrame:
    return _item_out(P.parse_html_selected(_nested_listing(TD.articles(spark, sf)))[0])


def _xml_escape_sql(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


TRENDING_ITEMS = f"""trending_items AS (
  SELECT 'github_trending' AS source, {_TRENDING_PAGE} AS page,
         row_number() OVER (PARTITION BY conv_id, floor(turn / {PI}) ORDER BY turn) - 1 AS item_pos,
         '{P.TRENDING_HOST}/' || role || '/c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id,
         role || ' / c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS title,
         '{P.TRENDING_HOST}/' || role || '/c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS url,
         {_trimjs(_unescape(_strip(_xml_escape_sql('text'))))} AS content, CAST(NULL AS VARCHAR) AS published_at
  FROM conversations)"""


@register("a09_trending_blocks", f"WITH {TRENDING_ITEMS} SELECT {ITEM_SQL_COLS} FROM trending_items")
def a09(spark: SparkSession, sf: str) -> DataFrame:
    def trending(d):
        return P.parse_html_blocks(d.where(F.col("source") == "github_trending"), **P.TRENDING_PRESET)

    return _item_out(_run_parser(spark, sf, "scrape", trending))


# --------------------------------------------------------------------------------- A10, A11


@register("a10_fan_out_counts", f"""WITH {REGISTRY_SQL}, {ROUTE_SQL},
ords AS (SELECT id, dense_rank() OVER (ORDER BY id) AS source_ord FROM reg),
docs AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
per_parser AS (
  SELECT 'rss' AS parser, (SELECT sum(n) FROM docs WHERE {_RSS_LANG}) AS n UNION ALL SELECT 'arxiv', n FROM docs WHERE lang = 'fr'
  UNION ALL SELECT 'json', (SELECT sum(n) FROM docs WHERE lang IN ('de', 'es')) + (SELECT count(*) FROM events)
  UNION ALL SELECT 'api', (SELECT count(*) FROM benchmark)
  UNION ALL SELECT 'scrape', (SELECT count(*) FROM conversations) + (SELECT sum(len(regexp_extract_all(html, {Q.q(_LI)}, 1))) FROM pages)
)
SELECT parser, CAST(n AS BIGINT) AS items, (SELECT max(source_ord) FROM ords) AS n_sources FROM per_parser""")
def a10(spark: SparkSession, sf: str) -> DataFrame:
    reg = TD.registry(spark, sf)
    items, _ = P.fan_out(TD.raw_payloads(spark, sf), reg, TD.AS_OF)
    routed = P.route(reg).select(F.col("id").alias("source"), "parser")
    n_sources = reg.select("id").distinct().count()
    return items.join(routed, "source").groupBy("parser").agg(F.count("*").alias("items")).withColumn(
        "n_sources", F.lit(n_sources).cast("bigint"))


@register("a11_envelopes", f"""
WITH api AS (SELECT DISTINCT 'api-' || event_type AS source, CAST(floor(event_id / {PI}) AS BIGINT) AS page FROM events)
SELECT 'error' AS status, '{P.MSG_UNSUPPORTED_API}' AS error, count(*) AS payloads, CAST(0 AS BIGINT) AS items FROM api""")
def a11(spark: SparkSession, sf: str) -> DataFrame:
    _, env = P.fan_out(TD.raw_payloads(spark, sf), TD.registry(spark, sf), TD.AS_OF)
    return env.where(F.col("status") == "error").groupBy("status", "error").agg(
        F.count("*").alias("payloads"), F.sum("items_found").cast("bigint").alias("items"))


ALL_ITEMS = f"""{A}, {RSS_ITEMS}, {ATOM_ITEMS}, {HN_ITEMS}, {JSON_ITEMS}, {NAV_ITEMS}, {TRENDING_ITEMS},
all_items AS (
  SELECT * FROM rss_items UNION ALL SELECT * FROM atom_items UNION ALL SELECT * FROM hn_items
  UNION ALL SELECT * FROM json_items UNION ALL SELECT * FROM nav_items UNION ALL SELECT * FROM trending_items
)"""
