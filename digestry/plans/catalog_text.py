"""Registered queries for the scalar functions (S1-S23) over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from digestry.functions import dates as D
from digestry.functions import scores as SC
from digestry.functions import text as T
from digestry.functions import urls as U
from digestry.operators import keywords
from digestry.plans import sqlgen as Q
from digestry.plans.catalog import register
from digestry.sources import testdata as TD

A = Q.articles_cte()

# --------------------------------------------------------------------------------- S1, S2, S3


@register("s01_falsy_fallback", f"""
WITH {A}
SELECT id, md5(coalesce(nullif(content, ''), '[headline] ' || title)) AS body_md5,
       coalesce(nullif(content, ''), '[headline] ' || title) = '[headline] ' || title AS fell_through
FROM articles""")
def s01(spark: SparkSession, sf: str) -> DataFrame:
    a = TD.articles(spark, sf)
    body = T.falsy_or("content", F.concat(F.lit("[headline] "), F.col("title")))
    return a.select("id", F.md5(body).alias("body_md5"), (body == F.concat(F.lit("[headline] "), F.col("title"))).alias("fell_through"))


@register("s02_scoring_text", f"""
WITH {A}
SELECT id, md5({Q.scoring_text()}) AS text_md5, CAST(length({Q.scoring_text()}) AS INTEGER) AS text_len FROM articles""")
def s02(spark: SparkSession, sf: str) -> DataFrame:
    a = TD.articles(spark, sf)
    t = T.scoring_text()
    return a.select("id", F.md5(t).alias("text_md5"), F.length(t).alias("text_len"))


_S03_KW = ["nicht", "attion", "ment", "ñ"]


@register("s03_substring_flags", f"""
WITH {A}
SELECT id, {", ".join(f"contains({Q.scoring_text()}, {Q.q(k)}) AS has_{i}" for i, k in enumerate(_S03_KW))} FROM articles""")
def s03(spark: SparkSession, sf: str) -> DataFrame:
    a = TD.articles(spark, sf).withColumn("_t", T.scoring_text())
    return a.select("id", *[T.contains_ci("_t", k).alias(f"has_{i}") for i, k in enumerate(_S03_KW)])


# --------------------------------------------------------------------------------- S4, S5 (M2 in catalog_rank)


@register("s05_score_blend", f"""
WITH {A},
l1 AS (SELECT id, {Q.layer1(Q.inline_score(Q.scoring_text(), TD.SIGNAL_KEYWORDS), Q.inline_score(Q.scoring_text(), TD.NEGATIVE_KEYWORDS))} AS layer1 FROM articles),
ms AS (SELECT CAST(doc_id AS VARCHAR) AS id, CAST(CASE WHEN toxic = 0 THEN quality * {TD.MODEL_SCORE_PER_QUALITY} ELSE 0 END AS DOUBLE) AS model_score FROM labels)
SELECT l1.id, l1.layer1, ms.model_score, {Q.blend('l1.layer1', 'ms.model_score')} AS final_score
FROM l1 LEFT JOIN ms ON l1.id = ms.id""")
def s05(spark: SparkSession, sf: str) -> DataFrame:
    a = keywords.layer1_scores(TD.articles(spark, sf), TD.SIGNAL_KEYWORDS, TD.NEGATIVE_KEYWORDS)
    j = a.select("id", "layer1").join(TD.model_scores(spark, sf), "id", "left")
    return j.select("id", "layer1", "model_score", SC.blend("layer1", "model_score").alias("final_score"))


# --------------------------------------------------------------------------------- S6, S7


@register("s06_url_key", f"""
SELECT page_id, url, {Q.canonical_url('url')} AS url_key FROM pages""")
def s06(spark: SparkSession, sf: str) -> DataFrame:
    p = TD.table(spark, sf, "pages")
    return p.select("page_id", "url", U.canonical_url(F.col("url")).alias("url_key"))


_HREF_RE = r'href="([^"]*)"'


def _sql_resolve(h: str, b: str) -> str:
    origin = f"regexp_extract({b}, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1)"
    bdir = f"regexp_extract({b}, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^?#]*/)', 1)"
    bdir = f"(CASE WHEN {bdir} = '' THEN {origin} || '/' ELSE {bdir} END)"
    return (f"(CASE WHEN coalesce({h}, '') = '' THEN {b} WHEN starts_with({h}, 'http') OR regexp_matches({h}, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN {h} "
            f"WHEN starts_with({h}, '//') THEN regexp_extract({b}, '^([A-Za-z][A-Za-z0-9+.\\-]*:)', 1) || {h} "
            f"WHEN starts_with({h}, '/') THEN {origin} || {h} "
            f"WHEN starts_with({h}, '?') OR starts_with({h}, '#') THEN regexp_replace({b}, '[?#].*$', '') || {h} "
            f"ELSE {bdir} || {h} END)")


@register("s07_resolve_href", f"""
WITH h AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, {Q.q(_HREF_RE)}, 1)) AS href,
         unnest(range(1, len(regexp_extract_all(html, {Q.q(_HREF_RE)}, 1)) + 1)) AS pos FROM pages
)
SELECT page_id, CAST(pos AS INTEGER) AS pos, href, {_sql_resolve('href', 'url')} AS resolved FROM h""")
def s07(spark: SparkSession, sf: str) -> DataFrame:
    p = TD.table(spark, sf, "pages")
    ex = p.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(_HREF_RE), 1)).alias("pos", "href"))
    return ex.select("page_id", (F.col("pos") + 1).cast("int").alias("pos"), "href", U.resolve_url("href", "url").alias("resolved"))


# --------------------------------------------------------------------------------- S8-S12


@register("s08_s10_title_keys", f"""
WITH {A},
k AS (SELECT id, title, {Q.norm_title('title')} AS norm FROM articles)
SELECT id, norm AS norm_title, {Q.fingerprint('title')} AS fingerprint, CAST(len({Q.bigrams('norm')}) AS INTEGER) AS n_bigrams FROM k""")
def s08(spark: SparkSession, sf: str) -> DataFrame:
    a = TD.articles(spark, sf).withColumn("norm_title", T.normalize_title("title"))
    return a.select("id", "norm_title", T.fingerprint("title").alias("fingerprint"),
                    F.size(T.bigrams("norm_title")).alias("n_bigrams"))


def _second_sentence_sql() -> str:
    return "split_part(text, '.', 2)"


@register("s11_dice_title_vs_second_sentence", f"""
WITH d AS (SELECT doc_id, {Q.norm_title("split_part(text, '.', 1)")} AS a, {Q.norm_title(_second_sentence_sql())} AS b FROM documents)
SELECT doc_id, {Q.dice('a', 'b', Q.bigrams('a'), Q.bigrams('b'))} AS dice FROM d""")
def s11(spark: SparkSession, sf: str) -> DataFrame:
    d = TD.table(spark, sf, "documents").select(
        "doc_id", T.normalize_title(TD.doc_title(F.col("text"))).alias("a"),
        T.normalize_title(F.split_part(F.col("text"), F.lit("."), F.lit(2))).alias("b"))
    return d.select("doc_id", T.dice("a", "b", T.bigrams("a"), T.bigrams("b")).alias("dice"))


@register("s12_collapse_whitespace", f"""
SELECT doc_id, md5({Q.collapse_ws('text')}) AS text_md5, CAST(length({Q.collapse_ws('text')}) AS INTEGER) AS n FROM documents""")
def s12(spark: SparkSession, sf: str) -> DataFrame:
    d = TD.table(spark, sf, "documents")
    c = T.collapse_ws("text")
    return d.select("doc_id", F.md5(c).alias("text_md5"), F.length(c).alias("n"))


# --------------------------------------------------------------------------------- S13, S14, S21, S22


@register("s13_epoch_to_iso", """
SELECT event_id, strftime(epoch_ms(CAST(floor(CAST(epoch_us(ts) AS DOUBLE) / CAST(1e6 AS DOUBLE) * CAST(1000.0 AS DOUBLE)) AS BIGINT)), '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM events""")
def s13(spark: SparkSession, sf: str) -> DataFrame:
    ev = TD.table(spark, sf, "events")
    secs = F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / F.lit(1e6).cast("double")
    return ev.select("event_id", D.epoch_seconds_to_iso(secs).alias("iso"))


def _s14_text():
    return (
    F.when(F.col("event_type") == "view", F.concat(F.date_format(F.col("ts"), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
    .when(F.col("event_type") == "click", F.concat(F.date_format(F.col("ts") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
    .when(F.col("event_type") == "error", F.lit("n/a"))
    .otherwise(F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    )


@register("s14_parse_instant", """
SELECT event_id,
  CASE event_type WHEN 'view' THEN strftime(ts, '%a, %d %b %Y %H:%M:%S') || ' GMT'
                  WHEN 'click' THEN strftime(ts + INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S') || '+02:00'
                  WHEN 'error' THEN 'n/a'
                  ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') END AS txt,
  CASE event_type WHEN 'error' THEN NULL
                  WHEN 'purchase' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ')
                  WHEN 'signup' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ')
                  ELSE strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S.%gZ') END AS iso
FROM events""")
def s14(spark: SparkSession, sf: str) -> DataFrame:
    ev = TD.table(spark, sf, "events").withColumn("txt", _s14_text())
    return ev.select("event_id", "txt", D.to_iso(D.parse_instant("txt")).alias("iso"))


_S21_AS_OF = "2024-02-01 00:00:00"


@register("s21_elapsed", f"""
SELECT event_id,
  CAST(epoch_us(TIMESTAMP '{_S21_AS_OF}') - epoch_us(ts) AS DOUBLE) / CAST(6.0e7 AS DOUBLE) AS minutes,
  CAST(epoch_us(TIMESTAMP '{_S21_AS_OF}') - epoch_us(ts) AS DOUBLE) / CAST(3.6e9 AS DOUBLE) AS hours
FROM events""")
def s21(spark: SparkSession, sf: str) -> DataFrame:
    ev = TD.table(spark, sf, "events").withColumn("_t", F.col("ts").cast("timestamp"))
    now = D.as_of_literal(_S21_AS_OF)
    return ev.select("event_id", D.minutes_between(now, "_t").alias("minutes"), D.hours_between(now, "_t").alias("hours"))


@register("s22_cutoff", f"""
SELECT event_type,
  count(*) FILTER (WHERE ts > TIMESTAMP '{_S21_AS_OF}' - INTERVAL 168 HOUR) AS after_cutoff,
  count(*) FILTER (WHERE CAST(ts AS DATE) > CAST(TIMESTAMP '{_S21_AS_OF}' - INTERVAL 168 HOUR AS DATE)) AS after_cutoff_date,
  min(strftime(TIMESTAMP '{_S21_AS_OF}' - INTERVAL 168 HOUR, '%Y-%m-%dT%H:%M:%S.%gZ')) AS cutoff_iso
FROM events GROUP BY event_type""")
def s22(spark: SparkSession, sf: str) -> DataFrame:
    ev = TD.table(spark, sf, "events").withColumn("_t", F.col("ts").cast("timestamp"))
    cut = D.cutoff_instant(_S21_AS_OF, 168)
    return ev.groupBy("event_type").agg(
        F.count_if(F.col("_t") > cut).alias("after_cutoff"),
        F.count_if(F.to_date("_t") > F.to_date(cut)).alias("after_cutoff_date"),
        F.min(D.to_iso(cut)).alias("cutoff_iso"),
    )


# --------------------------------------------------------------------------------- S16, S17, S18, S19


@register("s16_keyword_matches", f"""
WITH {A}
SELECT id, array_to_string({Q.keyword_matches(list(TD.SIGNAL_KEYWORDS))}, ',') AS matches FROM articles""")
def s16(spark: SparkSession, sf: str) -> DataFrame:
    a = TD.articles(spark, sf)
    return a.select("id", F.array_join(T.keyword_matches(list(TD.SIGNAL_KEYWORDS)), ",").alias("matches"))


@register("s17_heuristic_category", f"""
WITH {A}
SELECT id, {Q.heuristic_category('title')} AS category FROM articles""")
def s17(spark: SparkSession, sf: str) -> DataFrame:
    return TD.articles(spark, sf).select("id", T.heuristic_category("title").alias("category"))


def _response_text_spark():
    t = TD.doc_title(F.col("text"))
    return (
        F.when(F.col("lang") == "en", F.concat(F.lit("**Summary:** "), t, F.lit("\n**Category:** "), F.col("source"), F.lit(".")))
        .when(F.col("lang") == "de", F.concat(F.lit("category: *"), F.col("source"), F.lit("*")))
        .when(F.col("lang") == "fr", F.concat(F.lit("SUMMARY "), t))
        .otherwise(F.concat(F.lit("no labels here: "), t))
    )


_RESP_SQL = """CASE lang WHEN 'en' THEN '**Summary:** ' || split_part(text, '.', 1) || chr(10) || '**Category:** ' || source || '.'
                 WHEN 'de' THEN 'category: *' || source || '*'
                 WHEN 'fr' THEN 'SUMMARY ' || split_part(text, '.', 1)
                 ELSE 'no labels here: ' || split_part(text, '.', 1) END"""


def _labelled_sql(label: str) -> str:
    fill = "chr(42) || ': ' || chr(9) || chr(13) || chr(10)"
    return f"nullif(trim(split_part(ltrim(regexp_extract(resp, '{label}(.*)', 1, 'is'), {fill}), chr(10), 1)), '')"


@register("s18_recover_fields", f"""
WITH r AS (SELECT doc_id, {_RESP_SQL} AS resp FROM documents),
m AS (SELECT doc_id, {_labelled_sql('summary')} AS s, {_labelled_sql('category')} AS c FROM r)
SELECT doc_id, s AS summary,
  CASE WHEN s IS NOT NULL OR c IS NOT NULL THEN coalesce(trim(replace(replace(c, '.', ''), '*', '')), 'Uncategorized') END AS category
FROM m""")
def s18(spark: SparkSession, sf: str) -> DataFrame:
    d = TD.table(spark, sf, "documents").withColumn("resp", _response_text_spark())
    rec = T.recover_analysis("resp")
    return d.select("doc_id", rec["summary"].alias("summary"), rec["category"].alias("category"))


@register("s19_digest_line", f"""
WITH {A},
lab AS (SELECT CAST(doc_id AS VARCHAR) AS id, quality, toxic FROM labels),
s AS (SELECT a.id, a.title, a.url, a.source, {Q.heuristic_category('a.title')} AS category,
             CAST(CASE WHEN toxic = 0 THEN {TD.STORED_SCORE_CLEAN} ELSE {TD.STORED_SCORE_TOXIC} END AS BIGINT) AS score,
             CASE WHEN quality = 1 THEN 'quality=1' END AS summary
      FROM articles a JOIN lab ON a.id = lab.id)
SELECT id, '*<' || url || '|' || title || '>*' || chr(10) || '_' || category || '_ • ' || source || ' • Score: ' || CAST(score AS VARCHAR)
       || chr(10) || coalesce(nullif(summary, ''), {Q.q(T.NO_SUMMARY)}) AS line FROM s""")
def s19(spark: SparkSession, sf: str) -> DataFrame:
    st = TD.stored_articles(spark, sf).withColumn(
        "summary", F.when(F.col("summary").startswith("quality=1"), F.lit("quality=1")))
    return st.select("id", T.digest_line().alias("line"))
