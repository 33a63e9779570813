"""Registered queries for dedup, keywords, ranking and the model layer
(D1-D5, J2, J5, J6, M2, M6, M8, U2, U3, T1-T3, W3, W4, F3-F5, S4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from digestry.functions import text as T
from digestry.operators import dedup, keywords, minhash, model, moving_leaders, rank
from digestry.plans import catalog
from digestry.plans import sql_q0 as Z
from digestry.plans import sqlgen as Q
from digestry.plans.catalog import register
from digestry.sources import testdata as TD

A = Q.articles_cte()
CHAIN = Z.chain()

# --------------------------------------------------------------------------------- D1, D2, M8


@register("d1_url_dedup", f"""
WITH {A},
{Q.survivor_cte('d1', 'articles', ['lang'], Q.canonical_url('url'), 'url_key')}
SELECT lang, id, ord, url, title, coalesce(content, '') = '' AS no_content FROM d1""")
def d1(spark: SparkSession, sf: str) -> DataFrame:
    out = dedup.dedup_url(dedup.narrow(TD.articles(spark, sf)), ["lang"], content="_empty")
    return out.select("lang", "id", "ord", "url", "title", F.col("_empty").alias("no_content"))


@register("d2_fingerprint_dedup", f"""
WITH {A},
{Q.survivor_cte('d1', 'articles', ['lang'], Q.canonical_url('url'), 'url_key')},
{Q.survivor_cte('d2', 'd1', ['lang'], Q.fingerprint('title'), 'fp_key')}
SELECT lang, id, ord, title, coalesce(content, '') = '' AS no_content FROM d2""")
def d2(spark: SparkSession, sf: str) -> DataFrame:
    out = dedup.exact_dedup(dedup.narrow(TD.articles(spark, sf)), ["lang"], content="_empty")
    return out.select("lang", "id", "ord", "title", F.col("_empty").alias("no_content"))


# --------------------------------------------------------------------------------- M2/S4, U3, J5


@register("m2_keyword_score", f"""
WITH {A}
SELECT id, positive, negative, {Q.layer1('positive', 'negative')} AS layer1 FROM (
  SELECT id, {Q.inline_score(Q.scoring_text(), TD.SIGNAL_KEYWORDS)} AS positive,
             {Q.inline_score(Q.scoring_text(), TD.NEGATIVE_KEYWORDS)} AS negative FROM articles)""")
def m2(spark: SparkSession, sf: str) -> DataFrame:
    out = keywords.layer1_scores(TD.articles(spark, sf), TD.SIGNAL_KEYWORDS, TD.NEGATIVE_KEYWORDS)
    return out.select("id", "positive", "negative", "layer1")


def _overlaid() -> dict:
    merged = dict(TD.SIGNAL_KEYWORDS)
    merged.update(TD.CUSTOM_KEYWORDS)
    return merged


@register("u3_dictionary_overlay", f"""
WITH {A}
SELECT id, {Q.inline_score(Q.scoring_text(), _overlaid())} AS positive FROM articles""")
def u3(spark: SparkSession, sf: str) -> DataFrame:
    base = TD.keyword_table(spark, TD.SIGNAL_KEYWORDS)
    custom = TD.keyword_table(spark, TD.CUSTOM_KEYWORDS)
    merged = keywords.overlay(base, custom)
    arts = TD.articles(spark, sf).withColumn("_t", T.scoring_text())
    items = keywords._as_items(merged, 512)
    return arts.select("id", keywords.inline_score("_t", items).alias("positive"))


@register("j5_keyword_hits", f"""
WITH {A}
SELECT keyword, count(*) AS n_docs, sum(weight) AS weight_sum FROM (
  SELECT unnest({Q.keyword_matches(list(TD.SIGNAL_KEYWORDS))}) AS keyword FROM articles) h
JOIN (VALUES {", ".join(f"({Q.q(k)}, {Q.dbl(w)})" for k, w in TD.SIGNAL_KEYWORDS.items())}) AS d(kw, weight) ON h.keyword = d.kw
GROUP BY keyword""")
def j5(spark: SparkSession, sf: str) -> DataFrame:
    hits = keywords.keyword_hits(TD.articles(spark, sf), TD.SIGNAL_KEYWORDS, ["id"])
    return hits.groupBy("keyword").agg(F.count("*").alias("n_docs"), F.sum("weight").alias("weight_sum"))


# --------------------------------------------------------------------------------- Q0 chain pieces


def _run(spark, sf, finish=False):
    return catalog.q0_run(spark, sf, finish)


@register("m6_new_item_counts", f"WITH RECURSIVE {CHAIN} SELECT lang, total_new_items FROM counts")
def m6(spark: SparkSession, sf: str) -> DataFrame:
    from digestry.operators import digest

    return digest.new_item_counts(_run(spark, sf).new_items, ["lang"])


@register("t1_prune_top150", f"WITH RECURSIVE {CHAIN} SELECT lang, CAST(l1_rank AS INTEGER) AS l1_rank, id, ord, layer1 FROM t1")
def t1(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf).pruned.select("lang", "l1_rank", "id", "ord", "layer1")


@register("d3a_fuzzy_greedy", f"WITH RECURSIVE {CHAIN} SELECT lang, rank, id, ord, title FROM d3rows")
def d3a(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf).fuzzy.select("lang", "rank", "id", "ord", "title")


@register("f5_topic_coverage", f"WITH RECURSIVE {CHAIN} SELECT lang, CAST(cov_rank AS INTEGER) AS cov_rank, rank, id FROM cov")
def f5(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf).candidates.select("lang", "cov_rank", "rank", "id")


@register("w4_batches", f"""WITH RECURSIVE {CHAIN}
SELECT lang, id, CAST(floor((ask_rank - 1) / 10) AS INTEGER) AS batch, CAST((ask_rank - 1) % 10 AS INTEGER) AS batch_pos FROM asked""")
def w4(spark: SparkSession, sf: str) -> DataFrame:
    b = rank.batch_numbers(model.to_model(_run(spark, sf).candidates), 10, "cov_rank", ["lang"])
    return b.select("lang", "id", "batch", "batch_pos")


@register("j2_s05_model_blend", f"WITH RECURSIVE {CHAIN} SELECT lang, id, layer1, layer2, final_score FROM blended")
def j2(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf).blended.select("lang", "id", "layer1", "layer2", "final_score")


@register("f4_negative_split", f"""WITH RECURSIVE {CHAIN}
SELECT lang, count(*) FILTER (WHERE negative = 0) AS needs_model, count(*) FILTER (WHERE negative > 0) AS pre_zeroed FROM cov GROUP BY lang""")
def f4(spark: SparkSession, sf: str) -> DataFrame:
    c = model.negative_split(_run(spark, sf).candidates)
    return c.groupBy("lang").agg(F.count_if("needs_model").alias("needs_model"), F.count_if(~F.col("needs_model")).alias("pre_zeroed"))


@register("t3_select_top", f"""WITH RECURSIVE {CHAIN}
SELECT lang, CAST(sel_rank AS INTEGER) AS sel_rank, id, final_score, summary, category FROM enriched""")
def t3(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf).selected.select("lang", "sel_rank", "id", "final_score", "summary", "category")


@register("k1_upsert", f"""WITH RECURSIVE {CHAIN}
SELECT id, title, url, source, md5(coalesce(content, '')) AS content_md5, summary, category, published_at, score, digest_date, delivered, lang
FROM stored_next""")
def k1(spark: SparkSession, sf: str) -> DataFrame:
    s = _run(spark, sf, True).stored
    return s.select("id", "title", "url", "source", F.md5(F.coalesce("content", F.lit(""))).alias("content_md5"),
                    "summary", "category", "published_at", "score", "digest_date", "delivered", "lang")


@register("f6_u2_pending_union", f"""WITH RECURSIVE {CHAIN}
SELECT lang, CAST(pos AS INTEGER) AS pos, id, title, score FROM items""")
def f6(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf, True).delivered_items.select("lang", "pos", "id", "title", "score")


@register("d5_keyed_last_wins", f"""WITH {A},
e AS (SELECT id, title, ord FROM articles), l AS (SELECT id, 'labelled: ' || title AS title, ord + 1 AS ord FROM articles JOIN labels ON id = CAST(doc_id AS VARCHAR))
SELECT e.id, coalesce(l.title, e.title) AS title, e.ord AS pos FROM e LEFT JOIN l USING (id)""")
def d5(spark: SparkSession, sf: str) -> DataFrame:
    """A later row replaces the values of an earlier one with its id and keeps its position."""
    arts = TD.articles(spark, sf).select("id", "title", F.col("ord").alias("pos"))
    lab = TD.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"))
    later = arts.join(lab, "id").select("id", F.concat(F.lit("labelled: "), "title").alias("title"), (F.col("pos") + 1).alias("pos"))
    return dedup.keyed_last_wins(arts, later).select("id", "title", "pos")


@register("q0_signal_digest", f"WITH RECURSIVE {CHAIN} SELECT * FROM digest_items")
def _q0(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.QUERIES_RAW["q0_signal_digest"](spark, sf)


# --------------------------------------------------------------------------------- J6, D3b, D4

_SRC = f"""src AS (SELECT lang, ord, id, content, {Q.norm_title('title')} AS norm, coalesce(content, '') <> '' AS has FROM {{t}})"""


def _survivors_sql(fold: str, rows: str) -> str:
    return f"""mem AS (SELECT m.lang, m.item_ord, m.leader_ord, r.id, r.content FROM {fold}_members m JOIN {rows} r ON r.lang = m.lang AND r.ord = m.item_ord),
surv AS (SELECT *, row_number() OVER (PARTITION BY lang, leader_ord ORDER BY coalesce(content, '') = '', item_ord) AS rn FROM mem)
SELECT lang, id, leader_ord AS ord FROM surv WHERE rn = 1"""


@register("j6_similar_pairs", f"""
WITH {A},
{_SRC.format(t='articles')},
reps AS (SELECT lang, norm, min(ord) AS rep FROM src GROUP BY lang, norm),
rg AS (SELECT *, {Q.bigrams('norm')} AS grams FROM reps),
pairs AS (
  SELECT a.lang, a.rep AS a_ord, b.rep AS b_ord, a.norm AS a_norm, b.norm AS b_norm,
         {Q.dice('a.norm', 'b.norm', 'a.grams', 'b.grams')} AS dice
  FROM rg a JOIN rg b ON a.lang = b.lang AND a.rep < b.rep
)
SELECT * FROM pairs WHERE dice >= {Q.dbl(0.7)}""")
def j6(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.similar_pairs(TD.articles(spark, sf), ["lang"], 0.7)


@register("d3b_fuzzy_scale", f"""
WITH RECURSIVE {A},
{_SRC.format(t='articles')},
{Q.greedy_fold_ctes('g', 'src', 'lang', 'ord', 0.7, False)},
{_survivors_sql('g', 'articles')}""")
def d3b(spark: SparkSession, sf: str) -> DataFrame:
    out = dedup.fuzzy_dedup_scale(dedup.narrow(TD.articles(spark, sf)), ["lang"], 0.7, content="_empty")
    return out.select("lang", "id", "ord")


@register("d4_composite_dedup", f"""
WITH RECURSIVE {A},
{Q.survivor_cte('d1', 'articles', ['lang'], Q.canonical_url('url'), 'url_key')},
{Q.survivor_cte('d2', 'd1', ['lang'], Q.fingerprint('title'), 'fp_key')},
{_SRC.format(t='d2')},
{Q.greedy_fold_ctes('g', 'src', 'lang', 'ord', 0.7, False)},
{_survivors_sql('g', 'd2')}""")
def d4(spark: SparkSession, sf: str) -> DataFrame:
    out = dedup.composite_dedup(dedup.narrow(TD.articles(spark, sf)), ["lang"], 0.7, content="_empty")
    return out.select("lang", "id", "ord")


# Two rows in three have no content: leaders are replaced.
_SOME_CONTENT = "CASE WHEN ord % 3 = 0 THEN content END"


@register("d3_moving_leaders", f"""
WITH RECURSIVE {A},
src AS (SELECT lang, ord, id, {Q.norm_title('title')} AS norm, coalesce({_SOME_CONTENT}, '') <> '' AS has FROM articles),
{Q.greedy_fold_ctes('g', 'src', 'lang', 'ord', 0.7, True)}
SELECT g.lang, g.slot, s.id FROM g JOIN src s ON s.lang = g.lang AND s.ord = g.ord""")
def d3_moving(spark: SparkSession, sf: str) -> DataFrame:
    """D3 with leader replacement on whole languages, numbered like the greedy loop's output."""
    arts = dedup.narrow(TD.articles(spark, sf).withColumn("content", F.expr(_SOME_CONTENT)))
    out = moving_leaders.fuzzy_dedup_moving(arts, ["lang"], 0.7, content="_empty")
    return rank.numbered(out, ["lang"], [F.col("ord")], "slot").select("lang", "slot", "id")


@register("j6_minhash_recall", f"""
WITH {A},
{_SRC.format(t='articles')},
reps AS (SELECT lang, norm, min(ord) AS rep FROM src GROUP BY lang, norm),
rg AS (SELECT *, {Q.bigrams('norm')} AS grams FROM reps),
pairs AS (SELECT a.lang FROM rg a JOIN rg b ON a.lang = b.lang AND a.rep < b.rep
          WHERE {Q.dice('a.norm', 'b.norm', 'a.grams', 'b.grams')} >= {Q.dbl(0.7)})
SELECT lang, count(*) AS n_pairs, true AS recall_reached, CAST(0 AS BIGINT) AS n_wrong FROM pairs GROUP BY lang""")
def j6_minhash(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs found by MinHash held against the exact join: recall of at least 0.9, nothing wrong."""
    arts = dedup.narrow(TD.articles(spark, sf))
    exact = dedup.similar_pairs(arts, ["lang"], 0.7, titles=False).select("lang", "a_ord", "b_ord", F.lit(True).alias("_exact"))
    found = minhash.similar_pairs(arts, ["lang"], 0.7, titles=False).select("lang", "a_ord", "b_ord", F.lit(True).alias("_found"))
    both = exact.join(found, ["lang", "a_ord", "b_ord"], "full").groupBy("lang").agg(
        F.count("_exact").alias("n_pairs"), F.count_if(F.col("_exact") & F.col("_found")).alias("_hits"),
        F.count_if(F.col("_exact").isNull()).alias("n_wrong"))
    return both.select("lang", "n_pairs", (F.col("_hits") >= 0.9 * F.col("n_pairs")).alias("recall_reached"), "n_wrong")


# --------------------------------------------------------------------------------- M2 with a large dictionary


def _large_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Every lower-case title word of three characters or more, weight = length."""
    words = TD.articles(spark, sf).select(F.explode(F.split(F.lower("title"), r"[^\p{L}\p{N}]+")).alias("keyword"))
    return words.where(F.length("keyword") >= 3).distinct().select("keyword", F.length("keyword").cast("double").alias("weight"))


_LARGE_SQL = f"""{A},
w AS (SELECT unnest(regexp_split_to_array(lower(title), '[^\\p{{L}}\\p{{N}}]+')) AS keyword FROM articles),
d AS (SELECT DISTINCT keyword, CAST(length(keyword) AS DOUBLE) AS weight FROM w WHERE length(keyword) >= 3)"""


@register("m2_large_dictionary", f"""
WITH {_LARGE_SQL},
t AS (SELECT id, {Q.scoring_text()} AS txt FROM articles)
SELECT t.id, coalesce(sum(d.weight), CAST(0 AS DOUBLE)) AS positive
FROM t LEFT JOIN d ON contains(t.txt, d.keyword) GROUP BY t.id""")
def m2_large(spark: SparkSession, sf: str) -> DataFrame:
    """M2 above the inline limit: keywords found by the runs of the texts."""
    d = _large_dictionary(spark, sf)
    out = keywords.layer1_scores(TD.articles(spark, sf), d, {}, inline_limit=512)
    return out.select("id", "positive")


@register("j5_large_dictionary", f"""
WITH {_LARGE_SQL}
SELECT d.keyword, count(*) AS n_docs, sum(d.weight) AS weight_sum
FROM articles a JOIN d ON contains(lower(coalesce(a.title, '')), d.keyword) OR contains(lower(coalesce(a.content, '')), d.keyword)
GROUP BY d.keyword""")
def j5_large(spark: SparkSession, sf: str) -> DataFrame:
    """J5 above the inline limit."""
    hits = keywords.keyword_hits(TD.articles(spark, sf), _large_dictionary(spark, sf), ["id"])
    return hits.groupBy("keyword").agg(F.count("*").alias("n_docs"), F.sum("weight").alias("weight_sum"))


@register("q0_large_dictionary", f"""
WITH {_LARGE_SQL},
{Z.stored_cte()},
hwm AS (SELECT max(coalesce(published_at, digest_date)) AS mark FROM stored),
f2 AS (SELECT a.* FROM articles a, hwm WHERE hwm.mark IS NULL OR coalesce(a.published_at, '') = '' OR a.published_ts > CAST(hwm.mark AS TIMESTAMP)),
pos AS (SELECT f.id, coalesce(sum(d.weight), CAST(0 AS DOUBLE)) AS positive
        FROM f2 f LEFT JOIN d ON contains({Q.scoring_text('f.title', 'f.content')}, d.keyword) GROUP BY f.id),
scored AS (SELECT f2.*, {Q.layer1('positive', Q.inline_score(Q.scoring_text(), TD.NEGATIVE_KEYWORDS))} AS layer1 FROM f2 JOIN pos USING (id)),
{Q.survivor_cte('d1', 'scored', ['lang'], Q.canonical_url('url'), 'url_key')},
{Q.survivor_cte('d2', 'd1', ['lang'], Q.fingerprint('title'), 'fp_key')},
t1 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY layer1 DESC, ord) AS l1_rank FROM d2)
SELECT lang, CAST(l1_rank AS INTEGER) AS l1_rank, id, layer1 FROM t1 WHERE l1_rank <= 150""")
def q0_large(spark: SparkSession, sf: str) -> DataFrame:
    """Q0 up to the prune (T1) with every title word as a keyword."""
    from digestry.plans.signal_digest import run_digest

    run = run_digest(TD.articles(spark, sf), _large_dictionary(spark, sf), TD.NEGATIVE_KEYWORDS, catalog.q0_params(), catalog.RUN_AS_OF,
                     stored=TD.stored_articles(spark, sf), finish=False)
    return run.pruned.select("lang", "l1_rank", "id", "layer1")
