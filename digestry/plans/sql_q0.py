"""DuckDB SQL of the flagship chain (Q0), as named CTEs reused by the
per-operator oracle queries."""

from __future__ import annotations

from digestry.plans import sqlgen as Q
from digestry.sources import testdata as TD

RUN_AS_OF = "2024-01-20 18:00:00"
THRESHOLD = 60.0
MAX_ITEMS = 10
PRUNE_K = 150
CANDIDATES = 25
FUZZY = 0.7


def stored_cte() -> str:
    return f"""stored AS (
  SELECT a.id, a.title, a.url, a.source, nullif(a.content, '') AS content,
         'quality=' || CAST(l.quality AS VARCHAR) || ', toxic=' || CAST(l.toxic AS VARCHAR) AS summary,
         {Q.heuristic_category('a.title')} AS category, CAST(NULL AS VARCHAR) AS published_at,
         CAST(CASE WHEN l.toxic = 0 THEN {TD.STORED_SCORE_CLEAN} ELSE {TD.STORED_SCORE_TOXIC} END AS BIGINT) AS score,
         '{TD.PREVIOUS_DIGEST_DATE}' AS digest_date, CAST(l.quality AS INTEGER) AS delivered, a.lang
  FROM articles a JOIN labels l ON a.id = CAST(l.doc_id AS VARCHAR)
)"""


def chain(model_enabled: bool = True, positive: dict | None = None) -> str:
    positive = positive or TD.SIGNAL_KEYWORDS
    kw = list(positive)
    txt = Q.scoring_text()
    cut_iso = f"strftime(TIMESTAMP '{RUN_AS_OF}' - INTERVAL 24 HOUR, '%Y-%m-%dT%H:%M:%S.%gZ')"
    cut_date = f"strftime(TIMESTAMP '{RUN_AS_OF}' - INTERVAL 24 HOUR, '%Y-%m-%d')"
    digest_date = RUN_AS_OF[:10]
    return f"""{Q.articles_cte()},
{stored_cte()},
hwm AS (SELECT max(coalesce(published_at, digest_date)) AS mark FROM stored),
f2 AS (
  SELECT a.* FROM articles a, hwm
  WHERE hwm.mark IS NULL OR coalesce(a.published_at, '') = '' OR a.published_ts > CAST(hwm.mark AS TIMESTAMP)
),
counts AS (SELECT lang, count(*) AS total_new_items FROM f2 GROUP BY lang),
scored0 AS (
  SELECT *, ord AS src_ord, {Q.inline_score(txt, positive)} AS positive, {Q.inline_score(txt, TD.NEGATIVE_KEYWORDS)} AS negative,
         {Q.keyword_matches(kw)} AS matches
  FROM f2
), scored AS (SELECT *, {Q.layer1('positive', 'negative')} AS layer1 FROM scored0),
{Q.survivor_cte('d1', 'scored', ['lang'], Q.canonical_url('url'), 'url_key')},
{Q.survivor_cte('d2', 'd1', ['lang'], Q.fingerprint('title'), 'fp_key')},
t1 AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY layer1 DESC, ord) AS l1_rank FROM d2)
  WHERE l1_rank <= {PRUNE_K}
),
t1n AS (SELECT *, {Q.norm_title('title')} AS norm, coalesce(content, '') <> '' AS has FROM t1),
{Q.greedy_fold_ctes('d3', 't1n', 'lang', 'l1_rank', FUZZY, True)},
d3rows AS (SELECT t.*, d3.slot AS rank FROM d3 JOIN t1 t ON t.lang = d3.lang AND t.ord = d3.ord),
firsts AS (
  SELECT DISTINCT lang, first_rank FROM (
    SELECT lang, kw, min(rank) AS first_rank FROM (SELECT lang, rank, unnest(matches) AS kw FROM d3rows) GROUP BY lang, kw)
),
cov AS (
  SELECT * FROM (
    SELECT d.*, row_number() OVER (PARTITION BY d.lang ORDER BY d.rank) AS cov_rank FROM d3rows d
    WHERE len(d.matches) = 0 OR EXISTS (SELECT 1 FROM firsts f WHERE f.lang = d.lang AND f.first_rank = d.rank))
  WHERE cov_rank <= {CANDIDATES}
),
ms AS (SELECT CAST(doc_id AS VARCHAR) AS id, max(CAST(CASE WHEN toxic = 0 THEN quality * {TD.MODEL_SCORE_PER_QUALITY} ELSE 0 END AS DOUBLE)) AS model_score FROM labels GROUP BY 1),
blended0 AS (
  SELECT c.*, CASE WHEN c.negative = 0 THEN coalesce(ms.model_score, {Q.dbl(0)}) ELSE {Q.dbl(0)} END AS layer2
  FROM cov c LEFT JOIN ms ON c.id = ms.id
), blended AS (SELECT *, {Q.blend('layer1', 'layer2') if model_enabled else 'CAST(layer1 AS DOUBLE)'} AS final_score FROM blended0),
asked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY cov_rank) AS ask_rank FROM cov WHERE negative = 0),
sel AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY final_score DESC, cov_rank) AS sel_rank
                 FROM blended WHERE final_score >= {Q.dbl(THRESHOLD)})
  WHERE sel_rank <= {MAX_ITEMS}
),
an AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, 'quality=' || CAST(quality AS VARCHAR) || ', toxic=' || CAST(toxic AS VARCHAR) AS a_summary,
         CASE WHEN toxic = 1 THEN '' ELSE 'Research' END AS a_category FROM labels
),
enriched AS (
  SELECT s.*, CASE WHEN an.id IS NOT NULL THEN nullif(an.a_summary, '') END AS summary,
         CASE WHEN an.id IS NOT NULL THEN coalesce(nullif(an.a_category, ''), 'Uncategorized') ELSE {Q.heuristic_category('s.title')} END AS category,
         s.final_score AS score
  FROM sel s LEFT JOIN an ON s.id = an.id
),
new_rows AS (
  SELECT e.id, e.title, e.url, e.source, nullif(a.content, '') AS content, nullif(e.summary, '') AS summary,
         coalesce(nullif(e.category, ''), 'Uncategorized') AS category, nullif(e.published_at, '') AS published_at,
         coalesce(CAST(e.score AS BIGINT), 0) AS score, '{digest_date}' AS digest_date, 0 AS delivered, e.lang, e.sel_rank AS pos
  FROM enriched e JOIN articles a ON a.ord = e.src_ord
),
stored_next AS (
  SELECT coalesce(s.id, n.id) AS id,
         CASE WHEN n.id IS NOT NULL THEN n.title ELSE s.title END AS title,
         CASE WHEN s.id IS NOT NULL THEN s.url ELSE n.url END AS url,
         CASE WHEN s.id IS NOT NULL THEN s.source ELSE n.source END AS source,
         CASE WHEN s.id IS NOT NULL THEN s.content ELSE n.content END AS content,
         CASE WHEN n.id IS NOT NULL THEN n.summary ELSE s.summary END AS summary,
         CASE WHEN n.id IS NOT NULL THEN n.category ELSE s.category END AS category,
         CASE WHEN s.id IS NOT NULL THEN s.published_at ELSE n.published_at END AS published_at,
         CASE WHEN n.id IS NOT NULL THEN n.score ELSE s.score END AS score,
         CASE WHEN s.id IS NOT NULL THEN s.digest_date ELSE n.digest_date END AS digest_date,
         CASE WHEN s.id IS NOT NULL THEN s.delivered ELSE n.delivered END AS delivered,
         CASE WHEN s.id IS NOT NULL THEN s.lang ELSE n.lang END AS lang
  FROM stored s FULL OUTER JOIN new_rows n ON s.id = n.id AND s.lang IS NOT DISTINCT FROM n.lang
),
pend AS (
  SELECT * FROM stored_next
  WHERE score >= {Q.dbl(THRESHOLD)} AND delivered = 0 AND summary IS NOT NULL
    AND coalesce(published_at > {cut_iso} OR digest_date > {cut_date}, false)
),
allitems AS (
  SELECT lang, id, title, url, summary, category, source, score, 0 AS src, digest_date AS k1, id AS k2 FROM pend
  UNION ALL
  SELECT lang, id, title, url, summary, category, source, score, 1 AS src, lpad(CAST(sel_rank AS VARCHAR), 12, '0') AS k1, '' AS k2 FROM enriched
),
keyed AS (
  SELECT lang, id, arg_max(title, src) AS title, arg_max(url, src) AS url, arg_max(summary, src) AS summary,
         arg_max(category, src) AS category, arg_max(source, src) AS source, arg_max(score, src) AS score,
         min(src) AS p_src, min(k1) FILTER (WHERE src = 0) AS k1_0, min(k1) FILTER (WHERE src = 1) AS k1_1,
         min(k2) FILTER (WHERE src = 0) AS k2_0
  FROM allitems GROUP BY lang, id
),
items AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY p_src,
           CASE WHEN p_src = 0 THEN k1_0 ELSE k1_1 END, CASE WHEN p_src = 0 THEN k2_0 ELSE '' END) AS pos
  FROM keyed
),
digest_items AS (
  SELECT i.lang, CAST(i.pos AS INTEGER) AS pos, i.title, i.url, i.summary, i.category, i.source, i.score,
         coalesce(c.total_new_items, 0) AS total_new_items, count(*) OVER (PARTITION BY i.lang) AS total_selected,
         '{digest_date}' AS digest_date
  FROM items i LEFT JOIN counts c ON i.lang = c.lang
)"""
