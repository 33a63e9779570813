"""Registered queries: one per operator of the inventory, bound to the test tables.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
given tables.  ``ORACLE`` holds the DuckDB SQL computing the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from digestry import session
from digestry.operators import dedup, keywords, rank
from digestry.plans import sqlgen as Q
from digestry.sources import testdata as TD

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
QUERIES_RAW: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            session.prepare(spark)
            return fn(spark, sf_dir)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        QUERIES_RAW.setdefault(name, fn)
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


# ----------------------------------------------------------------------------------------
# Q1: the minimum slice: articles -> D1 -> M2/S4 -> F3 -> T3, per language.

THRESHOLD = 60.0
TOP_N = 10

_Q1_SQL = f"""
WITH {Q.articles_cte()},
{Q.survivor_cte('d1', 'articles', ['lang'], Q.canonical_url('url'), 'url_key')},
scored AS (
  SELECT *, {Q.inline_score(Q.scoring_text(), TD.SIGNAL_KEYWORDS)} AS positive,
            {Q.inline_score(Q.scoring_text(), TD.NEGATIVE_KEYWORDS)} AS negative
  FROM d1
), l1 AS (SELECT *, {Q.layer1('positive', 'negative')} AS layer1 FROM scored),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY layer1 DESC, ord) AS rank
  FROM l1 WHERE layer1 >= {Q.dbl(THRESHOLD)}
)
SELECT lang, CAST(rank AS INTEGER) AS rank, id, title, url, ord, layer1 FROM ranked WHERE rank <= {TOP_N}
"""


@register("q1_top_signal_after_url_dedup", _Q1_SQL)
def q1_top_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 10 per language by keyword signal after URL dedup (threshold 60)."""
    # scores first, map-side, so the text isn't shuffled
    scored = keywords.layer1_scores(TD.articles(spark, sf_dir), TD.SIGNAL_KEYWORDS, TD.NEGATIVE_KEYWORDS)
    uniq = dedup.dedup_url(dedup.narrow(scored), ["lang"], content="_empty")
    passed = rank.signal_threshold(uniq, THRESHOLD, "layer1")
    top = rank.top_k(passed, TOP_N, [F.col("layer1").desc(), F.col("ord")], ["lang"], "rank")
    return top.select("lang", "rank", "id", "title", "url", "ord", "layer1")


# ----------------------------------------------------------------------------------------
# Q0: the flagship digest run, one digest per language.

RUN_AS_OF = "2024-01-20 18:00:00"


def q0_params(model_enabled: bool = True, group: str = "lang"):
    from digestry.params import DigestParams

    return DigestParams(group_cols=(group,), enable_model_scoring=model_enabled)


def q0_run(spark: SparkSession, sf_dir: str, finish: bool = True, model_enabled: bool = True, group: str = "lang", groups=None):
    from digestry.plans.signal_digest import run_digest

    return run_digest(
        TD.articles(spark, sf_dir), TD.SIGNAL_KEYWORDS, TD.NEGATIVE_KEYWORDS, q0_params(model_enabled, group), RUN_AS_OF,
        model_scores=TD.model_scores(spark, sf_dir), analyses=TD.analyses(spark, sf_dir),
        stored=TD.stored_articles(spark, sf_dir), finish=finish, groups=groups,
    )


@register("q0_signal_digest")
def q0_signal_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q0: digest items per language (flattened) with the digest metadata."""
    return q0_run(spark, sf_dir).digest_items


@register("q0_digest_per_source")
def q0_digest_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q0 with one digest per source (20 digests in one job): the group column
    is any article column; every per-group cut applies inside each source."""
    rows = q0_run(spark, sf_dir, group="source").digest_items
    return rows.select(
        F.col("source").alias("digest"), "pos", "title", "url", "summary", "category", "source", "score", "total_new_items", "total_selected")


# the per-operator query modules register themselves on import
from digestry.plans import catalog_text  # noqa: E402,F401
from digestry.plans import catalog_dedup  # noqa: E402,F401
from digestry.plans import catalog_sources  # noqa: E402,F401
from digestry.plans import catalog_audit  # noqa: E402,F401
from digestry.plans import catalog_store  # noqa: E402,F401
from digestry.plans import catalog_stream  # noqa: E402,F401
