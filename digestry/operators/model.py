"""Batch model scoring and analysis as data jobs.

The model is pluggable.  The default is a lookup join to a precomputed score
table, so jobs are deterministic and need no network.  A custom scorer is a
function ``titles -> scores`` applied per batch of 10 by ``applyInPandas``
(one small group per batch, never a whole digest).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from digestry.functions import scores as S
from digestry.functions import text as T
from digestry.operators import rank
from digestry.session import checked_broadcast

# ---------------------------------------------------------------------------
# Prompt wording (our own rubric; only the layout follows the
# reference: a header, the expected count, one line per title).
SCORING_HEADER = (
    "Rate each title from 0 to 100 for importance and novelty to its readers. "
    "Return exactly {n} scores, one per title, in the same order."
)
ANALYSIS_HEADER = 'For each item give a one-sentence "summary" and a "category".'
# ---------------------------------------------------------------------------

SCORES_SCHEMA = "struct<scores: array<double>>"
# Candidate sets up to this many ids are broadcast into lookups of big tables.
MAX_LOOKUP_KEYS = 2_000_000
ANALYSIS_SCHEMA = "struct<signals: array<struct<summary: string, category: string>>>"


def negative_split(df: DataFrame, negative_col: str = "negative") -> DataFrame:
    """rows matching a negative keyword skip the model (``needs_model`` false)."""
    return df.withColumn("needs_model", F.col(negative_col) == F.lit(0.0))


def lookup_scores(cands: DataFrame, scores: DataFrame, key: str = "id", score_col: str = "model_score",
                  bounded: bool = False) -> DataFrame:
    """Left lookup of a model score by id; missing -> 0.

    The score table is reduced to the candidates' keys by a semi join before
    the lookup, so only matching score rows move.
    """
    # the candidate ids are few (count-checked broadcast); the score table is only streamed
    keys = cands.select(key).distinct()
    keys = F.broadcast(keys) if bounded else checked_broadcast(keys, MAX_LOOKUP_KEYS)
    needed = scores.join(keys, key, "left_semi").groupBy(key).agg(F.max(score_col).alias("_l2"))
    return cands.join(needed, key, "left").withColumn("layer2", F.coalesce(F.col("_l2"), F.lit(0.0))).drop("_l2")


def model_layer(cands: DataFrame, scores: DataFrame | None, enabled: bool = True, l1: str = "layer1",
                negative_col: str = "negative", w1: float = 0.7, w2: float = 0.3, bounded: bool = False) -> DataFrame:
    """F4 + J2 + S5 (+ F8 when disabled): adds ``layer2`` and ``final_score``."""
    if not enabled or scores is None:  # F8: the layer-1 score passes through untouched
        return cands.withColumn("layer2", F.lit(None).cast("double")).withColumn("final_score", F.col(l1).cast("double"))
    split = negative_split(cands, negative_col)
    looked = lookup_scores(split, scores, bounded=bounded)
    l2 = F.when(F.col("needs_model"), F.col("layer2")).otherwise(F.lit(0.0))
    return looked.withColumn("layer2", l2).withColumn("final_score", S.blend(l1, "layer2", w1, w2)).drop("needs_model")


def to_model(cands: DataFrame, negative_col: str = "negative") -> DataFrame:
    """the rows the model is asked about; those with a negative keyword are scored 0 without it."""
    return negative_split(cands, negative_col).where("needs_model").drop("needs_model")


def scoring_batches(cands: DataFrame, batch_size: int = 10, order_col: str = "rank", group_cols=()) -> DataFrame:
    """B1: one row per (group, batch) with the titles in rank order."""
    b = rank.batch_numbers(cands, batch_size, order_col, group_cols)
    return b.groupBy(*group_cols, "batch").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("batch_pos", "id", "title"))), lambda x: x["title"]).alias("titles"),
        F.transform(F.array_sort(F.collect_list(F.struct("batch_pos", "id"))), lambda x: x["id"]).alias("ids"),
    )


def scoring_prompt(titles: Column) -> Column:
    """B2: header with the expected count, then one '- title' line per title."""
    header = F.replace(F.lit(SCORING_HEADER), F.lit("{n}"), F.size(titles).cast("string"))
    lines = F.array_join(F.transform(titles, lambda t: F.concat(F.lit("- "), t)), "\n")
    return F.concat(header, F.lit("\n\nTitles:\n"), lines, F.lit("\n"))


def analysis_prompt(titles: Column) -> Column:
    """B3: 'ID i: title' lines (0-based) under the analysis header."""
    lines = F.array_join(
        F.transform(titles, lambda t, i: F.concat(F.lit("ID "), i.cast("string"), F.lit(": "), t)), "\n"
    )
    return F.concat(F.lit(ANALYSIS_HEADER), F.lit("\n\nItems:\n"), lines, F.lit("\n"))


def parse_scores(resp: Column) -> Column:
    """B7 + F11: structured scores; any value outside 0..100 (or a bad
    document) makes the whole batch's scores null (scored 0 by J3)."""
    parsed = F.from_json(resp, SCORES_SCHEMA)["scores"]
    ok = F.forall(parsed, lambda s: s.isNotNull() & (s >= 0) & (s <= 100))
    return F.when(ok, parsed)


def align_scores(batches: DataFrame, scores_col: str = "scores", group_cols=()) -> DataFrame:
    """Positional join of a batch's ids with its returned scores;
    too few -> 0, too many -> ignored, failed batch -> all 0."""
    ids = batches.select(*group_cols, "batch", F.posexplode("ids").alias("pos", "id"))
    sc = batches.select(*group_cols, "batch", F.posexplode_outer(scores_col).alias("pos", "score")).where(F.col("pos").isNotNull())
    keys = [*group_cols, "batch", "pos"]
    return ids.join(sc, keys, "left").select(*group_cols, "batch", "pos", "id", F.coalesce("score", F.lit(0.0)).alias("layer2"))


def parse_analysis(resp: Column) -> Column:
    """``signals`` array of the analysis response; else the S18 text recovery as one item."""
    structured = F.from_json(resp, ANALYSIS_SCHEMA)["signals"]
    recovered = T.recover_analysis(resp)
    return F.coalesce(structured, F.when(recovered.isNotNull(), F.array(recovered)))


def align_analysis(items: DataFrame, analyses: Column, pos_col: str = "pos") -> DataFrame:
    """Positional: item i takes analysis i; falsy summary -> null, falsy
    category -> Uncategorized."""
    a = F.try_element_at(analyses, (F.col(pos_col) + 1).cast("int"))
    return items.withColumn("summary", F.nullif(a["summary"], F.lit(""))).withColumn(
        "category", T.falsy_or(a["category"], F.lit(T.UNCATEGORIZED))
    )


def fallback_analysis(df: DataFrame, title: str = "title") -> DataFrame:
    """B5 failure path: summary null, category by the title heuristic."""
    return df.withColumn("summary", F.lit(None).cast("string")).withColumn("category", T.heuristic_category(title))


def apply_scorer(cands: DataFrame, scorer: Callable[[list[str]], list[float]], batch_size: int = 10,
                 order_col: str = "rank", group_cols=()) -> DataFrame:
    """A user scorer applied per batch of ``batch_size`` titles.

    Each (group, batch) is one pandas group of at most ``batch_size`` rows.  A
    failing call, or any score that isn't a number from 0 to 100 (F11), scores
    the whole batch 0; too few scores are padded with 0, extra ones ignored (J3).
    """
    b = rank.batch_numbers(cands, batch_size, order_col, group_cols).select(*group_cols, "batch", "batch_pos", "id", "title")
    gnames = list(group_cols)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("batch_pos")
        try:
            got = [float(x) for x in scorer(pdf["title"].tolist())]
        except Exception:  # noqa: BLE001  (a failed call scores the batch 0)
            got = []
        if not all(0 <= x <= 100 for x in got):  # false for NaN too
            got = []
        vals = (got + [0.0] * len(pdf))[: len(pdf)]
        out = pdf[[*gnames, "id"]].copy()
        out["layer2"] = vals
        return out

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in b.schema.fields if f.name in gnames]
                       + ["id string", "layer2 double"])
    return b.groupBy(*gnames, "batch").applyInPandas(run, schema)


def scored_by(cands: DataFrame, scorer: Callable[[list[str]], list[float]], batch_size: int, order_col: str, group_cols=(),
              l1: str = "layer1", negative_col: str = "negative", w1: float = 0.7, w2: float = 0.3) -> DataFrame:
    """F4 + B4 + S5: the model layer with a user scorer instead of a score table."""
    g = list(group_cols)
    scores = apply_scorer(to_model(cands, negative_col), scorer, batch_size, order_col, g)
    out = cands.join(scores, [*g, "id"], "left").withColumn("layer2", F.coalesce("layer2", F.lit(0.0)))
    return out.withColumn("final_score", S.blend(l1, "layer2", w1, w2))


def analysed_by(items: DataFrame, analyser: Callable[[list[str]], list[tuple[str, str]]], order_col: str, group_cols=()) -> DataFrame:
    """B5 + J4: a user analyser, titles of one digest -> (summary, category) each, joined by position.

    The items of one digest (at most max_items) are one call.  A failing call, or an item without an answer,
    falls back to a null summary and the title heuristic (S17)."""
    g = list(group_cols)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_order")
        try:
            got = [(str(s or ""), str(c or "")) for s, c in analyser(pdf["title"].tolist())]
        except Exception:  # noqa: BLE001  (a failed call leaves the fallback)
            got = []
        got = (got + [(None, None)] * len(pdf))[: len(pdf)]
        out = pdf[[*g, "id"]].copy()
        out["_as"], out["_ac"] = [x[0] for x in got], [x[1] for x in got]
        return out

    rows = items.select(*g, "id", "title", F.col(order_col).alias("_order"))
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in [*g, "id"]]
                       + ["_as string", "_ac string"])
    answers = rows.groupBy(*g).applyInPandas(run, schema) if g else rows.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(run, schema)
    out = items.join(answers, [*g, "id"], "left").withColumn("summary", F.nullif(F.col("_as"), F.lit("")))
    category = F.when(F.col("_ac").isNull(), T.heuristic_category("title")).otherwise(T.falsy_or("_ac", F.lit(T.UNCATEGORIZED)))
    return out.withColumn("category", category).drop("_as", "_ac")


def run_audit(batches: DataFrame, call: Callable[[str], str], group_cols=()) -> DataFrame:
    """One model call per row of ``batches`` (group columns, batch, prompt),
    with the raw response and the measured latency in milliseconds.

    A failing call has a null response; its latency is measured too."""
    g = list(group_cols)
    rows = batches.select(*g, "batch", "prompt")
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields] + ["raw_response string", "latency_ms double"])

    def run(parts):
        import time

        for pdf in parts:
            answers, took = [], []
            for prompt in pdf["prompt"]:
                start = time.perf_counter()
                try:
                    answers.append(call(prompt))
                except Exception:  # noqa: BLE001  (a failed call is part of the audit)
                    answers.append(None)
                took.append((time.perf_counter() - start) * 1000)
            yield pdf.assign(raw_response=answers, latency_ms=took)

    return rows.mapInPandas(run, schema)
