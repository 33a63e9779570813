"""Q0: the flagship digest run, for many digests at once (one per group).

A10 -> F2 -> D1 -> D2 -> M2/S4 -> T1 -> D3 -> F5/T2 -> F4/J2/S5 -> F3/T3 -> J4
-> K1 -> F6/U2 -> M7.

Plan shape (what makes it hold at scale):

* The only full pass over the text is the scan: layer-1 scores (M2/S4), the
  keyword-match indices used by coverage (S16) and the dedup keys are
  computed there, map-side.  After that only narrow rows move (ids, keys,
  scores; no content).
* D1 and D2 are hash aggregations with map-side partial aggregation.
* T1 is a per-group ``row_number() <= 150`` that Spark turns into a
  WindowGroupLimit below the shuffle, so each map task ships at most 150
  rows per group.  Everything after T1 works on at most 150 rows per group.
* The store (K1) needs the content of the selected rows only; they are
  joined back by id at the end.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from digestry.functions import scores as S
from digestry.functions import text as T
from digestry.operators import dedup, digest, keywords, model, rank, store
from digestry.params import DigestParams
from digestry.session import checked_broadcast, checkpoint_dir, materialize


@dataclass
class DigestRun:
    new_items: DataFrame  # after F2 (M6 counts these)
    unique: DataFrame  # after D1 -> D2, narrow rows with layer-1 scores
    pruned: DataFrame  # after T1 (l1_rank)
    fuzzy: DataFrame  # after D3a (rank = slot)
    candidates: DataFrame  # after F5/T2 (cov_rank)
    blended: DataFrame  # after F4/J2/S5 (layer2, final_score)
    selected: DataFrame  # after F3/T3 + J4 (sel_rank, summary, category, score)
    stored: DataFrame  # K1 result (the next table version)
    unplaced: DataFrame | None  # U2 result, in the order of _p
    counts: DataFrame  # M6 per group
    digest_date: str | None
    group_cols: tuple[str, ...]
    new_rows: DataFrame | None = None  # the selection in stored form, with pos

    @cached_property
    def placed(self) -> DataFrame:
        return rank.numbered(self.unplaced, self.group_cols, ["_p"])

    def funnel(self, raw: DataFrame) -> DataFrame:
        """Per group the rows that reach each stage.

        The first two stages are counted by the job that finds the survivors, the others on written rows, at most
        prune_k per group; of ``raw``, the run's articles, only the group columns are read."""
        g = list(self.group_cols)
        keys = g or ["_all"]  # one digest: one group

        def grouped(rows: DataFrame) -> DataFrame:
            return rows if g else rows.withColumn("_all", F.lit(1))

        out = digest.stage_funnel(grouped(raw), [], keys).join(grouped(self.counts).withColumnRenamed("total_new_items", "new_items"), keys, "left")
        for name, rows in (("pruned", self.pruned), ("fuzzy_kept", self.fuzzy), ("candidates", self.candidates), ("selected", self.selected)):
            out = out.join(grouped(rows).groupBy(*keys).agg(F.count("*").alias(name)), keys, "left")
        stages = ["new_items", "unique_items", "pruned", "fuzzy_kept", "candidates", "selected"]
        return out.select(*g, "raw", *[F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(n) for n in stages])

    @property
    def delivered_items(self) -> DataFrame:
        """U2 result, with pos."""
        return self.placed.drop("_p", "total")

    @property
    def digest_items(self) -> DataFrame:
        """M7 as one row per item, for digests of any size."""
        return digest.item_rows(self.placed, self.counts, self.digest_date, self.group_cols)

    @property
    def digests(self) -> DataFrame:
        """M7 result, one nested row per digest."""
        return digest.assemble(self.delivered_items, self.counts, self.digest_date, self.group_cols, "pos")


def _of_groups(rows: DataFrame, wanted: DataFrame, group_cols: list[str]) -> DataFrame:
    same = F.lit(True)
    for i, c in enumerate(group_cols):
        same = same & rows[c].eqNullSafe(wanted[f"_g{i}"])
    return rows.join(wanted, same, "left_semi")


def _matched(rows: DataFrame, articles: DataFrame, positive: DataFrame) -> DataFrame:
    """``rows``, few per group, with ``matches``: the keywords in the title or the content of the article each came from (S16),
    which is known by its position and its texts."""
    mine = ["src_ord", "_text_hash"]
    rows = materialize(rows)
    asked = rows.select(*[F.col(c).alias(f"{c}_") for c in mine]).distinct()
    texts = articles.select(F.col("ord").alias("src_ord"), F.xxhash64("title", "content").alias("_text_hash"), "title", "content")
    same = F.col("src_ord").eqNullSafe(F.col("src_ord_")) & (F.col("_text_hash") == F.col("_text_hash_"))
    texts = texts.join(checked_broadcast(asked, store.MAX_BROADCAST_NEW_ROWS), same, "left_semi").dropDuplicates(mine)
    # a keyword found only across the end of the title is no match
    both = F.lower(F.concat_ws("\x00", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))))
    found = keywords.with_found(texts.select(*mine, both.alias("_both")), positive, "_both", "src_ord", "_found")
    found = found.select(*[F.col(c).alias(f"{c}_") for c in mine], F.transform("_found", lambda m: m["keyword"]).alias("matches"))
    return rows.join(found, same, "left").drop("_text_hash", *[f"{c}_" for c in mine])


def _uniq(cols: list[str]) -> list[str]:
    """Column names without repeats (a group column may also be an article column)."""
    return list(dict.fromkeys(cols))


def match_indices(keywords_: list[str], title: str = "title", content: str = "content", scoring_text: str | None = None):
    """S16 as indices into ``keywords_`` (small ints instead of strings on narrow rows).

    A keyword without a space is in title or content exactly when it is in
    the scoring text (title + ' ' + content), so its test is the scoring
    test itself, which Spark evaluates once per row.  Only keywords with a
    space are tested on title and content separately.
    """
    if not keywords_:
        return F.expr("CAST(array() AS ARRAY<INT>)")
    tl, cl = f"lower(coalesce(`{title}`, ''))", f"lower(coalesce(`{content}`, ''))"
    hits = []
    for i, k in enumerate(keywords_):
        kl = T.sql_str(k.lower())
        if scoring_text is not None and " " not in k:
            cond = f"contains(`{scoring_text}`, {kl})"
        else:
            cond = f"(contains({tl}, {kl}) OR contains({cl}, {kl}))"
        hits.append(f"CASE WHEN {cond} THEN {i} END")
    return F.expr(f"array_compact(array({', '.join(hits)}))")


def run_digest(
    articles: DataFrame,
    positive,
    negative,
    params: DigestParams,
    as_of: str,
    model_scores: DataFrame | None = None,
    analyses: DataFrame | None = None,
    stored: DataFrame | None = None,
    finish: bool = True,
    health: DataFrame | None = None,
    force: bool = False,
    scorer=None,
    analyser=None,
    groups: DataFrame | None = None,
) -> DigestRun:
    """Q0.  With ``finish=False`` only the selection (up to J4) is planned:
    no checkpoint, store or digest step.

    ``health`` (a source-health log) turns on F1: items of sources whose
    latest check is younger than ``params.cooldown_minutes`` are skipped
    (``force`` bypasses it), as the reference skips those sources before
    fetching.  If every source is cooling down, the run still assembles the
    pending items.

    ``groups`` (one row per group wanted, e.g. ``subscriptions.due_groups``) limits the run to
    those digests; the stored rows of all others stay as they are.

    ``scorer`` (titles -> scores, B4) takes the place of ``model_scores`` and
    ``analyser`` (titles -> (summary, category), B5) that of ``analyses``."""
    g = list(params.group_cols)
    strict = params.strict_reference
    # the mark is one scalar of the stored table (or none)
    hwm = store.read_mark(stored, strict) if stored is not None else None
    if health is not None and not force:
        sources = articles.select(F.col("source").alias("id")).distinct()
        active = store.cooldown_filter(sources, health, as_of, params.cooldown_minutes)
        keys = checked_broadcast(active.select(F.col("id").alias("source")), 1 << 20)
        articles = articles.join(keys, "source", "left_semi")
    if groups is not None:
        wanted = checked_broadcast(groups.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(g)]), 1 << 20)
        articles = _of_groups(articles, wanted, g)
    new = store.incremental_filter(articles, hwm)

    # scan-side work: layer-1 score, coverage matches, content flag; then drop the text
    positive, negative = keywords.known(positive), keywords.known(negative)
    pos_items = keywords._as_items(positive, params.inline_keyword_limit)
    neg_items = keywords._as_items(negative, params.inline_keyword_limit)
    kw_list = [k for k, _ in pos_items] if pos_items is not None else []
    # one projection: the score terms and the match indices share their
    # contains() tests, which Spark then evaluates once per row
    scored = new.withColumn("_score_text", T.scoring_text())
    if pos_items is not None:
        scored = scored.select("*", keywords.inline_score("_score_text", pos_items).alias("positive"),
                               match_indices(kw_list, scoring_text="_score_text").alias("match_idx"))
    else:  # a dictionary of any size; what the few rows left after the prune match is asked for below
        scored = keywords.with_score(scored, keywords.as_table(new, positive), "_score_text", "ord", "positive")
        scored = scored.withColumn("match_idx", F.xxhash64("title", "content"))
    if neg_items is not None:
        scored = scored.withColumn("negative", keywords.inline_score("_score_text", neg_items))
    else:
        scored = keywords.with_score(scored, keywords.as_table(new, negative), "_score_text", "ord", "negative")
    scored = scored.withColumn("layer1", S.layer1("positive", "negative"))
    scored = scored.withColumn("src_ord", F.col("ord"))  # a survivor's own row; ord becomes its cluster's first position
    narrow = scored.select(
        *_uniq([*g, "id", "title", "url", "source", "published_at", "ord", "src_ord", "positive", "negative", "layer1", "match_idx"]),
        dedup.content_empty("content").alias("_empty"),
        F.lit(1).cast("bigint").alias("_n_raw"),
    )
    uniq = dedup.exact_dedup(narrow, g, strict, params.keep_query_params, content="_empty", size_col="_n_raw")
    # the narrow survivors are read twice, for the counts and for the cut: keep them until both are written
    uniq = uniq.persist()
    # M6 from the cluster sizes: no second pass over the input
    counts = materialize(uniq.groupBy(*g).agg(F.sum("_n_raw").alias("total_new_items"), F.count("*").alias("unique_items")))
    kept = uniq
    uniq = uniq.drop("_n_raw")
    # at most prune_k narrow rows per group; all later stages, and the funnel's counts, read these
    pruned = materialize(rank.top_k(uniq, params.prune_k, [F.col("layer1").desc(), F.col("ord")], g, "l1_rank"))
    kept.unpersist()
    fuzzy = dedup.fuzzy_dedup_greedy(pruned, g, params.fuzzy_threshold, [F.col("l1_rank")], content="_empty", rank_col="rank")
    if pos_items is not None:  # indices into the inlined dictionary; else the keywords themselves
        kw_arr = F.array(*[F.lit(k) for k in kw_list]) if kw_list else F.array().cast("array<string>")
        with_matches = fuzzy.withColumn("matches", F.transform("match_idx", lambda i: F.element_at(kw_arr, i + 1)))
    else:
        fuzzy = fuzzy.withColumnRenamed("match_idx", "_text_hash")
        with_matches = _matched(fuzzy, new, keywords.as_table(new, positive))
    cands = rank.coverage_filter(with_matches, "matches", "rank", g, params.candidate_limit, "cov_rank")
    # at most candidate_limit rows per group: materialise once (reliable checkpoint), so the
    # size checks of the broadcast lookups below read this small set, not the whole lineage
    cands = materialize(cands)
    # every later small set (selection, enrichment, rows to store) is a subset of the
    # candidates: one count bounds them all
    small = cands.count() <= min(model.MAX_LOOKUP_KEYS, store.MAX_BROADCAST_NEW_ROWS)
    if scorer is not None and params.enable_model_scoring:
        blended = model.scored_by(cands, scorer, params.batch_size, "cov_rank", g, w1=params.blend_l1, w2=params.blend_l2)
    else:
        blended = model.model_layer(cands, model_scores, params.enable_model_scoring, w1=params.blend_l1, w2=params.blend_l2,
                                    bounded=small)
    sel = rank.select_top(blended, params.signal_threshold, params.max_items, g, "final_score", "cov_rank", "sel_rank")

    # Analysis lookup (default: precomputed table), fallback S17
    if analyser is not None:
        sel = model.analysed_by(sel, analyser, "sel_rank", g)
    elif analyses is not None:
        keys = sel.select("id").distinct()
        keys = F.broadcast(keys) if small else checked_broadcast(keys, model.MAX_LOOKUP_KEYS)
        a = analyses.join(keys, "id", "left_semi").dropDuplicates(["id"]).select(
            "id", F.col("summary").alias("_as"), F.col("category").alias("_ac"), F.lit(True).alias("_ah"))
        sel = sel.join(a, "id", "left")
        sel = sel.withColumn("summary", F.when(F.col("_ah"), F.nullif(F.col("_as"), F.lit(""))))
        sel = sel.withColumn("category", F.when(F.col("_ah"), T.falsy_or("_ac", F.lit(T.UNCATEGORIZED))).otherwise(T.heuristic_category("title")))
        sel = sel.drop("_as", "_ac", "_ah")
    else:
        sel = model.fallback_analysis(sel)
    enriched = sel.withColumn("score", F.col("final_score"))
    if not finish:
        return DigestRun(new, uniq, pruned, fuzzy, cands, blended, enriched, None, None, counts, None, tuple(g))
    # the selection is at most max_items rows per group; materialise it once
    # (reliable checkpoint in spark.checkpoint.dir) for the store and digest steps
    enriched = materialize(enriched)

    dd_text = dt.datetime.fromisoformat(as_of).date().isoformat()
    # K1: the content of the selected rows only, joined back by the survivor's own row
    # the selection is small (count-checked broadcast): the text side is only streamed, never shuffled
    keys = enriched.select("src_ord")
    keys = F.broadcast(keys) if small else checked_broadcast(keys, store.MAX_BROADCAST_NEW_ROWS)
    content = articles.select(F.col("ord").alias("src_ord"), "content").join(keys, "src_ord", "left_semi")
    to_store = enriched.join(content, "src_ord", "left").withColumn("pos", F.col("sel_rank"))
    extra = [c for c in g if c not in store.ARTICLE_COLUMNS]  # group columns the article schema lacks
    new_rows = store.to_stored(to_store, dd_text, keep=[*extra, "pos"])
    if stored is not None:
        stored_next = store.upsert(stored.select(*store.ARTICLE_COLUMNS, *extra), new_rows, "pos", extra_cols=extra,
                                   key_cols=_uniq([*g, "id"]))
    else:
        stored_next = new_rows.drop("pos")

    # F6 + U2: pending (storage order) then this run's items; later wins, first position kept
    pend = store.pending(stored_next, params.signal_threshold, as_of, params.pending_hours, strict)
    fields = _uniq([*g, *digest.ITEM_FIELDS, "id"])
    if groups is not None:
        pend = _of_groups(pend, wanted, g)
    pend = pend.select(*fields, F.lit(0).alias("_src"), F.col("digest_date").alias("_k1"), F.col("id").alias("_k2"))
    cur = enriched.select(*fields, F.lit(1).alias("_src"),
                          F.lpad(F.col("sel_rank").cast("string"), 12, "0").alias("_k1"), F.lit("").alias("_k2"))
    keyed = pend.unionByName(cur).groupBy(*g, "id").agg(
        F.max_by(F.struct(*[F.col(c) for c in digest.ITEM_FIELDS]), F.col("_src")).alias("_v"),
        F.min(F.struct("_src", "_k1", "_k2")).alias("_p"),
    )
    # one digest's items (selected + pending): the pending ones grow with the stored table
    items = keyed.select(*g, "id", *[F.col("_v")[c].alias(c) for c in digest.ITEM_FIELDS if c not in g], "_p")
    return DigestRun(new, uniq, pruned, fuzzy, cands, blended, enriched, stored_next, items, counts, dd_text, tuple(g), new_rows)
