"""Deduplication.

Order: the reference breaks every tie by encounter order, so every row
carries a unique ``ord`` (rank of (source order, position)) and every result
is defined in terms of it.

* D1/D2 (exact keys) are hash aggregations: ``min_by`` over the row struct
  with the ordering key ``(content is empty, ord)`` is the cluster survivor
  (M8), ``min(ord)`` its position.  Partial aggregation collapses a hot key on
  the map side before the shuffle, so a key holding a third of the rows costs
  one row per map task in the exchange.
* D3a (exact greedy fold) runs on groups that are already bounded (the
  reference prunes to 150 per digest first): each group is one sorted array
  folded by ``aggregate`` in the JVM, including the moving comparison title of
  a replaced leader.
* D3b (scale mode) has no bound on group size: identical normalised titles
  are collapsed first, similar pairs come from blocks of bit sets (J6,
  ``title_blocks``), and leaders are decided in windows of
  edges, in order.  It equals the greedy loop without
  leader replacement; with all rows carrying content it equals D3a.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from digestry.functions import text as T
from digestry.functions import urls as U
from digestry.operators import title_blocks
from digestry.session import checked_broadcast, materialize, rewritten


def content_empty(content: str = "content") -> Column:
    """True when the row has no content.  A boolean column named ``_empty``
    (narrow rows whose text was dropped after scoring) is used as is."""
    if content == "_empty":
        return F.col("_empty")
    return F.coalesce(F.col(content), F.lit("")) == ""


def narrow(df: DataFrame, content: str = "content") -> DataFrame:
    """``df`` with its text replaced by the boolean ``_empty``: what dedup needs
    of it.  Keys, ids and positions are deduplicated; text is joined back
    by position where it is asked for."""
    return df.withColumn("_empty", content_empty(content)).drop(content)


def survivor_by_key(df: DataFrame, key_cols: list[str], ord_col: str = "ord", content: str = "content",
                    size_col: str | None = None) -> DataFrame:
    """M8: per key, the first row with content, else the first row; its
    ``ord`` becomes the cluster's first position.  ``size_col`` (optional,
    an existing column) is summed over the cluster, so input row counts
    survive the dedup without a second pass over the input."""
    cols = df.columns
    aggs = [
        F.min_by(F.struct(*[F.col(c) for c in cols]), F.struct(content_empty(content), F.col(ord_col))).alias("_s"),
        F.min(ord_col).alias("_first"),
    ]
    if size_col:
        aggs.append(F.sum(size_col).alias("_size"))
    agg = df.groupBy(*key_cols).agg(*aggs)

    def pick(c):
        if c == ord_col:
            return F.col("_first").alias(ord_col)
        if c == size_col:
            return F.col("_size").alias(size_col)
        return F.col("_s")[c].alias(c)

    return agg.select(*[pick(c) for c in cols])


def with_url_key(df: DataFrame, strict: bool = True, keep_query: bool = False, url: str = "url", ord_col: str = "ord") -> DataFrame:
    """S6 key column ``url_key``."""
    return df.withColumn("url_key", U.canonical_url(F.col(url), strict=strict, keep_query=keep_query, fallback_key=F.col(ord_col)))


def dedup_url(df: DataFrame, group_cols=(), strict: bool = True, keep_query: bool = False, content: str = "content",
              size_col: str | None = None) -> DataFrame:
    """One row per (group, canonical url); content preferred; first position kept."""
    keyed = with_url_key(df, strict, keep_query)
    return survivor_by_key(keyed, [*group_cols, "url_key"], content=content, size_col=size_col).drop("url_key")


def dedup_fingerprint(df: DataFrame, group_cols=(), title: str = "title", content: str = "content",
                      size_col: str | None = None) -> DataFrame:
    """One row per (group, fingerprint of the title), ordered by D1's positions."""
    keyed = df.withColumn("fp_key", T.fingerprint(title))
    return survivor_by_key(keyed, [*group_cols, "fp_key"], content=content, size_col=size_col).drop("fp_key")


def exact_dedup(df: DataFrame, group_cols=(), strict: bool = True, keep_query: bool = False, content: str = "content",
                size_col: str | None = None) -> DataFrame:
    """D1 then D2 (the reference's removeExactDuplicates)."""
    d1 = dedup_url(df, group_cols, strict, keep_query, content, size_col)
    return dedup_fingerprint(d1, group_cols, content=content, size_col=size_col)


# --------------------------------------------------------------------------- D3a


def fuzzy_dedup_greedy(
    df: DataFrame,
    group_cols=(),
    threshold: float = 0.7,
    order_cols: list[Column] | None = None,
    title: str = "title",
    content: str = "content",
    rank_col: str = "rank",
) -> DataFrame:
    """The reference's greedy leader loop, exact, per bounded group.

    Rows are visited in ``order_cols`` order (default ``ord``).  An item joins
    the first kept leader whose normalised title has Dice >= threshold; if
    that leader has no content and the item has, the item takes the leader's
    slot and its title becomes the slot's comparison key.  Output: the kept
    rows with ``rank_col`` = slot number (1-based), i.e. the output order.

    Each group is collected into one array, so callers must bound the group
    size first (the reference prunes to 150 rows per digest before this step);
    ``fuzzy_dedup_scale`` has no such bound.
    """
    order_cols = order_cols if order_cols is not None else [F.col("ord")]
    cols = df.columns
    g = [F.col(c) for c in group_cols]
    prepared = df.select(
        *g,
        F.struct(*[oc.alias(f"_o{i}") for i, oc in enumerate(order_cols)]).alias("_key"),
        F.struct(
            *[F.col(c) for c in cols],
            T.normalize_title(title).alias("_norm"),
            (~content_empty(content)).alias("_has"),
        ).alias("_row"),
    ).withColumn("_row", F.col("_row").withField("_grams", T.bigrams(F.col("_row._norm"))))
    per_group = prepared.groupBy(*g).agg(F.array_sort(F.collect_list(F.struct("_key", "_row"))).alias("_items"))
    rows = F.transform(F.col("_items"), lambda x: x["_row"])
    empty = F.filter(rows, lambda x: F.lit(False))
    t = F.lit(float(threshold)).cast("double")

    def step(acc, x):
        sims = F.transform(acc, lambda l: T.dice(l["_norm"], x["_norm"], l["_grams"], x["_grams"]) >= t)
        idx = F.array_position(sims, True)
        leader = F.try_element_at(acc, F.greatest(idx, F.lit(1)).cast("int"))
        replaced = F.transform(acc, lambda l, i: F.when(i + 1 == idx, x).otherwise(l))
        return (
            F.when(idx == 0, F.concat(acc, F.array(x)))
            .when((~leader["_has"]) & x["_has"], replaced)
            .otherwise(acc)
        )

    folded = per_group.select(*g, F.posexplode(F.aggregate(rows, empty, step)).alias("_slot", "_r"))
    return folded.select(*g, *[F.col("_r")[c].alias(c) for c in cols if c not in group_cols],
                         (F.col("_slot") + 1).cast("bigint").alias(rank_col)).select(*cols, rank_col)


# --------------------------------------------------------------------------- J6 / D3b


def _norm_table(df: DataFrame, group_cols, title: str, ord_col: str) -> tuple[DataFrame, DataFrame]:
    """Items -> (member -> representative) and distinct normalised titles with their first ord."""
    g = [F.col(c) for c in group_cols]
    items = df.select(*g, F.col(ord_col).alias("_ord"), T.normalize_title(title).alias("_norm"))
    reps = items.groupBy(*g, "_norm").agg(F.min("_ord").alias("_rep"))
    members = items.join(reps.select(*group_cols, "_norm", "_rep"), [*group_cols, "_norm"])
    return members.select(*g, "_ord", "_rep"), reps


def similar_pairs(df: DataFrame, group_cols=(), threshold: float = 0.7, title: str = "title", ord_col: str = "ord", titles: bool = True) -> DataFrame:
    """Similar title pairs per group, between distinct normalised titles.

    Rows with equal normalised titles are one node (their first ``ord``), so a
    title repeated m times adds no m^2 pairs.  Output: group columns,
    ``a_ord < b_ord`` (first rows of the two titles), both titles (unless ``titles`` is off, for who needs the
    positions only) and the Dice coefficient.
    """
    _, reps = _norm_table(df, group_cols, title, ord_col)
    reps = materialize(reps)
    return _as_pairs(title_blocks.similar_titles(reps, group_cols, threshold, titles), group_cols, titles)


def _as_pairs(pairs: DataFrame, group_cols, titles: bool) -> DataFrame:
    texts = [F.col("na_t").alias("a_norm"), F.col("nb_t").alias("b_norm")] if titles else []
    return pairs.select(*group_cols, F.col("a").alias("a_ord"), F.col("b").alias("b_ord"), *texts, "dice")


def _rep_pairs(reps: DataFrame, group_cols, threshold: float, cross: bool = False) -> DataFrame:
    """Similar pairs between distinct normalised titles (a._rep < b._rep), all of them (``title_blocks``)."""
    return title_blocks.similar_titles(reps, group_cols, threshold, cross=cross).drop("dice")


# Titles of which similar pairs are found at once, when leaders are decided: of the first two waves, and how many times as many
# of the later ones, each of which is twice as large as the one before.
WAVE, LARGEST = 1 << 16, 4


def _waves(reps: DataFrame) -> list[DataFrame]:
    """The titles in order of their first rows, ``WAVE`` at a time or more."""
    total, sizes = reps.count(), [WAVE]
    while sum(sizes) < total:
        sizes.append(min(max(WAVE, sum(sizes)), LARGEST * WAVE))
    if len(sizes) < 2 or not isinstance(reps.schema["_rep"].dataType, NumericType):
        return [reps]
    ends = sorted(set(reps.approxQuantile("_rep", [sum(sizes[:i]) / total for i in range(1, len(sizes))], 0.002)))
    at = F.col("_rep").cast("double")
    return [reps.where((at > low if low is not None else F.lit(True)) & (at <= high if high is not None else F.lit(True)))
            for low, high in zip([None, *ends], [*ends, None])]


def _absorbing_leaders(reps: DataFrame, g: list[str], threshold: float, find_pairs) -> DataFrame:
    """(group, _rep, _leader) of all absorbed titles, with the earliest similar leader of each.

    Titles are taken in waves, in their order.  Those of a wave first meet the leaders before them, which come
    earlier, so one similar leader is enough to absorb a title; the rest meet each other.  Leaders never meet leaders again, absorbed
    titles meet nothing more, and the pairs inside a large cluster are at most those of one wave's rest."""
    leaders, out = None, []
    for wave in _waves(reps):
        rest = wave
        if leaders is not None:
            known = leaders.withColumn("_new", F.lit(False)).unionByName(wave.withColumn("_new", F.lit(True)))
            met = find_pairs(known, g, threshold, cross=True)
            led = rewritten(met.groupBy(*g, F.col("b").alias("_rep")).agg(F.min("a").alias("_leader")))
            out.append(led)
            rest = rewritten(wave.join(led.select(*g, "_rep"), [*g, "_rep"], "left_anti").select(*reps.columns))
        pairs = rewritten(find_pairs(rest, g, threshold))
        absorbed = rewritten(absorbed_titles(pairs, g))
        as_a = absorbed.select(*g, F.col("b").alias("a"))
        to_leader = pairs.join(absorbed, [*g, "b"], "left_semi").join(as_a, [*g, "a"], "left_anti")
        out.append(rewritten(to_leader.groupBy(*g, F.col("b").alias("_rep")).agg(F.min("a").alias("_leader"))))
        rest = rest.join(absorbed.select(*g, F.col("b").alias("_rep")), [*g, "_rep"], "left_anti").select(*reps.columns)
        leaders = rewritten(rest if leaders is None else leaders.unionByName(rest))
    return functools.reduce(DataFrame.unionByName, out)


# Edges of a group that are decided in one task.
EDGES = 1 << 21


def absorbed_titles(pairs: DataFrame, group_cols=()) -> DataFrame:
    """(group, b) of the titles that an earlier leader absorbs: b of an edge (a, b), a < b, whose a isn't absorbed.

    Edges are taken in windows of b, about ``EDGES`` of a group, in order; in a window each group is one pass over its edges,
    without those of titles that are known to be absorbed.  So the number of rounds follows the number of edges, not the longest
    chain of decisions.  Only titles whose positions aren't numbers take a round per link of that chain.
    """
    g = list(group_cols) or ["_all"]
    edges = pairs.select(*(group_cols or [F.lit(0).alias("_all")]), "a", "b")
    if not isinstance(pairs.schema["b"].dataType, NumericType):
        return _absorbed_in_rounds(edges, g).select(*group_cols, "b")
    edges = rewritten(edges)
    most = edges.groupBy(*g).count().agg(F.max("count")).first()[0] or 0
    windows = math.ceil(most / EDGES)
    if windows > 1:
        cuts = edges.groupBy(*g).agg(F.percentile_approx(F.col("b").cast("double"), [i / windows for i in range(1, windows)]).alias("_cuts"))
        window = F.size(F.filter("_cuts", lambda c: c < F.col("b").cast("double")))
        edges = rewritten(edges.join(checked_broadcast(rewritten(cuts), 1 << 16), g).select(*g, "a", "b", window.alias("_window")), "_window")
    kind = {f.name: f.dataType.simpleString() for f in edges.schema.fields}
    schema, done = ", ".join(f"`{c}` {kind[c]}" for c in [*g, "b"]), None
    for i in range(windows):
        part = edges.where(F.col("_window") == i).drop("_window") if windows > 1 else edges
        if done is not None:
            part = part.join(done.withColumnRenamed("b", "a"), [*g, "a"], "left_anti")
        found = rewritten(part.select(*g, "a", "b").groupBy(*g).applyInArrow(_absorbed(g), schema))
        done = found if done is None else done.unionByName(found)
    return (edges.select(*g, "b").limit(0) if done is None else done).select(*group_cols, "b")


def _absorbed(g: list[str]):
    """The function that decides a group's window of edges, in the order of b."""

    def decide(part: pa.Table) -> pa.Table:
        ids, code = np.unique(np.concatenate([part["a"].to_numpy(), part["b"].to_numpy()]), return_inverse=True)
        a, b = code[: len(part)], code[len(part) :]
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        starts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        absorbed = np.zeros(len(ids), bool)
        for t, s, e in zip(b[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(b)]):
            absorbed[t] = not absorbed[a[s:e]].all()
        out = np.flatnonzero(absorbed)
        one = pa.array(np.zeros(len(out), np.int64))
        return pa.table({**{c: part[c].take(one) for c in g}, "b": pa.array(ids[out], part["b"].type)})

    return decide


def _absorbed_in_rounds(pairs: DataFrame, g: list[str]) -> DataFrame:
    """A title no open edge leads to is a leader; it absorbs its neighbours; edges
    to and from absorbed titles are closed.  Every round decides at least the
    earliest open title, and only open edges are read and written again."""
    open_edges, rounds = materialize(pairs.select(*g, "a", "b")), []
    while not open_edges.isEmpty():
        led = open_edges.select(*g, F.col("b").alias("a"))
        absorbed = materialize(open_edges.join(led, [*g, "a"], "left_anti").select(*g, "b").distinct())
        rounds.append(absorbed)
        as_a = absorbed.select(*g, F.col("b").alias("a"))
        open_edges = materialize(open_edges.join(absorbed, [*g, "b"], "left_anti").join(as_a, [*g, "a"], "left_anti"))
    return functools.reduce(DataFrame.unionByName, rounds, pairs.select(*g, "b").limit(0))


def fuzzy_dedup_scale(
    df: DataFrame,
    group_cols=(),
    threshold: float = 0.7,
    title: str = "title",
    content: str = "content",
    ord_col: str = "ord",
    find_pairs=_rep_pairs,
) -> DataFrame:
    """Greedy leader clustering without a bound on group size.

    Leader rule (equal to the greedy loop without leader replacement): a row
    is a leader when no earlier leader is similar to it.  Every other row joins
    its earliest similar leader; the survivor of a cluster is its first row with
    content, else its first row (M8), at the leader's position.  Only keys and
    positions take part; the rows of ``df`` meet their leader by ``ord_col``.
    ``find_pairs`` finds the similar titles: all of them, or those of ``minhash.rep_pairs``.
    """
    g = list(group_cols)
    members, reps = _norm_table(df, group_cols, title, ord_col)
    reps = materialize(reps)
    to_leader = _absorbing_leaders(reps, g, threshold, find_pairs)
    row_leader = members.join(to_leader, [*g, "_rep"], "left").select(
        *g, F.col("_ord").alias(ord_col), F.coalesce("_leader", "_rep").alias("_leader"))
    tagged = df.join(row_leader, [*g, ord_col])
    out = survivor_by_key(tagged, [*g, "_leader"], ord_col=ord_col, content=content)
    return out.drop("_leader")


def composite_dedup(df: DataFrame, group_cols=(), threshold: float = 0.7, strict: bool = True, content: str = "content") -> DataFrame:
    """D1 -> D2 -> D3 (scale mode, no bound on group size)."""
    return fuzzy_dedup_scale(exact_dedup(df, group_cols, strict, content=content), group_cols, threshold, content=content)


def keyed_last_wins(earlier: DataFrame, later: DataFrame, key: str = "id", pos_col: str = "pos") -> DataFrame:
    """Union by key; values from the later input, position from the first.

    ``pos_col`` orders the union (earlier rows first); output keeps one row per key.
    """
    cols = earlier.columns
    e = earlier.withColumn("_prec", F.lit(0))
    l_ = later.select(*cols).withColumn("_prec", F.lit(1))
    u = e.unionByName(l_)
    agg = u.groupBy(key).agg(
        F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct("_prec", pos_col)).alias("_v"),
        F.min(F.struct("_prec", pos_col)).alias("_first"),
    )
    return agg.select(*[F.col("_v")[c].alias(c) for c in cols if c != pos_col],
                      F.col("_first")["_prec"].alias("_src"), F.col("_first")[pos_col].alias(pos_col))
