"""Ranking, cuts and coverage (T1-T3, W3, W4, F3, F5; W2 is ``sources.payloads.encounter_ord``).

Per-group cuts use ``row_number() <= k``; Spark plans it with a
``WindowGroupLimit`` below the shuffle, so each map task forwards at most k
rows per group and a hot group is pruned before it is exchanged.  Ungrouped
cuts use ``orderBy().limit()`` (``TakeOrderedAndProject``), never a window
without a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from digestry.session import materialize


def top_k(df: DataFrame, k: int, order_cols: list[Column], group_cols=(), rank_col: str | None = "rank") -> DataFrame:
    """First k rows per group in ``order_cols`` order (stable through ``ord``)."""
    if group_cols:
        w = Window.partitionBy(*group_cols).orderBy(*order_cols)
        out = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
        return out.withColumnRenamed("_rn", rank_col) if rank_col else out.drop("_rn")
    limited = df.orderBy(*order_cols).limit(k)
    if not rank_col:
        return limited
    # at most k rows: the single-partition window below is bounded by k
    return limited.withColumn(rank_col, F.row_number().over(Window.orderBy(*order_cols)))


def signal_threshold(df: DataFrame, threshold: float, score_col: str = "final_score") -> DataFrame:
    """score >= threshold."""
    return df.where(F.col(score_col) >= F.lit(float(threshold)).cast("double"))


def select_top(df: DataFrame, threshold: float, n: int, group_cols=(), score_col: str = "final_score",
               order_col: str = "rank", out_rank: str = "sel_rank") -> DataFrame:
    """F3 + T3: threshold, then the first n by score desc, ties by prior order."""
    passed = signal_threshold(df, threshold, score_col)
    return top_k(passed, n, [F.col(score_col).desc(), F.col(order_col)], group_cols, out_rank)


def coverage_filter(df: DataFrame, matches_col: str = "matches", rank_col: str = "rank", group_cols=(),
                    limit: int | None = 25, out_rank: str = "cov_rank") -> DataFrame:
    """F5/W3 (+T2): topic coverage in rank order, as a window computation.

    The reference walks the ranked rows and drops a row whose non-empty match
    set is already covered by the rows kept before it.  A dropped row adds no
    keyword, so the covered set before row i is the union of all earlier match
    sets: row i is kept iff it has no matches or it is the first row of the
    group to match some keyword.  ``limit`` then keeps the first kept rows
    (T2).  Adds ``covered_by`` (the matches of a dropped row) on the dropped
    rows when ``limit`` is None.
    """
    g = list(group_cols)
    firsts = (
        df.select(*g, F.col(rank_col), F.explode(F.col(matches_col)).alias("_kw"))
        .groupBy(*g, "_kw")
        .agg(F.min(rank_col).alias(rank_col))
        .select(*g, rank_col)
        .distinct()
        .withColumn("_first", F.lit(True))
    )
    flagged = df.join(firsts, [*g, rank_col], "left")
    keep = (F.size(F.col(matches_col)) == 0) | F.col("_first").isNotNull()
    flagged = flagged.withColumn("kept", keep).drop("_first")
    if limit is None:
        return flagged.withColumn("covered_by", F.when(~F.col("kept"), F.col(matches_col)))
    kept = flagged.where(F.col("kept")).drop("kept")
    return top_k(kept, limit, [F.col(rank_col)], g, out_rank)


def batch_numbers(df: DataFrame, batch_size: int, order_col: str = "rank", group_cols=(), out_col: str = "batch") -> DataFrame:
    """Consecutive batches of ``batch_size`` in rank order (0-based) and the position inside.

    Applied to candidate sets (at most 25 rows per group); without group
    columns the window is one partition, so callers pass bounded inputs."""
    w = Window.partitionBy(*group_cols).orderBy(order_col) if group_cols else Window.orderBy(order_col)
    rn = F.row_number().over(w) - 1
    return df.withColumn(out_col, F.floor(rn / F.lit(batch_size)).cast("int")).withColumn(
        "batch_pos", (rn % F.lit(batch_size)).cast("int")
    )


def numbered(rows: DataFrame, group_cols, order_cols, pos: str = "pos", total: str = "total") -> DataFrame:
    """Position from 1 in each group, and the group's number of rows, without a task that holds a whole group.

    Rows are dealt into ranges of (group, order) and written once; each row's position is its place in its
    range plus the rows of its group in earlier ranges.  ``order_cols`` must tell a group's rows apart."""
    g, order = list(group_cols), list(order_cols)
    ranged = materialize(rows.repartitionByRange(*g, *order).withColumn("_range", F.spark_partition_id()))
    whole = Window.partitionBy(*[f"_g{i}" for i in range(len(g))])  # as many rows as a group has ranges
    before = whole.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(g)], F.col("_range").alias("_r")).agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn(total, F.sum("_n").over(whole))
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(g):
        same &= F.col(c).eqNullSafe(F.col(f"_g{i}"))
    placed = ranged.withColumn("_in", F.row_number().over(Window.partitionBy(*g, "_range").orderBy(*order))).join(counts, same)
    return placed.select(*rows.columns, (F.col("_before") + F.col("_in")).alias(pos), total)
