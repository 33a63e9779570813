"""D3, J6 approximately: similar titles by MinHash with banding.

For titles too many for the exact join.  A Dice coefficient of t is a Jaccard similarity of t / (2 - t)
(0.538 for 0.7).  A title has ``bands`` keys, each of ``rows`` minima of its bigrams under different hashes;
titles that share a key are candidates, and every candidate is verified with the Dice coefficient, so what
is found is right and only recall is approximate: a pair at the threshold is met with probability 1 - (1 - j^rows)^bands,
0.94 for 32 bands of 4, and one of Jaccard 0.7 with 0.9998.  A title has the same number of keys whatever its length, and
keys don't depend on the other titles, so no gram frequencies are counted.

Titles meet in the cells of ``title_blocks`` (of any size, a title being in one per ``BLOCK`` titles of its group): keys are
compared there, and candidates verified there, so neither keys nor candidates are shuffled.

Defined results: as ``dedup.similar_pairs``; titles without bigrams have no keys (they are similar to equal ones only).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from digestry.functions import text as T
from digestry.operators import dedup, title_blocks
from digestry.session import materialize, spread

BANDS = 32
ROWS = 4


# Candidates that are looked at together, and the titles of admissible sizes that are looked at in the time of one.
AT_ONCE, COST = 1 << 19, 16


def with_keys(reps: DataFrame, group_cols=(), bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``reps`` with ``_keys``, the ``bands`` keys of each title that has bigrams."""
    g = list(group_cols)
    hashed = F.transform(T.bigrams(F.col("_norm")), lambda x: F.xxhash64(x))

    def least(number):
        return F.array_min(F.transform("_hashed", lambda x: F.xxhash64(x, number)))

    def key(band):
        return F.xxhash64(*g, band, *[least(band * rows + r) for r in range(rows)])

    titles = spread(reps.where(F.length("_norm") > 1).select("*", hashed.alias("_hashed")))
    return titles.withColumn("_keys", F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), key)).drop("_hashed")


def _by_key(threshold: float, bands: int):
    """As ``title_blocks.by_size``, of the titles that share a key: each pair at the first one that it shares.

    Where so many titles share keys that all of admissible sizes are looked at faster, those are, and pairs without a common
    key are dropped: the pairs are the same."""
    similar = title_blocks.by_size(threshold)
    t, most = threshold, title_blocks.apart_at_most(threshold)

    def verified(cell, keys, band: int, a: np.ndarray, b: np.ndarray):
        size = cell.n[a] + cell.n[b]
        apart = np.bitwise_count(cell.folded[0][a] ^ cell.folded[0][b])
        for f in cell.folded[1:]:
            apart += np.bitwise_count(f[a] ^ f[b])
        near = np.flatnonzero(apart <= most[size])
        a, b = a[near], b[near]
        dice = np.bitwise_count(cell.words[a] & cell.words[b]).sum(axis=1, dtype=np.int64) * 2.0 / size[near]
        hit = np.flatnonzero(dice >= t)
        hit = hit[~(keys[a[hit], :band] == keys[b[hit], :band]).any(axis=1)]
        return a[hit], b[hit], dice[hit]

    def pairs(cell, table: pa.Table, a: np.ndarray, b: np.ndarray, whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        keys = pc.list_flatten(table["_keys"]).to_numpy().reshape(-1, bands)

        def runs(band: int):
            """Titles of one key, whose hash holds the group, stand together."""
            order = b[np.argsort(keys[b, band], kind="stable")]
            left = order if whole else a
            starts = np.arange(1, len(b) + 1) if whole else np.searchsorted(keys[order, band], keys[left, band], "left")
            return order, left, starts, np.searchsorted(keys[order, band], keys[left, band], "right") - starts

        _, _, first, last = title_blocks.in_reach(cell, t, a, b, whole)
        if COST * sum(int(runs(band)[3].sum()) for band in range(bands)) > np.maximum(last - first, 0).sum():
            for x, y, dice in similar(cell, table, a, b, whole):
                hit = (keys[x] == keys[y]).any(axis=1)
                if hit.any():
                    yield x[hit], y[hit], dice[hit]
            return
        for band in range(bands):
            order, left, starts, many = runs(band)
            some = np.flatnonzero(many > 0)
            left, starts, many = left[some], starts[some], many[some]
            ends = np.cumsum(many)
            for at in range(0, int(ends[-1]) if len(ends) else 0, AT_ONCE):
                place = np.arange(at, min(at + AT_ONCE, int(ends[-1])))
                of = np.searchsorted(ends, place, "right")
                found = verified(cell, keys, band, left[of], order[starts[of] + place - (ends - many)[of]])
                if len(found[0]):
                    yield found

    return pairs


def rep_pairs(reps: DataFrame, group_cols=(), threshold: float = 0.7, keep_dice: bool = False, bands: int = BANDS, rows: int = ROWS,
              cross: bool = False, titles: bool = True) -> DataFrame:
    """As ``dedup._rep_pairs``, from shared band keys."""
    keyed = with_keys(reps, group_cols, bands, rows)
    found = title_blocks.similar_titles(keyed, group_cols, threshold, keep_dice and titles, cross, _by_key(float(threshold), bands), ("_keys",))
    return found if keep_dice else found.drop("dice")


def similar_pairs(df: DataFrame, group_cols=(), threshold: float = 0.7, title: str = "title", ord_col: str = "ord",
                  bands: int = BANDS, rows: int = ROWS, titles: bool = True) -> DataFrame:
    """The pairs of ``dedup.similar_pairs`` that share a band key, in the same columns."""
    reps = materialize(dedup._norm_table(df, group_cols, title, ord_col)[1])
    return dedup._as_pairs(rep_pairs(reps, group_cols, threshold, True, bands, rows, titles=titles), group_cols, titles)
