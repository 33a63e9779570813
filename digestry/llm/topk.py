"""Exact top-k search by columnar branch and bound.

Vectors become integers, floor(256 x).  A task holds its candidates in vertical layout (one row per
dimension) and takes the queries of a round from a broadcast.  Products are accumulated block by
block of dimensions; after each block, what the rest of a candidate can still add is at most the
product of both remaining norms (Cauchy-Schwarz), and candidates whose bound lies below the
query's k-th best score so far are compacted away.  Scores of the survivors are complete, so the
result is exact.  Each task returns k rows per query, merged by a ranked window.

Queries are a stated set and go in rounds of ``ROUND_BYTES``, however many there are, so what a
broadcast or a task holds is bounded, and a task multiplies ``PRODUCTS`` pairs at once; candidates are read once per
round and never shuffled.  Each round's result is written before the next one begins.

Defined results: vectors that are null or hold null or non-finite components (256 times the component counts)
take no part, nor do rows without id; other columns are not looked at, whatever their names;
vectors of different length don't meet; repeated (id, vector) rows count once as a query and each as
a candidate; a query's own id is never its candidate.  Sums beyond 2**53 are computed with unbounded integers; a score beyond
64 bits raises.  Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from digestry.llm.common import read, registry, written

QUERIES, ORACLE, register = registry()

SCALE = 256
DIMS = 16  # dimensions in a block
CHUNK = 4096  # candidates in vertical layout at once
ROUND_BYTES = 16 << 20  # integers of the queries of one round
PRODUCTS = 4 << 20  # first products (queries x candidates) that a task holds at once


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vector of the rows that take part."""
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * SCALE) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vector"))
    return rows.filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & whole)


def _by_length(batch) -> list:
    """[(ids, matrix of integers as floats)] of an Arrow batch of id, vector, one per vector length."""
    import numpy as np
    import pyarrow.compute as pc

    ids, lists = batch.column(0), batch.column(1)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    out = []
    for size in np.unique(sizes):
        some = np.nonzero(sizes == size)[0]
        flat = lists.take(some).flatten().to_numpy(zero_copy_only=False)
        out.append((ids.take(some).to_numpy(zero_copy_only=False), np.floor(SCALE * flat.reshape(len(some), int(size)))))
    return out


class Queries:
    """Queries of one vector length with their best k so far."""

    def __init__(self, ids, matrix, k: int):
        import numpy as np

        self.ids, self.matrix, self.k = ids, matrix, k
        self.top = [(np.empty(0, matrix.dtype), np.empty(0, np.int64)) for _ in ids]
        self.rest = _rest_norms(matrix)
        self.largest = float(np.abs(matrix).max(initial=0))

    def meet(self, ids, matrix) -> None:
        import numpy as np

        dims = matrix.shape[1]
        if self.largest * float(np.abs(matrix).max(initial=0)) * max(1, dims) >= 2**53:
            exact = [[int(x) for x in row] for row in matrix]
            for q, query in enumerate(self.matrix):
                scores = np.array([sum(int(a) * b for a, b in zip(query, row, strict=True)) for row in exact], dtype=object)
                self._merge(q, scores, ids)
            return
        columns, rest = np.ascontiguousarray(matrix.T), _rest_norms(matrix)
        step = max(1, PRODUCTS // max(1, len(ids)))
        for at in range(0, len(self.ids), step):
            first = self.matrix[at : at + step, :DIMS] @ columns[:DIMS]
            for q, partial in enumerate(first, at):
                self._search(q, partial, columns, rest, ids)

    def _search(self, q: int, partial, columns, rest, ids) -> None:
        import numpy as np

        query, floor = self.matrix[q], self._floor(q)
        if floor is None and len(ids) > 4 * self.k:
            # k candidates that begin well, scored in full, give a first lower bound
            seeds = np.argpartition(partial, -self.k - 1)[-self.k - 1 :]
            seeds = seeds[ids[seeds] != self.ids[q]][: self.k]
            floor = np.min(query @ columns[:, seeds]) if len(seeds) == self.k else None
        alive = np.arange(len(ids))
        for block, at in enumerate(range(DIMS, len(query) + DIMS, DIMS)):
            if floor is not None:
                # one more than the bound covers the rounding of the norms
                reach = partial + self.rest[q, block + 1] * rest[alive, block + 1] * (1 + 1e-9) + 1
                keep = reach >= floor
                alive, partial = alive[keep], partial[keep]
            if at < len(query):
                partial = partial + query[at : at + DIMS] @ columns[at : at + DIMS, alive]
        self._merge(q, partial, ids[alive])

    def _floor(self, q: int):
        scores = self.top[q][0]
        return scores[-1] if len(scores) == self.k else None

    def _merge(self, q: int, scores, ids) -> None:
        import numpy as np

        other = ids != self.ids[q]
        scores, ids = np.concatenate([self.top[q][0], scores[other]]), np.concatenate([self.top[q][1], ids[other]])
        if scores.dtype == object:
            best = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[: self.k]
        else:
            best = np.lexsort((ids, -scores))[: self.k]
        self.top[q] = scores[best], ids[best]

    def rows(self):
        for query, (scores, ids) in zip(self.ids, self.top, strict=True):
            for score, i in zip(scores, ids, strict=True):
                yield int(query), int(i), int(score)


def _rest_norms(matrix):
    """Norm of what is left of each vector from block b on; one column per block, and a last one of zeros."""
    import numpy as np

    n, dims = matrix.shape
    blocks = -(-dims // DIMS)
    out = np.zeros((n, blocks + 2))
    for b in range(blocks - 1, -1, -1):
        out[:, b] = out[:, b + 1] + np.square(matrix[:, b * DIMS : (b + 1) * DIMS]).sum(1)
    return np.sqrt(out)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), id_col, score: for each row of ``queries`` its k best rows of ``vectors``."""
    spark = vectors.sparkSession
    candidates = usable(vectors, id_col, vec_col)
    asked = written(usable(queries, id_col, vec_col).distinct())
    size = asked.agg(F.coalesce(F.sum(8 * F.size("vector") + 64), F.lit(0))).first()[0]
    rounds = -(-size // ROUND_BYTES)
    found = spark.createDataFrame([], FOUND)
    for r in range(rounds):
        found = found.union(_round(spark, candidates, asked.filter(F.pmod(F.xxhash64("id"), F.lit(rounds)) == r), k))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


FOUND = "query_id long, id long, score long"


def _round(spark: SparkSession, candidates: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The best k per query and task of one round's queries, which are bounded by ``ROUND_BYTES``; written before the
    next round's queries are read, so one round's at most are on the driver or broadcast."""
    batches = asked.toArrow().combine_chunks().to_batches()
    shared = spark.sparkContext.broadcast([x for b in batches for x in _by_length(b)])

    def run(arriving):
        import numpy as np
        import pyarrow as pa

        waiting: dict[int, list] = {}
        for ids, matrix in shared.value:
            waiting.setdefault(matrix.shape[1], []).append((ids, matrix))
        asked = {n: Queries(np.concatenate([a for a, _ in x]), np.concatenate([m for _, m in x]), k) for n, x in waiting.items()}
        for batch in arriving:
            for at in range(0, batch.num_rows, CHUNK):
                for ids, matrix in _by_length(batch.slice(at, CHUNK)):
                    if matrix.shape[1] in asked:
                        asked[matrix.shape[1]].meet(ids, matrix)
        for q in asked.values():
            found = list(q.rows())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["query_id", "id", "score"])

    found = written(candidates.mapInArrow(run, FOUND))
    shared.destroy()
    return found


K, EVERY = 5, 50

_SQL = f"""
WITH v AS (SELECT vec_id, [floor({SCALE} * CAST(x AS DOUBLE)) for x in embedding] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM p)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= {K}
"""


@register("op7_exact_top_k", _SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter(F.col("vec_id") % EVERY == 0), K)
