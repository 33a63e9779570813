"""Whitening of embeddings by a bidiagonal qd solver.

Vectors become integers, floor(256 x).  The fit list has each distinct vector once.  Tasks centre their rows with the
exact sums, (n x - S) / n, and reduce them to a triangular factor by blockwise QR; the factors are merged
``FAN`` at a time until one is left, whose squares are those of the centred list.  ``bidiagonal_qd`` makes it
bidiagonal, finds the singular values by dqds and the directions by twisted factorisations.  All rows are then
projected in tasks.

What is in one place is bounded by the length d of the vectors, not by their number: a factor is d x d, and a task
works on ``CELLS`` numbers at once.  Copies collapse within their task before the fit list is shuffled.

Defined results: vectors that are null, hold null or non-finite entries, or entries whose 256-fold doesn't fit a long take no
part; vectors of different length are whitened apart, each length by its own fit list (``identity_error`` is then one value per length); repeated rows and null ids
are kept as rows; components without variance (a fit list of one vector, directions at rounding level) are left out; of equal
eigenvalues any orthonormal directions are given; a deviation of more than 38 digits is null; other columns, whatever their names, take no part; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from digestry.llm.common import join_split, read, registry, written

QUERIES, ORACLE, register = registry()

SCALE = 256
COMPONENTS = 4
FAN = 16  # triangular factors merged by one task
CELLS = 1 << 21  # numbers that a task reduces or projects at once
SAFE = 2**62  # below it, products and sums stay in 64 bits


def integers(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, x, dims of the rows that take part."""
    whole = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * SCALE) < float(2**63)))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vector"))
    rows = rows.filter(F.coalesce(F.col("vector").isNotNull() & whole, F.lit(False)))
    x = F.transform("vector", lambda c: F.floor(c * SCALE).cast("long"))
    return rows.select("id", x.alias("x"), F.size("vector").alias("dims"))


def _matrices(batch, dims, x):
    """(length, row numbers, matrix) of the rows of an Arrow batch, at most ``CELLS`` numbers each."""
    import numpy as np

    sizes = batch.column(dims).to_numpy(zero_copy_only=False)
    lists = batch.column(x)
    for d in np.unique(sizes):
        rows = np.nonzero(sizes == d)[0]
        step = max(1, CELLS // max(1, int(d)))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            yield int(d), some, lists.take(some).flatten().to_numpy(zero_copy_only=False).reshape(len(some), int(d))


def _largest(m) -> int:
    return max(int(m.max(initial=0)), -int(m.min(initial=0)))


def _sums(m) -> list[int]:
    if _largest(m) * len(m) < SAFE:
        return m.sum(0).tolist()
    return [sum(column) for column in m.T.tolist()]


def list_sums(fit: DataFrame) -> DataFrame:
    """dims, size, sums (decimal integers, comma-joined) of the vectors of each length."""

    def run(batches):
        import pyarrow as pa

        held: dict[int, list] = {}
        for batch in batches:
            for d, _, m in _matrices(batch, 0, 1):
                n, sums = held.get(d, (0, [0] * d))
                held[d] = n + len(m), [a + b for a, b in zip(sums, _sums(m), strict=True)]
        dims = list(held)
        yield pa.RecordBatch.from_arrays([
            pa.array(dims, pa.int32()), pa.array([held[d][0] for d in dims], pa.int64()),
            pa.array([[str(s) for s in held[d][1]] for d in dims], pa.list_(pa.string()))], names=["dims", "size", "sums"])

    parts = fit.select("dims", "x").mapInArrow(run, "dims int, size long, sums array<string>")
    each = parts.select("dims", "size", F.posexplode("sums").alias("pos", "part"))
    each = each.groupBy("dims", "pos").agg(F.sum("size").alias("size"), F.sum(F.col("part").cast("decimal(38,0)")).alias("s"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda p: p["s"].cast("string"))
    return each.groupBy("dims").agg(F.first("size").alias("size"), F.array_join(ordered, ",").alias("sums"))


def _offsets(m, size: int, sums: str):
    """size * x - S of each row, exact (Python integers where 64 bits don't do)."""
    import numpy as np

    s = [int(v) for v in sums.split(",")]
    if size * _largest(m) + max(map(abs, s)) < SAFE:
        return m * size - np.array(s, np.int64)
    return m.astype(object) * size - np.array(s, object)


def _packed(r, d: int) -> bytes:
    import numpy as np

    out = np.zeros((d, d))
    out[: len(r)] = r
    return out.tobytes()


def triangular_factors(fit: DataFrame) -> DataFrame:
    """dims, part, factor: per task and length the triangular factor of its centred rows."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        held: dict = {}
        for batch in batches:
            for d, rows, m in _matrices(batch, 0, 1):
                size, sums = batch.column(2)[rows[0]].as_py(), batch.column(3)[rows[0]].as_py()
                centred = (_offsets(m, size, sums) / size).astype(np.float64)
                held[d] = np.linalg.qr(np.vstack([held[d], centred]) if d in held else centred, mode="r")
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([
            pa.array(list(held), pa.int32()), pa.array([part] * len(held), pa.int32()),
            pa.array([_packed(r, d) for d, r in held.items()], pa.binary())], names=["dims", "part", "factor"])

    return fit.select("dims", "x", "size", "sums").mapInArrow(run, "dims int, part int, factor binary")


def merge_factors(factors: DataFrame) -> DataFrame:
    """One factor per length."""

    def stack(key, group):
        import numpy as np
        import pandas as pd

        d = int(key[0])
        r = np.linalg.qr(np.vstack([np.frombuffer(f).reshape(d, d) for f in group["factor"]]), mode="r")
        return pd.DataFrame({"dims": [d], "part": [int(key[1])], "factor": [_packed(r, d)]})

    factors = written(factors)
    while (factors.agg(F.max("part")).first()[0] or 0) > 0:
        nearer = factors.withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
        factors = written(nearer.groupBy("dims", "part").applyInPandas(stack, "dims int, part int, factor binary"))
    return factors.select("dims", "factor")


def solve(factors: DataFrame, components: int) -> DataFrame:
    """dims, squares, shares, directions (flat, one component after the other)."""

    def run(frames):
        import numpy as np
        import pandas as pd
        from digestry.llm.bidiagonal_qd import leading

        for frame in frames:
            out = {"dims": [], "squares": [], "shares": [], "directions": []}
            for d, packed in zip(frame["dims"], frame["factor"], strict=True):
                r = np.frombuffer(packed).reshape(d, d)
                squares, directions = leading(r, components)
                scale = float(np.abs(r).max(initial=0)) or 1.0
                total = float(np.square(r / scale).sum())
                out["dims"].append(d)
                out["squares"].append(squares.tolist())
                out["shares"].append([float(s) / scale / scale / total for s in squares])
                out["directions"].append(directions.ravel().tolist())
            yield pd.DataFrame(out)

    return factors.mapInPandas(run, "dims int, squares array<double>, shares array<double>, directions array<double>")


def _projected(batch):
    """(row numbers, offsets, whitened rows, shares) of an Arrow batch of dims, x, size, sums, squares, shares, directions."""
    import numpy as np

    for d, rows, m in _matrices(batch, 0, 1):
        size, sums, squares, shares, directions = [batch.column(c)[rows[0]].as_py() for c in range(2, 7)]
        offsets = _offsets(m, size, sums)
        spread = np.sqrt(np.array(squares) / size)
        centred = (offsets / size).astype(np.float64)
        yield d, rows, offsets, (centred @ np.array(directions).reshape(len(squares), d).T) / spread, shares


_MODEL = ["size", "sums", "squares", "shares", "directions"]


def identity_errors(fit: DataFrame) -> DataFrame:
    """dims, identity_error: how far the covariance of the whitened fit list is from the identity."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held: dict = {}
        for batch in batches:
            for d, _, _, white, _ in _projected(batch):
                held[d] = held.get(d, 0) + np.concatenate([[len(white)], white.sum(0), (white.T @ white).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))], names=["dims", "sums"])

    def compare(frames):
        import numpy as np
        import pandas as pd

        for frame in frames:
            errors = []
            for sums in frame["sums"]:
                k = round((-1 + (4 * len(sums) - 3) ** 0.5) / 2)  # 1 + k + k * k sums
                n, mean = sums[0], np.array(sums[1 : k + 1]) / sums[0]
                errors.append(float(np.abs(np.reshape(sums[k + 1 :], (k, k)) / n - np.outer(mean, mean) - np.eye(k)).max(initial=0)))
            yield pd.DataFrame({"dims": frame["dims"], "identity_error": errors})

    parts = fit.select("dims", "x", *_MODEL).mapInArrow(run, "dims int, sums array<double>")
    each = parts.select("dims", F.posexplode("sums").alias("pos", "v")).groupBy("dims", "pos").agg(F.sum("v").alias("v"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda p: p["v"])
    return each.groupBy("dims").agg(ordered.alias("sums")).mapInPandas(compare, "dims int, identity_error double")


ROWS = "id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def project(rows: DataFrame) -> DataFrame:
    """One row per vector and component."""

    def run(batches):
        from decimal import Decimal

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids, errors = batch.column(7), batch.column(8)
            for d, at, offsets, white, shares in _projected(batch):
                n, k = len(at), len(shares)
                if _largest(offsets) ** 2 * d < SAFE:
                    deviation = pa.array((offsets * offsets).sum(1)).cast(pa.decimal128(38, 0))
                else:
                    exact = [sum(v * v for v in row) for row in offsets.tolist()]
                    deviation = pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))
                again = np.repeat(np.arange(n), k)
                size = batch.column(2)[at[0]].as_py()
                yield pa.RecordBatch.from_arrays([
                    ids.take(at[again]), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, size)), deviation.take(again),
                    pa.array(white.ravel()), pa.array(np.tile(np.array(shares, np.float64), n)), errors.take(at[again])],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("dims", "x", *_MODEL, "id", "identity_error").mapInArrow(run, ROWS)


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id_col, component (from 1), n, deviation, whitened, explained, identity_error."""
    rows = integers(vectors, id_col, vec_col)
    fit = written(rows.select("dims", "x").distinct())
    sums = written(list_sums(fit).withColumn("n", F.col("size")))
    total = fit.count()
    factors = merge_factors(triangular_factors(join_split(fit, sums, "dims", total)))
    model = written(sums.join(solve(factors, components), "dims"))
    model = written(model.join(identity_errors(join_split(fit, model, "dims", total)), "dims"))
    counts = rows.groupBy("dims").agg(F.count(F.lit(1)).alias("n"))
    known = written(counts.join(model.drop("n"), "dims"))
    all_rows = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return project(join_split(rows, known, "dims", all_rows)).withColumnRenamed("id", id_col)


@register("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's deviation is a long: null where 64 bits don't hold it (``whiten`` gives 38 digits)."""
    rows = whiten(read(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
