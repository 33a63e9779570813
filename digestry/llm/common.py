"""Helpers shared by the operators: table access, written intermediate tables, word rules."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from digestry import session

#: A word is a run of anything but ASCII white space (space, \t \n \v \f \r).
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame, narrow: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet into the shared checkpoint folder and read it back.

    The folder is the session's ``spark.checkpoint.dir`` (a scratch folder only where that is
    unset, as in tests).  Unlike a cache, the rows survive the loss of executors, and they are
    computed once.  ``narrow`` rows (ids and numbers) are first dealt evenly to one file per core: a
    scan of texts has far more tasks than their sizes need files.
    """
    spark = df.sparkSession
    path = f"{session.checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    rows = df.repartition(max(2, spark.sparkContext.defaultParallelism)) if narrow else df
    rows.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words of a text as a long, by JVM expressions; null counts 0.

    Every word becomes one letter, and the letters are counted: linear in the text, and no array
    of words is built.
    """
    short = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return (F.length(short) - F.length(F.replace(short, F.lit("x"), F.lit("")))).cast("long")


def registry() -> tuple[dict[str, Callable], dict[str, str], Callable]:
    """(queries, oracles, decorator) of one module."""
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    oracles: dict[str, str] = {}

    def register(name: str, sql: str | None = None):
        def add(fn):
            queries[name] = fn
            if sql is not None:
                oracles[name] = sql
            return fn

        return add

    return queries, oracles, register


def map_texts(df: DataFrame, schema: str, make: Callable[[], Callable[..., dict]], rows: int = 256) -> DataFrame:
    """Arrow map over slices of at most ``rows`` rows.

    ``make()`` runs once per task and returns a function that takes the columns as Python lists
    and returns the output columns as lists.  Slices keep the Python copies of long texts few.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        import pyarrow as pa

        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = work(*[c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


#: A key holding more than one in ``HOT_SHARE`` of all rows is joined by broadcast: there are fewer such keys than this.
HOT_SHARE = 1000


def join_split(rows: DataFrame, by_key: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``by_key``, which has one row per key and, in ``n``, the number of rows with it.

    Rows of the few hot keys stay where they are and meet a broadcast of under ``HOT_SHARE`` rows;
    all others are shuffled, so no task gathers more than a small share of the rows.  ``rows`` and
    ``by_key`` should be written tables: both are read twice.
    """
    hot = F.broadcast(by_key.filter(F.col("n") > max(1, total // HOT_SHARE)))
    rest = rows.join(hot.select(key), key, "left_anti").join(by_key.drop("n"), key, how)
    return rows.join(hot.drop("n"), key).unionByName(rest)
