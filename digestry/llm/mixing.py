"""Mixing sources to target weights by weighted fair queueing.

Every document of a shuffled source gets a virtual finish time: the source's words up to and
including the document, divided by the source's target.  Up to ``MAX_COPIES`` passes over a source
queue one behind the other.  All (document, pass) entries are then sorted globally by finish time,
in ranges, and the queue is cut where its words would pass the total budget.  DataFrame
expressions only.

Shuffle order: the MD5 of the document id, so reruns agree.  No window ever spans a whole source:
a source's order is cut into hash ranges whose sums are added up first.  Since each source's taken
entries are a prefix of its own queue, the outcome is one cut per source (whole passes plus the
last key of the partial pass), which is applied to documents without moving their text.

Defined results: a null text has size 0 and takes 0; a null source is a source of its own, sorted
last; a source without words has target 0; rows equal in (doc_id, source, size) are taken together;
an empty table gives an empty result.  Other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from digestry import session
from digestry.llm.common import WORD, read, registry, word_count, written

QUERIES, ORACLE, register = registry()

MAX_COPIES = 3  # no document is taken more often
WEIGHTS = 3  # sources weigh 1, 2, ... WEIGHTS, repeating
ROWS_PER_RANGE = 1024  # about so many queue entries are sorted together
MOST_RANGES = 1 << 16  # sums per range are added up in one task; beyond, the ranges grow instead
SLOTS_TOGETHER = 1024  # slots of finish times whose sums are added up together; a source far larger than its target spreads over very many
SMALL_SOURCES = 100_000  # per-source rows (a name and a few numbers) that may be broadcast


def order_key(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")))


def queue_sizes(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Narrow rows: doc_id, source, size, key."""
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), order_key(F.col(id_col)).alias("key")
    )


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row per source: src (its rank), source, source_size, target, budget.

    The targets share the budget (all words) by weight; one that reaches ``MAX_COPIES`` times its
    source stops there and its excess goes to the others.  In order of (limit / weight) the stopped
    sources come first, so one pass over the sources finds them.  The windows without partitions
    run over these aggregated rows, one per source.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("src", F.row_number().over(by_name)).withColumn("weight", (F.pmod(F.col("src") - 1, F.lit(WEIGHTS)) + 1).cast("long"))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("budget", F.sum("source_size").over(everything)).withColumn("limit", F.col("source_size") * MAX_COPIES)
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), "src")
    before = F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    weights_on = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("stopped", F.col("limit") * weights_on <= (F.col("budget") - before) * F.col("weight"))
    rest = F.col("budget") - F.sum(F.when(F.col("stopped"), F.col("limit")).otherwise(0)).over(everything)
    open_weight = F.sum(F.when(F.col("stopped"), 0).otherwise(F.col("weight"))).over(everything)
    share = F.try_divide((F.col("weight") * rest).cast("double"), open_weight.cast("double"))
    s = s.withColumn("target", F.when(F.col("stopped"), F.col("limit").cast("double")).otherwise(share))
    return s.select("src", "source", "source_size", "n_docs", "target", "budget")


def _range(key: Column, ranges: int) -> Column:
    return F.shiftright(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * ranges, 32)


def _before(words: str, window) -> Column:
    return F.coalesce(F.sum(words).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))


def source_cuts(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per source: passes (whole passes taken) and last_key, last_size of the partial pass.

    ``sizes`` and ``sources`` should be written tables: they are read more than once.
    """
    n = sources.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    ranges = min(MOST_RANGES, max(1, n // ROWS_PER_RANGE))
    src = session.checked_broadcast(sources.withColumnRenamed("source", "its_source"), SMALL_SOURCES)
    q = sizes.join(src, F.col("source").eqNullSafe(F.col("its_source"))).select("src", "key", "size", "source_size", "target", "budget")
    # rows equal in key and size are taken together: one entry, however many ids are null or repeated
    q = q.filter(F.col("target") > 0).groupBy("src", "key", "size", "source_size", "target", "budget").agg(F.sum("size").alias("words"))
    q = q.withColumn("range", _range(F.col("key"), ranges))

    # words before each hash range of a source, from sums per range
    sums = q.groupBy("src", "range").agg(F.sum("words").alias("words"))
    ahead = Window.partitionBy("src").orderBy("range")
    sums = sums.select("src", "range", _before("words", ahead).alias("ahead"))
    inside = Window.partitionBy("src", "range").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    q = q.withColumn("inside", F.sum("words").over(inside)).join(sums, ["src", "range"])
    q = q.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(MAX_COPIES - 1))))
    q = q.withColumn("finish", (F.col("pass") * F.col("source_size") + F.col("ahead") + F.col("inside")).cast("double") / F.col("target"))

    # global sort by finish time: value ranges, their sums first, in two levels, then a running sum in each range
    entry = F.col("words").alias("entry")
    q = q.select("src", "pass", "key", "size", entry, "finish", "budget", F.floor(F.col("finish") * ranges).alias("slot"))
    slots = q.groupBy("slot").agg(F.sum("entry").alias("words")).withColumn("group", F.floor(F.col("slot") / SLOTS_TOGETHER))
    groups = slots.groupBy("group").agg(F.sum("words").alias("words"))
    groups = groups.select("group", _before("words", Window.orderBy("group")).alias("base"))
    slots = slots.withColumn("start", _before("words", Window.partitionBy("group").orderBy("slot"))).join(groups, "group")
    slots = slots.select("slot", (F.col("base") + F.col("start")).alias("start"))
    running = Window.partitionBy("slot").orderBy("finish", "src", "pass", "key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = q.withColumn("upto", F.sum("entry").over(running)).join(slots, "slot").filter(F.col("start") + F.col("upto") <= F.col("budget"))
    last = taken.groupBy("src").agg(F.max(F.struct("pass", "key", "size")).alias("last"))
    return last.select("src", F.col("last.pass").alias("passes"), F.col("last.key").alias("last_key"), F.col("last.size").alias("last_size"))


def copies(key: Column, size: Column) -> Column:
    """How often the mix takes a document, given its source's cut."""
    upto_last = (key < F.col("last_key")) | ((key == F.col("last_key")) & (size <= F.col("last_size")))
    return F.when(F.col("passes").isNull(), 0).otherwise(F.col("passes") + upto_last.cast("int")).cast("long")


def mixture(sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(targets and cuts per source, to broadcast if few) for written ``sizes``."""
    sources = written(source_targets(sizes), narrow=True)
    cuts = written(sources.join(source_cuts(sizes, sources), "src", "left"), narrow=True)
    return sources, session.checked_broadcast(cuts.withColumnRenamed("source", "its_source"), SMALL_SOURCES)


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it, columns unchanged.

    The text is read twice (sizes, then the cut) and never shuffled.
    """
    sizes = written(queue_sizes(docs), narrow=True)
    _, cuts = mixture(sizes)
    cols = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"))
    cuts = cuts.select(F.col("its_source"), "passes", "last_key", "last_size")
    met = inner.join(cuts, F.col("row.source").eqNullSafe(F.col("its_source")))
    n = copies(order_key(F.col("row.doc_id")), word_count(F.col("row.text")))
    met = met.withColumn("n", n).filter("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return met.select(*[F.col(f"row.`{c}`").alias(c) for c in cols])


_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '{WORD}')) END AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS src, sum(source_size) OVER () AS budget, {MAX_COPIES} * source_size AS lim FROM s0),
s2 AS (SELECT *, (src - 1) % {WEIGHTS} + 1 AS weight FROM s1),
s3 AS (SELECT *, lim * sum(weight) OVER (ORDER BY lim / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
                 <= (budget - coalesce(sum(lim) OVER (ORDER BY lim / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS stopped FROM s2),
s4 AS (SELECT *, budget - sum(CASE WHEN stopped THEN lim ELSE 0 END) OVER () AS rest, sum(CASE WHEN stopped THEN 0 ELSE weight END) OVER () AS w FROM s3),
s5 AS (SELECT src, source, source_size, budget, CASE WHEN stopped THEN CAST(lim AS DOUBLE) ELSE CAST(weight * rest AS DOUBLE) / CAST(w AS DOUBLE) END AS target FROM s4),
q0 AS (SELECT s5.*, d.doc_id, d.size, d.key, sum(size) OVER (PARTITION BY src ORDER BY key, size) AS upto FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source),
q1 AS (SELECT q0.*, p.pass, CAST(p.pass * source_size + upto AS DOUBLE) / target AS finish FROM q0, (SELECT unnest(range({MAX_COPIES})) AS pass) p WHERE target > 0),
q2 AS (SELECT *, sum(size) OVER (ORDER BY finish, src, pass, key, size) AS total FROM q1),
t AS (SELECT src, key, size, count(DISTINCT pass) AS copies FROM q2 WHERE total <= budget GROUP BY src, key, size)
SELECT q0.doc_id, q0.size, q0.source_size, q0.target, CAST(q0.size * coalesce(t.copies, 0) AS BIGINT) AS taken
FROM q0 LEFT JOIN t ON t.src = q0.src AND t.key = q0.key AND t.size = q0.size
"""


@register("op8_mix_sources", _SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = written(queue_sizes(read(spark, sf_dir, "documents")), narrow=True)
    _, cuts = mixture(sizes)
    met = sizes.join(cuts, F.col("source").eqNullSafe(F.col("its_source")))
    return met.select("doc_id", "size", "source_size", "target", (F.col("size") * copies(F.col("key"), F.col("size"))).alias("taken"))
