"""Structured Streaming.

The reference's repeated run is a hand-made micro-batch with three pieces of
state: the high-water mark (M1), the per-source last check (W1) and the
stored articles.  Here one run drains the stream with
``trigger(availableNow=True)``:

* X5: the layer-1 score is a stateless projection on the stream (the same
  column functions as in batch);
* X2: exact dedup on the stream keeps the first arrival of a canonical url
  with ``dropDuplicatesWithinWatermark`` (state bounded by the watermark);
* X1/X3/X4: the mark and the health log are read once, when the run starts;
  every micro-batch only filters its items by them and writes the rest to its
  own folder, so a retried batch replaces its output.  When the stream is
  drained, the run's items are deduplicated, cut and selected once, and the
  mark moves on.  How many files a micro-batch holds changes nothing.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from digestry.functions import urls as U
from digestry.operators import dedup, keywords, rank, store
from digestry.plans.signal_digest import DigestRun, run_digest
from digestry.session import checkpoint_dir, rewritten


def scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage_files(df: DataFrame, path: str, partition_col: str) -> str:
    """Write a table as files partitioned by ``partition_col`` (the stream's input).

    The rows are first dealt by that column into pieces of about the size that a scan's task reads (large values are split, small
    ones kept together), so there are about as many files as values and pieces, not one per value and task."""
    df.hint("rebalance", partition_col).write.partitionBy(partition_col).parquet(path)
    return path


def file_stream(spark: SparkSession, path: str, schema, max_files: int = 4) -> DataFrame:
    """A parquet file stream reading at most ``max_files`` new files per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def streaming_layer1(stream: DataFrame, positive, negative) -> DataFrame:
    """M2 + S4 on a stream (stateless)."""
    return keywords.layer1_scores(stream, positive, negative)


def streaming_exact_dedup(stream: DataFrame, delay: str, group_cols=(), time_col: str = "published_ts") -> DataFrame:
    """First arrival per (group, canonical url) within the watermark.

    Differs from D1 on purpose: no content preference (a stream cannot wait
    for a later duplicate with content)."""
    keyed = stream.withColumn("url_key", U.canonical_url(F.col("url")))
    return keyed.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([*group_cols, "url_key"])


def drain(stream: DataFrame, sink: str, checkpoint: str, output_mode: str = "append") -> str:
    """Run a stream to completion (availableNow) into a parquet sink."""
    q = (stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .outputMode(output_mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return sink


def read_mark(spark: SparkSession, state_root: str, initial: str | None = None) -> str | None:
    """The mark of the last run that ended, else ``initial``."""
    try:
        found = spark.read.parquet(state_root).agg(F.max("mark").alias("mark")).first()["mark"]
    except AnalysisException as missing:  # no run has ended yet; any other failure is one
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        found = None
    return max([m for m in (found, initial) if m], default=None)


def delayed(mark: str | None, delay_minutes: float) -> str | None:
    """The mark moved back, so items that arrive up to ``delay_minutes`` late are still taken."""
    if not mark or not delay_minutes:
        return mark
    at = dt.datetime.fromisoformat(mark.replace("Z", "+00:00"))
    at = at.replace(tzinfo=at.tzinfo or dt.timezone.utc) - dt.timedelta(minutes=delay_minutes)
    return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"


class RunLedger:
    """Which steps of which runs are complete: one small file per run and step, written when the step's output is.

    A run's facts (its mark, time and the snapshot it starts from) are fixed by its first entry, so a run that was
    stopped is taken up with the same input, and every step writes to a place of its own that a retry replaces."""

    SCHEMA = "run_id string, step string, mark string, as_of string, base int, at timestamp"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def entries(self) -> list:
        """All entries; a run has five at most."""
        try:
            found = self.spark.read.schema(self.SCHEMA).option("recursiveFileLookup", "true").parquet(self.root)
            return found.orderBy("at").collect()
        except AnalysisException as missing:  # no run has begun yet; any other failure is one
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def _write(self, *row) -> None:
        run_id, step = row[:2]
        path = f"{self.root}/{run_id.encode().hex()}/{step}"
        entry = self.spark.createDataFrame([(*row, dt.datetime.now(dt.timezone.utc))], self.SCHEMA)
        entry.coalesce(1).write.mode("overwrite").parquet(path)

    def begin(self, run_id: str, mark: str | None, as_of: str | None, base: int | None):
        """The run's first entry: the given facts, or those it began with."""
        if (run_id, "begun") not in self.steps():
            self._write(run_id, "begun", mark, as_of, base)
        return next(e for e in self.entries() if (e.run_id, e.step) == (run_id, "begun"))

    def complete(self, run_id: str, step: str) -> None:
        self._write(run_id, step, None, None, None)

    def steps(self) -> set[tuple[str, str]]:
        return {(e.run_id, e.step) for e in self.entries()}

    def unfinished(self) -> list[str]:
        """Runs that began and didn't end, in their order."""
        entries = self.entries()
        ended = {e.run_id for e in entries if e.step == "ended"}
        return [e.run_id for e in entries if e.step == "begun" and e.run_id not in ended]


def _read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)  # there was nothing to drain


HEALTH_PART = "source string, status string, items_found long, error string"


def drain_new_items(stream: DataFrame, mark: str | None, run_root: str, checkpoint: str, health: DataFrame | None = None,
                    as_of: str | None = None, cooldown_minutes: float = 5.0, parse=None) -> DataFrame:
    """The stream's items that are newer than ``mark`` and whose
    source isn't cooling down, written to ``run_root/items/batch_id=N`` and read back.

    ``mark`` and ``health`` are those of the run's start, for all its batches.  Each batch also writes what it found of every
    source, before F2, to ``run_root/health/batch_id=N``: sources without new items were checked as well.  ``parse``
    (payloads -> items, envelopes; as ``payloads.fan_out``) makes the stream one of raw payloads with a ``source_id``, whose
    envelopes also report sources that failed or gave nothing."""
    spark, key = stream.sparkSession, "source" if parse is None else "source_id"
    schema = stream.schema if parse is None else parse(spark.createDataFrame([], stream.schema))[0].schema
    cooling = None
    if health is not None and as_of is not None:  # the log is read once: what is left of it are the sources that cool down
        checked = health.select(F.col("source").alias("id")).where("id IS NOT NULL").distinct()
        active = store.cooldown_filter(checked, health.select("id", "source", "last_check"), as_of, cooldown_minutes)
        cooling = rewritten(checked.join(active, "id", "left_anti"))
    newer = store.newer_than(spark, mark, schema.names)

    def run(batch: DataFrame, batch_id: int) -> None:
        if cooling is not None:
            # only the batch's own few sources meet the cooling ones, and only those are broadcast
            sources = batch.select(F.col(key).alias("id")).where("id IS NOT NULL").distinct()
            silent = F.broadcast(cooling.join(F.broadcast(sources), "id", "left_semi").select(F.col("id").alias(key)))
            batch = batch.where(F.col(key).isNotNull()).join(silent, key, "left_anti").select(*batch.columns)
        batch.persist()
        if parse is None:
            items, found = batch, batch.groupBy("source").agg(F.count("*").alias("items_found")).select(
                "source", F.lit("ok").alias("status"), "items_found", F.lit(None).cast("string").alias("error"))
        else:
            items, envelopes = parse(batch)
            found = envelopes.select("source", "status", F.col("items_found").cast("bigint").alias("items_found"), "error")
        found.write.mode("overwrite").parquet(f"{run_root}/health/batch_id={batch_id}")
        items.where(newer).select(*schema.names).write.mode("overwrite").parquet(f"{run_root}/items/batch_id={batch_id}")
        batch.unpersist()

    stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return _read_or_empty(spark, f"{run_root}/items", schema).select(*schema.names)


def drained_health(spark: SparkSession, run_root: str) -> DataFrame:
    """M5 of a drained run: one row per source that was checked, over all its batches and pages."""
    parts = _read_or_empty(spark, f"{run_root}/health", HEALTH_PART)
    failed = F.max(F.when(F.col("status") == "error", 1).otherwise(0)) == 1
    return parts.groupBy("source").agg(
        F.when(failed, F.lit("error")).otherwise(F.lit("ok")).alias("status"), F.sum("items_found").cast("int").alias("items_found"),
        F.min("error").alias("error_message"))


def _taken_up(ledger: RunLedger, run_id: str) -> list[str]:
    """The runs to complete, in order: those that were stopped, then this one."""
    return [*[r for r in ledger.unfinished() if r != run_id], run_id]


def advance_mark(selected: DataFrame, state_root: str, run_id: str) -> None:
    """The run's mark, its latest published_at; a run that selects nothing leaves the mark."""
    mark = selected.agg(F.max("published_at").alias("mark")).where(F.col("mark").isNotNull())
    mark.write.mode("overwrite").parquet(f"{state_root}/run={run_id}")


def incremental_digest(stream: DataFrame, positive, negative, initial_mark: str | None, run_id: str, out_root: str, state_root: str,
                       checkpoint: str, threshold: float, top_n: int, group_cols=(), health: DataFrame | None = None,
                       cooldown_minutes: float = 5.0, as_of: str | None = None, delay_minutes: float = 0.0) -> DataFrame:
    """X1 (+X3, X4): one digest selection per run: layer-1 scores, exact dedup,
    the top N per group, over all items the run drained.

    The selection is written to ``out_root/run=<run_id>`` and read back.  A run that was stopped is completed by the next call,
    whatever its id, with the mark it began with; calling a run that has ended again changes nothing."""
    g = list(group_cols)
    spark = stream.sparkSession
    ledger = RunLedger(spark, f"{state_root}-ledger")
    for run in _taken_up(ledger, run_id):
        facts = ledger.begin(run, delayed(read_mark(spark, state_root, initial_mark), delay_minutes), as_of, None)
        path = f"{out_root}/run={run}"
        if (run, "ended") not in ledger.steps():
            new = _drained(ledger, stream, facts, f"{out_root}-items/run={run}", checkpoint, health, cooldown_minutes)
            scored = keywords.layer1_scores(new, positive, negative)
            narrow = scored.withColumn("_empty", dedup.content_empty("content")).drop("content")
            uniq = dedup.exact_dedup(narrow, g, content="_empty")
            sel = rank.top_k(rank.signal_threshold(uniq, threshold, "layer1"), top_n, [F.col("layer1").desc(), F.col("ord")], g, "rank")
            sel.select(*g, "rank", "id", "title", "url", "published_at", "layer1").write.mode("overwrite").parquet(path)
            advance_mark(spark.read.parquet(path), state_root, run)
            ledger.complete(run, "ended")
    return spark.read.parquet(f"{out_root}/run={run_id}")


def _drained(ledger: RunLedger, stream: DataFrame, facts, run_root: str, checkpoint: str, health: DataFrame | None,
             cooldown_minutes: float, parse=None) -> DataFrame:
    """The run's items: what an earlier try drained, and what the stream still has if that one was stopped in between."""
    if (facts.run_id, "drained") not in ledger.steps():
        drain_new_items(stream, facts.mark, run_root, checkpoint, health, facts.as_of, cooldown_minutes, parse)
        ledger.complete(facts.run_id, "drained")
    schema = stream.schema if parse is None else parse(ledger.spark.createDataFrame([], stream.schema))[0].schema
    return _read_or_empty(ledger.spark, f"{run_root}/items", schema).select(*schema.names)


def incremental_run(stream: DataFrame, positive, negative, params, as_of: str, run_id: str, articles_root: str, state_root: str,
                    checkpoint: str, health_root: str | None = None, parse=None, **model) -> DigestRun:
    """X1 with the whole chain (Q0) over what the run drained, against stored state.

    The article table at ``articles_root`` (its last snapshot) gives the mark
    and takes the run's articles as its next snapshot; the health log at
    ``health_root`` silences sources that were just checked (X4) and gets one
    row per source of this run (M5, K3).  ``model`` holds ``run_digest``'s model inputs, ``parse`` is that of ``drain_new_items``.

    Runs are recoverable: the ledger under ``state_root`` says which steps (drained, stored, health, ended) are complete.  The next
    call completes a run that was stopped before it drains anything itself, from the mark, time and snapshot that run
    began with.  Runs of one table follow each other; they must not overlap."""
    spark = stream.sparkSession
    ledger = RunLedger(spark, f"{state_root}/ledger")
    for run in _taken_up(ledger, run_id):
        base = store.latest_version(spark, articles_root)
        stored = store.read_version(spark, articles_root, base) if base else None
        facts = ledger.begin(run, store.read_mark(stored, params.strict_reference) if stored is not None else None, as_of, base)
        stored = store.read_version(spark, articles_root, facts.base) if facts.base else None
        health = None
        if health_root is not None:
            try:
                health = spark.read.parquet(health_root).withColumn("id", F.monotonically_increasing_id())
            except AnalysisException as missing:
                if missing.getCondition() != "PATH_NOT_FOUND":
                    raise
        run_root = f"{state_root}/items/run={run}"
        new = _drained(ledger, stream, facts, run_root, checkpoint, health, params.cooldown_minutes, parse)
        out = run_digest(new, positive, negative, params, facts.as_of, stored=stored, **model)
        if (run, "stored") not in ledger.steps():
            store.write_version(out.stored, articles_root, facts.base + 1, replace=True)
            ledger.complete(run, "stored")
        if health_root is not None and (run, "health") not in ledger.steps():
            store.append_health(drained_health(spark, run_root), health_root, facts.as_of, run)
            ledger.complete(run, "health")
        if (run, "ended") not in ledger.steps():
            ledger.complete(run, "ended")
    return out
