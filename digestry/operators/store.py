"""Article, health and delivery tables.

Tables are parquet folders written as a new version on every change (no
in-place MERGE on parquet).  Every operator is a pure DataFrame function;
``write_version`` / ``read_latest`` persist the result.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from digestry.functions import dates as D
from digestry.functions import text as T
from digestry.session import checked_broadcast, materialize

# Stored-article schema; columns added later get defaults on read (K7).
ARTICLE_SCHEMA = StructType([
    StructField("id", StringType(), False),
    StructField("title", StringType(), False),
    StructField("url", StringType(), False),
    StructField("source", StringType(), False),
    StructField("content", StringType(), True),
    StructField("summary", StringType(), True),
    StructField("category", StringType(), True),
    StructField("published_at", StringType(), True),
    StructField("score", LongType(), True),
    StructField("digest_date", StringType(), False),
    StructField("delivered", IntegerType(), True),
])
ARTICLE_COLUMNS = [f.name for f in ARTICLE_SCHEMA.fields]
UPDATABLE = ("title", "summary", "category", "score")
# Additive schema evolution: column -> default for rows written before it existed.
ARTICLE_DEFAULTS = {"delivered": 0}


def to_stored(df: DataFrame, digest_date: str | None = None, keep=()) -> DataFrame:
    """Falsy conversions of an insert: content/summary/published_at '' -> null,
    category '' -> Uncategorized, score null/0 -> 0, delivered -> 0."""
    dd = F.lit(digest_date) if digest_date is not None else F.col("digest_date")
    cols = set(df.columns)

    def col(name):
        return F.col(name) if name in cols else F.lit(None)

    return df.select(
        F.col("id"), F.col("title"), F.col("url"), F.col("source"),
        F.nullif(col("content").cast("string"), F.lit("")).alias("content"),
        F.nullif(col("summary").cast("string"), F.lit("")).alias("summary"),
        T.falsy_or(col("category").cast("string"), F.lit(T.UNCATEGORIZED)).alias("category"),
        F.nullif(col("published_at").cast("string"), F.lit("")).alias("published_at"),
        F.coalesce(col("score").cast("bigint"), F.lit(0).cast("bigint")).alias("score"),
        dd.cast("string").alias("digest_date"),
        F.coalesce(col("delivered").cast("int"), F.lit(0)).alias("delivered"),
        *[F.col(c) for c in keep],
    )


# A run's new keys and updates are broadcast up to this many rows (and session.MAX_BROADCAST_BYTES).
MAX_BROADCAST_NEW_ROWS = 2_000_000


def upsert(stored: DataFrame, new: DataFrame, order_col: str = "pos", extra_cols=(), key_cols=("id",)) -> DataFrame:
    """Insert new keys; on an existing key update only title, summary,
    category and score.  Within ``new``, a repeated key takes the last row's
    updatable values and the first row's other values (``order_col`` order).
    ``new`` must already be in stored form (``to_stored``) plus ``order_col``.

    The key is the id, with the group columns in front of it when several
    digests share a table (two tenants may select one article).  The stored
    table is streamed through a left join with the new keys and their four
    updatable values, broadcast if rows and bytes are few; content is never
    broadcast, and the stored table is then never shuffled.
    """
    keys = list(key_cols)
    all_cols = [*ARTICLE_COLUMNS, *[c for c in extra_cols if c not in ARTICLE_COLUMNS]]
    fixed = [c for c in all_cols if c not in UPDATABLE and c not in keys]
    n = new.groupBy(*keys).agg(
        F.max_by(F.struct(*[F.col(c) for c in UPDATABLE]), F.col(order_col)).alias("_last"),
        F.min_by(F.struct(*[F.col(c) for c in fixed]), F.col(order_col)).alias("_first"),
    ).select(*keys, *[F.col("_last")[c].alias(c) for c in UPDATABLE], *[F.col("_first")[c].alias(c) for c in fixed])
    updates = n.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.struct(*UPDATABLE).alias("_new"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = stored.select(*all_cols).join(checked_broadcast(updates, MAX_BROADCAST_NEW_ROWS), same, "left")
    updated = joined.select(*[
        F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in UPDATABLE else F.col(c) for c in all_cols])
    known = stored.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    new_keys = checked_broadcast(n.select(*keys), MAX_BROADCAST_NEW_ROWS)
    known = known.join(new_keys, same, "left_semi").distinct()
    return updated.unionByName(n.join(known, same, "left_anti").select(*all_cols))


def mark_delivered(stored: DataFrame, delivered: DataFrame, any_channel_ok=True, key_cols=("id",)) -> DataFrame:
    """delivered = 1 for the given keys, if at least one channel succeeded.

    ``key_cols`` is the table's key: the group columns and the id where several digests share the
    table, since one digest's delivery says nothing about another's copy of the article."""
    if any_channel_ok is False:
        return stored
    keys = [F.col(k).alias(f"_k{i}") for i, k in enumerate(key_cols)]
    hits = delivered.select(*keys).distinct().withColumn("_hit", F.lit(1))
    same = F.lit(True)
    for i, k in enumerate(key_cols):
        same = same & stored[k].eqNullSafe(F.col(f"_k{i}"))
    # a digest's keys are few: broadcast them (count-checked) and stream the table
    j = stored.join(checked_broadcast(hits, MAX_BROADCAST_NEW_ROWS), same, "left")
    gate = F.lit(True) if any_channel_ok is True else any_channel_ok
    marked = F.when(F.col("_hit").isNotNull() & gate, F.lit(1)).otherwise(F.col("delivered"))
    return j.withColumn("delivered", marked).drop("_hit", *[f"_k{i}" for i in range(len(key_cols))])


def delivery_ledger(items: DataFrame, group_cols=(), digest_col: str = "digest") -> DataFrame:
    """What each digest holds: (group, digest, id), once each.  Written before delivery, it outlives the run."""
    return items.select(*group_cols, digest_col, "id").distinct()


def committed(ledger: DataFrame, outcomes: DataFrame, group_cols=(), digest_col: str = "digest") -> DataFrame:
    """M9 -> K2: the ledger's rows of digests that at least one channel took.

    ``outcomes`` has one row per group, digest and channel, with its status; a digest without any row isn't committed."""
    keys = [*group_cols, digest_col]
    taken = outcomes.where(F.col("status") == "ok").select(*[F.col(k).alias(f"_c{i}") for i, k in enumerate(keys)]).distinct()
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & ledger[k].eqNullSafe(F.col(f"_c{i}"))
    return ledger.join(checked_broadcast(taken, MAX_BROADCAST_NEW_ROWS), same, "left_semi")


def commit_deliveries(stored: DataFrame, ledger: DataFrame, outcomes: DataFrame, group_cols=(), digest_col: str = "digest") -> DataFrame:
    """K2 behind its gate: only articles of committed digests, in their own group, become delivered."""
    return mark_delivered(stored, committed(ledger, outcomes, group_cols, digest_col), key_cols=(*group_cols, "id"))


def high_water_mark(stored: DataFrame, strict: bool = True) -> DataFrame:
    """M1: one row ``hwm``: MAX(COALESCE(published_at, digest_date)).

    Strict mode compares the text (as the reference's SQL does); default mode
    compares instants.
    """
    if strict:
        return stored.agg(F.max(F.coalesce(F.col("published_at"), F.col("digest_date"))).alias("hwm"))
    ts = F.coalesce(D.parse_instant(F.col("published_at")), F.to_timestamp(F.col("digest_date")))
    return stored.agg(D.to_iso(F.max(ts)).alias("hwm"))


def incremental_filter(new: DataFrame, hwm: str | None) -> DataFrame:
    """keep rows without a date; keep dated rows strictly newer than the
    mark; no mark -> keep all; an unparsable date is dropped.

    ``hwm`` is the scalar of ``high_water_mark`` (one row, read once).  Where
    the rows carry the parsed instant in ``published_ts``, it is compared with
    a timestamp literal, a predicate that a scan of stored rows can use to
    skip row groups; otherwise the text is parsed row by row.
    """
    return new.where(newer_than(new.sparkSession, hwm, new.columns)) if hwm else new


def newer_than(spark: SparkSession, hwm: str | None, columns):
    """The condition of ``incremental_filter`` on rows with these columns; a run that filters batch by batch makes it once."""
    if not hwm:
        return F.lit(True)
    missing = F.coalesce(F.col("published_at"), F.lit("")) == ""
    if "published_ts" in columns:
        at = spark.range(1).select(D.parse_instant(F.lit(hwm)).cast("string")).first()[0]
        return F.col("published_ts").isNull() & missing | (F.col("published_ts") > F.lit(at).cast("timestamp"))
    return missing | F.coalesce(D.parse_instant(F.col("published_at")) > D.parse_instant(F.lit(hwm)), F.lit(False))


def read_mark(stored: DataFrame, strict: bool = True) -> str | None:
    """M1 as a scalar: a single aggregated row is read to the driver."""
    row = high_water_mark(stored, strict).first()
    return row["hwm"] if row else None


def source_marks(stored: DataFrame, strict: bool = False) -> DataFrame:
    """M1 per source: (source, hwm)."""
    if strict:
        return stored.groupBy("source").agg(F.max(F.coalesce(F.col("published_at"), F.col("digest_date"))).alias("hwm"))
    ts = F.coalesce(D.parse_instant(F.col("published_at")), F.to_timestamp(F.col("digest_date")))
    return stored.groupBy("source").agg(D.to_iso(F.max(ts)).alias("hwm"))


def merge_marks(*marks: DataFrame) -> DataFrame:
    """The later mark of each source."""
    out = marks[0].select("source", "hwm")
    for more in marks[1:]:
        out = out.unionByName(more.select("source", "hwm"))
    return out.groupBy("source").agg(F.max("hwm").alias("hwm"))


def incremental_filter_by_source(new: DataFrame, marks: DataFrame) -> DataFrame:
    """F2 with one mark per source, so a source that comes late keeps its items.

    The rules are those of ``incremental_filter``; a source without a mark keeps all.  The marks, one row per source, are
    broadcast if few (checked), and the items are streamed past them."""
    at = D.parse_instant(F.col("hwm"))
    own = marks.where(F.coalesce(F.col("hwm"), F.lit("")) != "").select(F.col("source").alias("_source"), at.alias("_mark"))
    met = new.join(checked_broadcast(own, MAX_BROADCAST_NEW_ROWS), new["source"].eqNullSafe(F.col("_source")), "left")
    when = F.col("published_ts") if "published_ts" in new.columns else D.parse_instant(F.col("published_at"))
    missing = F.coalesce(F.col("published_at"), F.lit("")) == ""
    newer = F.coalesce(when > F.col("_mark"), F.lit(False))
    return met.where(F.col("_source").isNull() | missing | newer).drop("_source", "_mark")


def latest_per_source(health: DataFrame) -> DataFrame:
    """The latest health row per source (ties: highest id)."""
    return health.groupBy("source").agg(
        F.max_by(F.struct(*[F.col(c) for c in health.columns if c != "source"]), F.struct("last_check", "id")).alias("_l")
    ).select("source", "_l.*")


def cooldown_filter(sources: DataFrame, health: DataFrame, as_of, minutes: float, force: bool = False,
                    source_key: str = "id") -> DataFrame:
    """Drop a source whose latest check is less than ``minutes`` old.

    Never checked -> kept; error checks count; ``force`` keeps all.  The
    health side is first reduced to one row per source (W1), so the join is
    one row per source on both sides.
    """
    if force:
        return sources
    latest = latest_per_source(health).select(F.col("source").alias("_src"), F.col("last_check").alias("_last"))
    j = sources.join(latest, sources[source_key] == F.col("_src"), "left")
    age = D.minutes_between(D.as_of_literal(as_of), F.col("_last"))
    return j.where(F.col("_last").isNull() | (age >= F.lit(float(minutes)))).drop("_src", "_last")


def write_payloads(payloads: DataFrame, path: str) -> str:
    """The raw payload table with a folder per ``source_id``."""
    payloads.write.mode("append").partitionBy("source_id").parquet(path)
    return path


def active_payloads(payloads: DataFrame, sources: DataFrame, health: DataFrame, as_of, minutes: float, force: bool = False) -> DataFrame:
    """F1 at the scan: the payloads of sources that aren't cooling down.

    ``payloads`` is read from ``write_payloads``' folders.  The ages of all sources' checks are written first, one row each;
    those that are old enough, broadcast if a check finds them few, are then a dynamic partition filter: the files of
    a cooled source aren't read."""
    if force:
        return payloads
    latest = latest_per_source(health).select(F.col("source").alias("id"), F.col("last_check").alias("_last"))
    age = F.coalesce(D.minutes_between(D.as_of_literal(as_of), F.col("_last")), F.lit(float("inf")))
    ages = materialize(sources.select("id").distinct().join(latest, "id", "left").select(F.col("id").alias("source_id"), age.alias("_age")))
    active = ages.where(F.col("_age") >= F.lit(float(minutes))).select("source_id")
    return payloads.join(checked_broadcast(active, MAX_BROADCAST_NEW_ROWS), "source_id", "left_semi")


def health_records(items: DataFrame, envelopes: DataFrame | None = None) -> DataFrame:
    """M5: items found per source with status (one row per parsed source)."""
    counts = items.groupBy("source").agg(F.count("*").cast("int").alias("items_found"))
    if envelopes is None:
        return counts.withColumn("status", F.lit("ok")).withColumn("error_message", F.lit(None).cast("string"))
    e = envelopes.select("source", "status", F.col("error").alias("error_message"))
    return e.join(counts, "source", "left").select(
        "source", "status", F.coalesce("items_found", F.lit(0)).alias("items_found"), "error_message"
    )


def append_health(records: DataFrame, path: str, as_of, run_id: str | None = None) -> None:
    """K3: append one row per source per run, partitioned by check date.

    A run with an id has a folder of its own, which a retry replaces, so its rows are there once."""
    ts = D.as_of_literal(as_of)
    rows = records.withColumn("last_check", ts).withColumn("check_date", F.to_date(ts))
    if run_id is None:
        rows.write.mode("append").partitionBy("check_date").parquet(path)
    else:
        rows.write.mode("overwrite").partitionBy("check_date").parquet(f"{path.rstrip('/')}/run={run_id}")


def pending(stored: DataFrame, threshold: float, as_of, hours: int = 24, strict: bool = True) -> DataFrame:
    """score >= t, not delivered, with a summary, and published after the
    cutoff or digested after the cutoff date (strict: text comparison)."""
    cut = D.cutoff_instant(as_of, hours)
    base = (F.col("score") >= F.lit(float(threshold))) & (F.col("delivered") == 0) & F.col("summary").isNotNull()
    if strict:
        recent = (F.col("published_at") > D.to_iso(cut)) | (F.col("digest_date") > F.date_format(cut, "yyyy-MM-dd"))
    else:
        recent = (D.parse_instant(F.col("published_at")) > cut) | (F.to_date(F.col("digest_date")) > F.to_date(cut))
    return stored.where(base & F.coalesce(recent, F.lit(False)))


def with_defaults(df: DataFrame, defaults: dict = ARTICLE_DEFAULTS) -> DataFrame:
    """K7: columns added over time appear with their defaults on old rows."""
    for c, d in defaults.items():
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(d))) if c in df.columns else df.withColumn(c, F.lit(d))
    return df


def read_version(spark: SparkSession, root: str, version: int) -> DataFrame:
    """The table as of ``version``; columns it doesn't have yet get their defaults."""
    return with_defaults(spark.read.option("mergeSchema", "true").parquet(f"{root.rstrip('/')}/v={version:08d}"))


def latest_version(spark: SparkSession, root: str) -> int:
    """Number of the last version written at ``root``; 0 when there is none.

    Only the partition column is read, not the rows."""
    try:
        found = spark.read.parquet(root).select("v").agg(F.max("v")).first()
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return 0
    return int(found[0] or 0)


def read_latest(spark: SparkSession, root: str) -> DataFrame:
    """The current state of the table at ``root``: its last full snapshot."""
    return read_version(spark, root, latest_version(spark, root))


def write_version(df: DataFrame, root: str, version: int | None = None, replace: bool = False) -> int:
    """Write ``df`` as the next (or a given) full snapshot of the table at ``root``; returns its number.

    ``replace`` lets a retried run write its snapshot again."""
    version = latest_version(df.sparkSession, root) + 1 if version is None else version
    df.write.mode("overwrite" if replace else "errorifexists").parquet(f"{root.rstrip('/')}/v={version:08d}")
    return version


class BucketedTable:
    """K1 at scale: the article table in hash buckets of its key, of which a run rewrites only those it touches.

    ``data/v=N/bucket=B`` holds the rows of a bucket as of version N, ``manifest/v=N`` says for version N which folder each
    bucket is in.  The manifest is written last: a run that is stopped before leaves the table as it was, and its retry writes
    the same folders again.  Every version can be read as long as its folders are kept; readers of an older one aren't disturbed."""

    MANIFEST = "bucket int, at int, buckets int"

    def __init__(self, spark: SparkSession, root: str, key_cols=("id",), buckets: int = 256):
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), list(key_cols), buckets

    def _bucket(self):
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(self.buckets)).cast("int")

    def versions(self) -> int:
        return latest_version(self.spark, f"{self.root}/manifest")

    def _manifest(self, version: int) -> dict[int, int]:
        """Bucket -> version of its folder; at most one entry per bucket."""
        rows = self.spark.read.schema(self.MANIFEST).parquet(f"{self.root}/manifest/v={version:08d}").collect()
        if rows and rows[0].buckets != self.buckets:
            raise ValueError(f"the table at {self.root} has {rows[0].buckets} buckets")
        return {r.bucket: r["at"] for r in rows if r.bucket >= 0}

    def _rows(self, manifest: dict[int, int]) -> DataFrame | None:
        paths = [f"{self.root}/data/v={v:08d}/bucket={b}" for b, v in sorted(manifest.items())]
        if not paths:
            return None
        return self.spark.read.option("mergeSchema", "true").parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows as of a version (the last one by default), columns added later with their defaults."""
        rows = self._rows(self._manifest(self.versions() if version is None else version))
        return with_defaults(self.spark.createDataFrame([], ARTICLE_SCHEMA) if rows is None else rows)

    def _write(self, rows: DataFrame, version: int, before: dict[int, int], touched: list[int]) -> int:
        out = rows.withColumn("bucket", self._bucket())
        # one file per bucket
        out.repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/v={version:08d}")
        try:
            found = {r.bucket for r in self.spark.read.parquet(f"{self.root}/data/v={version:08d}").select(F.col("bucket").cast("int")).distinct().collect()}
        except AnalysisException as missing:  # no rows, so no files
            if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            found = set()
        manifest = {b: v for b, v in before.items() if b not in touched} | {b: version for b in found}
        # the entry without a bucket makes a version of an empty table one that is there
        entries = self.spark.createDataFrame([(b, v, self.buckets) for b, v in [(-1, version), *sorted(manifest.items())]], self.MANIFEST)
        entries.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/v={version:08d}")
        return version

    def create(self, rows: DataFrame) -> int:
        return self._write(rows, 1, {}, list(range(self.buckets)))

    def change(self, keys: DataFrame, fn) -> int:
        """Put ``fn(rows)`` in place of the rows of all buckets that hold one of ``keys``; returns the version."""
        version = self.versions()
        touched = [r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect()]  # at most one per bucket
        if not touched:
            return version
        manifest = self._manifest(version)
        rows = self._rows({b: v for b, v in manifest.items() if b in set(touched)})
        rows = with_defaults(rows if rows is not None else self.read(version).limit(0))
        return self._write(fn(rows), version + 1, manifest, touched)

    def upsert(self, new: DataFrame, order_col: str = "pos", extra_cols=()) -> int:
        """K1 on the buckets of the run's keys; ``new`` should be a written or checkpointed table."""

        def merged(rows: DataFrame) -> DataFrame:
            for c in (*self.keys, *extra_cols):  # a table without rows has no columns of its own yet
                if c not in rows.columns:
                    rows = rows.withColumn(c, F.lit(None).cast(new.schema[c].dataType))
            return upsert(rows, new, order_col, extra_cols, self.keys)

        return self.change(new, merged)

    def mark_delivered(self, delivered: DataFrame) -> int:
        """K2 on the buckets of the delivered keys."""
        return self.change(delivered, lambda rows: mark_delivered(rows, delivered, key_cols=self.keys))
