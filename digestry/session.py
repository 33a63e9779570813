"""Session helpers: configuration the operators rely on, and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings every job of this library assumes.  All of them are
# session-level and may be set on a running session.
RUNTIME_CONF = {
    # Instants are formatted and compared in UTC (the reference stores UTC text).
    "spark.sql.session.timeZone": "UTC",
    # Adaptive execution: coalesce small shuffle partitions, split skewed ones,
    # turn sort-merge joins into broadcast joins when a side proves small.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # JSON with a repeated key keeps the last value, as in the reference's parser.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; give the session a checkpoint folder if it has none."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    On a cluster this is a shared folder and is never replaced; without one the
    job fails here.  Only a session of one process (tests, the local bench)
    that has no setting gets a scratch folder.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001  (Spark Connect: no SparkContext; the server's setting applies)
        sc = None
    current = (sc.getCheckpointDir() if sc is not None else None) or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if sc is not None and not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if sc is not None and sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="digestry-ckpt-")
    if sc is not None:
        sc.setCheckpointDir(local)
        return sc.getCheckpointDir() or local
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "digestry") -> SparkSession:
    """Session for tests and the local bench (the UI stays off)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("DIGESTRY_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a scan that has fewer partitions than the cluster has cores.

    A parquet file is split by row group; a file of one row group is read by
    one task however large it is.  Text-heavy projections (keyword scoring)
    after such a scan would run on one core, so the rows are spread first.
    A scan that already has enough splits (the normal case at scale) is
    returned unchanged: no shuffle is added there.
    """
    try:
        parallelism = df.sparkSession.sparkContext.defaultParallelism
        partitions = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001  (no RDD view, e.g. Spark Connect: leave the scan as it is)
        return df
    if partitions < parallelism:
        return df.repartition(parallelism)
    return df


# What a checked broadcast may hold at most.
MAX_BROADCAST_BYTES = 64 << 20


def checked_broadcast(df: DataFrame, max_rows: int, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint for a dimension table whose rows and bytes are checked first.

    Above ``max_rows`` rows, or ``max_bytes`` bytes of their JSON text, the table
    is returned without the hint, so the join falls back to a shuffle join
    (and adaptive execution may still pick a broadcast when runtime
    statistics prove the side small).
    """
    from pyspark.sql import functions as F

    size = F.octet_length(F.to_json(F.struct("*"))) if df.columns else F.lit(0)
    rows, used = df.select(size.alias("_bytes")).limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum("_bytes"), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and used <= max_bytes else df


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (in ``spark.checkpoint.dir``) computed once.

    ``Dataset.checkpoint`` runs its lineage for the eager action and again to
    write the checkpoint files unless the data is persisted; persisting
    (memory and disk) around the checkpoint avoids the second run.  The
    returned DataFrame reads the checkpoint files, so it survives the loss
    of executors and its lineage is cut.
    """
    checkpoint_dir(df.sparkSession)
    df.persist()
    try:
        out = df.checkpoint(eager=True)
    finally:
        df.unpersist()
    return out


# How texts to be parsed are written: files are split by bytes, which only measure the work when they aren't compressed.
PLAIN_TEXTS = {"parquet.block.size": 8 << 20, "compression": "none", "parquet.enable.dictionary": "false"}


def rewritten(df: DataFrame, *folders: str, options: dict | None = None) -> DataFrame:
    """``df`` written once as Parquet into the checkpoint folder and read back; ``folders`` are columns with a folder per value,
    ``options`` those of the writer.

    For loops that join a table with itself round after round: a checkpoint keeps the size estimated for its plan, and
    estimates of joins multiply, so after a dozen rounds planning alone takes minutes; a table has the size of its files.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/round-{uuid.uuid4().hex}"
    out = df.write.options(**(options or {}))
    (out.partitionBy(*folders) if folders else out).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
