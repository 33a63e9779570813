from pyspark.sql import functions as F

from digestry.session import checked_broadcast, checkpoint_dir, materialize, spread


def test_checkpoint_dir_is_set(spark):
    assert checkpoint_dir(spark)


def test_materialize_keeps_rows_and_cuts_lineage(spark):
    df = spark.range(100).withColumn("y", F.col("id") * 2).where(F.col("id") % 3 == 0)
    m = materialize(df)
    assert sorted(r["y"] for r in m.collect()) == sorted(r["y"] for r in df.collect())
    plan = m._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan  # reads the checkpoint, not the original lineage


def test_checked_broadcast_respects_the_cap(spark):
    small = spark.range(5)
    big = spark.range(50)
    left = spark.range(1000)
    plan_small = left.join(checked_broadcast(small, 10), "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan_small
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan_big = left.join(checked_broadcast(big, 10), "id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" not in plan_big.split("AdaptiveSparkPlan")[-1] or "SortMergeJoin" in plan_big


def test_spread_only_widens_narrow_scans(spark):
    narrow = spark.range(100).coalesce(1)
    assert spread(narrow).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(0, 100, 1, spark.sparkContext.defaultParallelism)
    assert spread(wide).rdd.getNumPartitions() == wide.rdd.getNumPartitions()


def test_a_cluster_without_a_shared_folder_is_an_error():
    import pytest

    from digestry import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()  # noqa: N815

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())
