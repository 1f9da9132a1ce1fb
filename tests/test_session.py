from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from ordersight.session import ensure_checkpoint_dir, tune


def fake_session(master, current=None, named=None):
    chosen = []
    context = SimpleNamespace(
        master=master,
        getCheckpointDir=lambda: current,
        setCheckpointDir=chosen.append,
    )
    conf = SimpleNamespace(get=lambda name, default=None: named or default)
    return SimpleNamespace(sparkContext=context, conf=conf), chosen


def test_the_named_checkpoint_folder_is_used():
    session, chosen = fake_session("yarn", named="hdfs:///shared")
    ensure_checkpoint_dir(session)
    assert chosen == ["hdfs:///shared"]


def test_a_folder_already_set_is_kept():
    session, chosen = fake_session("yarn", current="hdfs:///set", named="hdfs:///other")
    ensure_checkpoint_dir(session)
    assert chosen == []


def test_a_cluster_without_a_shared_folder_is_refused():
    session, chosen = fake_session("k8s://host")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(session)
    assert chosen == []


def test_local_mode_makes_a_scratch_folder():
    session, chosen = fake_session("local[4]")
    ensure_checkpoint_dir(session)
    assert len(chosen) == 1


def test_tune_switches_skew_handling_on(spark):
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    tune(spark)
    assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"


def test_tuned_shuffles_are_read_in_small_parts(spark):
    """Also where the session has few shuffle partitions: what one task holds stays the same as facts grow."""
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    keys = spark.range(6_000_000).select(F.xxhash64("id").alias("k"))
    groups = keys.groupBy("k").count().withColumn("part", F.spark_partition_id())
    assert groups.select("part").distinct().count() > 4
