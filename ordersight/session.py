"""Session settings the plans rely on, and the folder for frames that are read several times."""

import tempfile

from pyspark.sql import SparkSession


#: Spark's own defaults only look at facts of 10 GB that meet dimensions of 10 MB.
RUNTIME_FILTERS = {
    "enabled": "true",
    "applicationSideScanSizeThreshold": "1g",
    "creationSideThreshold": "1g",
    "maxNumItems": "4000000",
    "maxNumBits": "67108864",
}

#: Shuffles are cut finely and joined up to parts of 8 MB, so that their number grows with the facts. A
#: task that sorts and groups 64 MB of compressed keys, Spark's default, needs gigabytes.
PARTITIONS = {
    "coalescePartitions.initialPartitionNum": "1000",
    "advisoryPartitionSizeInBytes": "8m",
}


def tune(spark: SparkSession) -> SparkSession:
    """Turn on the runtime re-planning the plans count on.

    Joins that carry rows of a hot key (row-level audits) are split by AQE; forcing the
    split also covers joins whose partitioning a later aggregate would have reused.

    Where a fact of at least a gigabyte meets a filtered dimension (one city), a Bloom filter of the kept keys,
    of 8 MB at most, reduces the fact in its scan, before the first shuffle.
    """
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    for name, value in PARTITIONS.items():
        spark.conf.set(f"spark.sql.adaptive.{name}", value)
    for name, value in RUNTIME_FILTERS.items():
        spark.conf.set(f"spark.sql.optimizer.runtime.bloomFilter.{name}", value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the checkpoint folder the cluster names; pick a scratch one only where none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="ordersight-checkpoint-")
    context.setCheckpointDir(named)
