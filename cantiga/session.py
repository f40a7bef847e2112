"""Session settings the jobs rely on.

All of them are runtime settings, so they can be put on a session somebody
else created.  A value the cluster has already set is left alone.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

_RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    # Skewed joins are split at run time, also where the split costs one more
    # shuffle: a key holding a third of the rows must not end in one task.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # A join whose one side is at most this big in every shuffle partition is hashed: the other side,
    # which for lookups is all rows, need not be sorted.  Larger sides are merged as before.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    # ORDER BY + LIMIT merges at the driver; beyond this many rows it becomes
    # a distributed sort instead.
    "spark.sql.execution.topKSortFallbackThreshold": "100000",
    # Only the months present in the new data are replaced.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def tune(spark: SparkSession) -> SparkSession:
    """Put the settings above on ``spark`` and return it.

    A value somebody has set, at launch or on the running session, stays.
    """
    explicit = spark.sparkContext.getConf()
    chosen = spark.conf.getAll
    for key, value in _RUNTIME.items():
        if not explicit.contains(key) and key not in chosen:
            spark.conf.set(key, value)
    first = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if not (explicit.contains(first) or explicit.contains("spark.sql.shuffle.partitions")):
        # Shuffles start with enough partitions for every core; small ones are merged at run time.
        # Merging never raises the count: jobs on large tables call size_shuffles with their input.
        spark.conf.set(first, str(max(200, 3 * spark.sparkContext.defaultParallelism)))
    return spark


def size_shuffles(spark: SparkSession, *inputs: DataFrame, bytes_per_partition: int = 128 << 20) -> int:
    """Start shuffles with a partition per 128 MB of the inputs' estimated size, never with fewer than now."""
    size = sum(int(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) for frame in inputs)
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    now = int(spark.conf.get(key, spark.conf.get("spark.sql.shuffle.partitions")))
    count = max(now, -(-size // bytes_per_partition))
    spark.conf.set(key, str(count))
    return count


def local_session(cpus: int | str = "*", app: str = "cantiga") -> SparkSession:
    """A single-machine session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="cantiga-")


_GIVEN_OUT: list[tuple[SparkSession, str]] = []


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it lies."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system it would lie."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


@atexit.register
def _remove_given_out() -> None:
    for spark, path in _GIVEN_OUT:
        if spark.sparkContext._jsc is not None:
            remove_folder(spark, path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder the cluster shares between executors.

    What is written there is removed when the application ends; lazy results read it until then.
    The folder is ``spark.checkpoint.dir``.  Only a local master may fall back
    to a temporary folder: on a cluster the executors would not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder all executors share")
        root = _local_folder()
    path = os.path.join(root, f"{name}-{uuid.uuid4().hex}")
    _GIVEN_OUT.append((spark, path))
    return path
