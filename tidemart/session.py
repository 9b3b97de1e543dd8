"""Session settings the mart relies on, and the shared folder for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# scratch folder per application, for one-machine sessions that name no shared folder
_LOCAL_DIRS: dict[str, str] = {}


def build(master: str | None = None, shuffle_partitions: int | None = None,
          time_zone: str = "UTC", extra: dict[str, str] | None = None) -> SparkSession:
    """A session for jobs started outside spark-submit; on a cluster leave `master` unset."""
    builder = (SparkSession.builder.appName("tidemart")
               # no call-site capture for each column expression; it slows down plan building
               .config("spark.python.sql.dataFrameDebugging.enabled", "false"))
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for name, value in (extra or {}).items():
        builder = builder.config(name, value)
    return configure(builder.getOrCreate(), time_zone)


def configure(spark: SparkSession, time_zone: str = "UTC") -> SparkSession:
    """Runtime settings only, so it also works on a session somebody else made.

    No join is hinted anywhere in the package: a dimension is broadcast when Spark's own size
    check (`autoBroadcastJoinThreshold`, on file sizes or on the sizes AQE has just measured)
    allows it, and otherwise joined by shuffle with hot partitions split.
    """
    conf = spark.conf
    conf.set("spark.sql.session.timeZone", time_zone)
    conf.set("spark.sql.adaptive.enabled", "true")
    conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # split a hot join partition even where the grouping after it then needs one more shuffle
    conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    # rows that lie by one of a join's keys stay where they are
    conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    # a task that writes a few partitions keeps a file of each open, and sorts only if there are more
    conf.set("spark.sql.maxConcurrentOutputFileWriters", "16")
    conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return spark


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _local_dir(spark)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def _local_dir(spark: SparkSession) -> str:
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="tidemart-")
    return _LOCAL_DIRS[context.applicationId]
