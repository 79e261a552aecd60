"""Session settings and the shared folder for cut lineage and staged tables."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

# Settings the plans count on. AQE sizes partitions, turns a join into a broadcast one only when the measured side is
# under the broadcast threshold, and splits a hot join partition even if a later exchange has to be added for it.
PLAN_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # charsets of several bytes are those of the Java platform; bytes that a charset does not have become replacement characters
    "spark.sql.legacy.javaCharsets": "true",
    "spark.sql.legacy.codingErrorAction": "true",
    "spark.sql.session.timeZone": "UTC",
    # state of streams on local disk and in the checkpoint, not on the heap
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the plan settings to a running session."""
    for key, value in PLAN_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own; on a cluster the setting is required, because a
    folder of one machine is lost with that machine.
    """
    context = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_KEY, None) or context.getConf().get(CHECKPOINT_KEY)
    if named is None:
        named = context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder all executors share")
        named = tempfile.mkdtemp(prefix="sitesieve-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/sitesieve/{uuid.uuid4().hex}/{name}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts lineage in a way that survives lost executors, computes an expensive table once for several consumers, and
    gives the planner the real size of the table, so that later joins broadcast it only when it is small.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def buckets(spark: SparkSession) -> int:
    """Buckets of tables that are to meet: as many as the shuffle has partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed(df: DataFrame, name: str, key: str, n: int) -> DataFrame:
    """Write a table to the shared folder in ``n`` buckets by ``key``, each task its own files, and read it back.

    Nothing is shuffled: a task writes a file for each bucket it has rows of, so ``key`` should follow the order in which rows are stored. Tables
    with the same buckets join on the key without an exchange.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(n, key).option("path", new_path(spark, name)).saveAsTable(table)
    return spark.table(table)


def claim(spark: SparkSession, path: str) -> bool:
    """Create an empty file that must not exist yet; False when another writer was first. Creation is atomic in the file system of the path."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(where.getParent())
    if system.getScheme() == "file":
        # the local file system of Hadoop looks first and then creates
        local = jvm.java.io.File(where.toUri().getPath())
        return bool(local.createNewFile())
    try:
        system.create(where, False).close()
    except Py4JJavaError as error:
        if "AlreadyExists" not in error.java_exception.getClass().getName():
            raise
        return False
    return True
