"""Spark helpers that every operator of this subpackage uses."""

from __future__ import annotations

import gc
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one shard (one Python group) holds, about.
SHARD_BYTES = 3 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, one in the warehouse."""
    jsc = spark.sparkContext._jsc.sc()
    found = jsc.getCheckpointDir()
    if found.isDefined():
        return found.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_tidebook"
        if named.startswith("file:") and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(named)
    return jsc.getCheckpointDir().get()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet under the shared folder and read it back: cuts the lineage, survives lost executors.

    The written folder is deleted when the session's JVM ends. Shuffle files that nothing refers to any more
    are released here rather than at the driver's next garbage collection.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() has written, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            where = spark._jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are no longer referred to, and the driver give back memory it doesn't use."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> str:
    """Let the C library of the driver's JVM give back what it keeps of freed memory (compilers, buffers: 200 MB after a few large plans).

    This is the JVM's own command System.trim_native_heap, called by its management bean; its answer, or nothing where it is not offered.
    """
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    kinds = ["javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"]
    classes = gateway.new_array(jvm.java.lang.Class, len(kinds))
    given = gateway.new_array(jvm.java.lang.Object, len(kinds))  # no arguments: the last two stay null
    try:
        for i, kind in enumerate(kinds):
            classes[i] = jvm.java.lang.Class.forName(kind)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        return jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", classes).invoke(server, given)
    except Py4JJavaError:  # other JVMs and systems
        return ""


def shard_count(docs: DataFrame, text: str = "text", shard_bytes: int = SHARD_BYTES) -> int:
    """Shards of about `shard_bytes` that all texts fill; 1 for an empty table."""
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return max(1, -(-int(total) // shard_bytes))
