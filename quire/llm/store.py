"""Tables that are written between jobs, in the folder that the cluster shares."""

from __future__ import annotations

import gc
import tempfile
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one where that is unset and Spark has one machine, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that all of them share")
        at = f"file://{tempfile.gettempdir()}/quire-shared"
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage and outlives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder through the Hadoop file system."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def trim(spark: SparkSession) -> bool:
    """Has the driver's JVM give its freed native memory back to the system; whether that JVM can (17.0.9 and later, on glibc).

    Its allocator keeps what threads have freed, some 230 MB after a pipeline, which no collection returns.
    """
    jvm, array, of = spark._jvm, spark.sparkContext._gateway.new_array, spark._jvm.java.lang.Class.forName
    kinds, args = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
    for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = of(kind)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    args[2], args[3] = array(jvm.java.lang.Object, 0), array(jvm.java.lang.String, 0)
    try:
        # By the interface's method: the server's own class isn't open to callers.
        of("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        return False
    return True


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of jobs whose results are written and whose frames are gone.

    They go when the driver collects its garbage, which it may not do for long;
    a job of several phases asks for it between them, so that disks hold the
    files of one phase. Freed memory of Arrow and of the driver's JVM goes back to the system, too.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark._jvm.System.gc()
    trim(spark)
