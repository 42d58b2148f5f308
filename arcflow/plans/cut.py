"""Cutting lineage in loops so that lost executors cost no more than one round."""

from __future__ import annotations

import tempfile
import time

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


#: Seconds between collections of the driver's garbage.
COLLECT_EVERY = 5
_collected = [time.monotonic()]
#: Rows of a few numbers for each task, at least, where `few` is told nothing else.
TASK_ROWS = 10_000


def trim_memory(spark: SparkSession) -> str:
    """Let the C library give back what the driver's JVM has freed: the JVM's own diagnostic command, through the interface that is open to all."""
    jvm, new_array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    given = new_array(jvm.Object, 4)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    return invoke.invoke(server, given)


def collect_garbage(spark: SparkSession, now: bool = False) -> None:
    """Let the driver drop what nothing refers to any more, if that was last done a while ago (or `now`): shuffle files, classes made for past plans
    and their metrics stay until its garbage is collected, which a half-empty heap may not be for as long as a loop runs.
    Many plans also leave the C library with memory that the JVM has freed (150 MB after two runs of `op4_neardup`); it is given back to the system."""
    if now or time.monotonic() - _collected[0] > COLLECT_EVERY:
        jvm = spark.sparkContext._jvm
        jvm.System.gc()
        try:
            trim_memory(spark)
        except (Py4JError, StopIteration):
            pass  # a JVM before 17.0.9, or not on Linux with glibc
        _collected[0] = time.monotonic()


def ensure_folder(spark: SparkSession) -> None:
    """Use the cluster's checkpoint folder; a local one only on a local master where none is set, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="arcflow-")
        context.setCheckpointDir(folder)


def few(df: DataFrame, rows: int, each: int = TASK_ROWS) -> DataFrame:
    """`df`, which has at most about so many `rows`, in no more partitions than one for `each` of them: small tables that are
    read again and again cost a task for each partition and reading, however few rows it has."""
    return df.coalesce(1 + rows // each)


def cut(df: DataFrame) -> DataFrame:
    """The rows of `df`, computed once and written to the checkpoint folder."""
    ensure_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    collect_garbage(df.sparkSession)
    return out
