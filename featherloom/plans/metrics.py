"""What a run cost, from Spark's own event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stage_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(stage, tasks, run_ms, cpu_ms, gc_ms, rows_in, shuffle_read, shuffle_written, spilled) of every stage of an event log,
    read and added up by Spark."""
    task = (
        "Event string, `Stage ID` long, `Task Metrics` struct<`Executor Run Time`: long, `Executor CPU Time`: long, `JVM GC Time`: long, `Disk Bytes Spilled`: long,"
        "`Input Metrics`: struct<`Records Read`: long>, `Shuffle Read Metrics`: struct<`Remote Bytes Read`: long, `Local Bytes Read`: long>, `Shuffle Write Metrics`: struct<`Shuffle Bytes Written`: long>>"
    )
    m = F.col("Task Metrics")
    read = m["Shuffle Read Metrics"]
    sums = {
        "run_ms": m["Executor Run Time"], "cpu_ms": m["Executor CPU Time"] / 1e6, "gc_ms": m["JVM GC Time"], "rows_in": m["Input Metrics"]["Records Read"],
        "shuffle_read": read["Remote Bytes Read"] + read["Local Bytes Read"], "shuffle_written": m["Shuffle Write Metrics"]["Shuffle Bytes Written"], "spilled": m["Disk Bytes Spilled"],
    }
    ended = spark.read.schema(task).json(path).where("Event = 'SparkListenerTaskEnd'")
    return ended.groupBy(F.col("Stage ID").alias("stage")).agg(F.count("*").alias("tasks"), *[F.sum(c).alias(n) for n, c in sums.items()])
