"""Streaming: files as they come, scored by a fitted workflow, and windowed event features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, path: str, schema: str | T.StructType, kind: str = "parquet", files_per_trigger: int | None = None, latest_first: bool = False, options: dict | None = None) -> DataFrame:
    """New files of a folder as a stream."""
    reader = spark.readStream.format(kind).schema(schema).options(**(options or {}))
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("latestFirst", str(latest_first).lower()).load(path)


def score_stream(model, stream: DataFrame, path: str, checkpoint: str, once: bool = True, seconds: float | None = None) -> StreamingQuery:
    """Score a stream by a fitted workflow and append the results as Parquet. The stages are plain columns, so that the stream is
    scored as it is, without a loop over batches; the checkpoint makes it exactly once."""
    writer = model.score(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    query = (writer.trigger(availableNow=True) if once else writer).start()
    query.awaitTermination(*([] if once and seconds is None else [seconds] if seconds is not None else []))
    return query


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Give every batch that has rows to `write` with its number."""

    def run(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            write(batch, number)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    query = (writer.trigger(availableNow=True) if once else writer).start()
    if once:
        query.awaitTermination()
    return query


def windowed(stream: DataFrame, ts: str, keys: list[str], aggregates: list[Column], width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Aggregates of a key in tumbling or sliding event-time windows; events later than `late` are left out. Works on batch
    frames too."""
    rows = stream.withWatermark(ts, late) if stream.isStreaming else stream
    out = rows.groupBy(*keys, F.window(ts, width, slide or width).alias("w")).agg(*aggregates)
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in out.columns if c not in (*keys, "w")])


def sessions(stream: DataFrame, ts: str, keys: list[str], aggregates: list[Column], gap: str, late: str = "1 hour") -> DataFrame:
    """Aggregates of a key's sessions: events less than `gap` apart."""
    rows = stream.withWatermark(ts, late) if stream.isStreaming else stream
    out = rows.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(*aggregates)
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in out.columns if c not in (*keys, "w")])
