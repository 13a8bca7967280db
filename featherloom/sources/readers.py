"""Readers: a typed source, how its key is taken, and how raw features are generated from it.

A simple reader gives a row for each record; an aggregate reader a row for each key around a global cut-off; a conditional
reader a row for each key around its own.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.events import Conditional, CutOff, EventFeature, aggregate_events, conditional_events
from ..operators.joins import join_keyed
from .avro import load_avro

Load = Callable[[SparkSession], DataFrame]


@dataclass(frozen=True)
class Reader:
    load: Load
    key: Column
    name: str = "reader"
    ts: Column | None = None
    tie: Column | None = None
    cut_off: CutOff | None = None
    conditional: Conditional | None = None
    predictor_window_ms: int | None = None
    response_window_ms: int | None = None
    partitions: int | None = None

    def aggregate(self, ts: Column, cut_off: CutOff = CutOff(), tie: Column | None = None, predictor_window_ms: int | None = None, response_window_ms: int | None = None) -> Reader:
        return replace(self, ts=ts, tie=tie, cut_off=cut_off, predictor_window_ms=predictor_window_ms, response_window_ms=response_window_ms)

    def condition(self, ts: Column, how: Conditional, tie: Column | None = None) -> Reader:
        return replace(self, ts=ts, tie=tie, conditional=how)

    def read(self, spark: SparkSession) -> DataFrame:
        df = self.load(spark)
        return df.repartition(self.partitions) if self.partitions else df

    def generate(self, spark: SparkSession, features: list[EventFeature]) -> DataFrame:
        """(key, features): the key is a string and not null."""
        df = self.read(spark)
        if self.conditional:
            return conditional_events(df, self.key, self.ts, features, self.conditional, self.tie)
        if self.cut_off is not None:
            return aggregate_events(df, self.key, self.ts, features, self.cut_off, self.tie, self.predictor_window_ms, self.response_window_ms)
        return df.select(self.key.cast("string").alias("key"), *[f.value.alias(f.name) for f in features])

    def join(self, other: Reader, how: str = "outer") -> JoinedReader:
        if other.name == self.name:
            raise ValueError("two readers of one record type; give one of them another name")
        return JoinedReader(self, other, how)

    def outer_join(self, other: Reader) -> JoinedReader:
        return self.join(other, "outer")

    def left_outer_join(self, other: Reader) -> JoinedReader:
        return self.join(other, "left_outer")

    def inner_join(self, other: Reader) -> JoinedReader:
        return self.join(other, "inner")


@dataclass(frozen=True)
class JoinedReader:
    left: Reader | JoinedReader
    right: Reader
    how: str

    def generate(self, spark: SparkSession, left: list[EventFeature], right: list[EventFeature]) -> DataFrame:
        return join_keyed(self.left.generate(spark, left), self.right.generate(spark, right), self.how)


def csv(path: str, key: Column, schema: str | T.StructType, *, header: bool = False, options: dict | None = None, **more) -> Reader:
    return Reader(lambda s: s.read.schema(schema).options(**(options or {})).csv(path, header=header), key, **more)


def csv_auto(path: str, key: Column, headers: list[str] | None = None, options: dict | None = None, **more) -> Reader:
    """Types are inferred; names come from the first line or from `headers`."""

    def load(s: SparkSession) -> DataFrame:
        df = s.read.options(**(options or {})).csv(path, header=headers is None, inferSchema=True)
        return df.toDF(*headers) if headers else df

    return Reader(load, key, **more)


def parquet(path: str, key: Column, **more) -> Reader:
    return Reader(lambda s: s.read.parquet(path), key, **more)


def avro(path: str, key: Column, schema: T.StructType | None = None, **more) -> Reader:
    return Reader(lambda s: load_avro(s, path, schema), key, **more)


def frame(df: DataFrame, key: Column, **more) -> Reader:
    return Reader(lambda s: df, key, **more)


def read_existing(spark: SparkSession, paths: list[str], kind: str = "parquet") -> DataFrame:
    """All of the paths that exist, read together."""
    found = []
    for p in paths:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(p)
        if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
            found.append(p)
    if not found:
        raise FileNotFoundError(f"none of {paths} exists")
    return spark.read.format(kind).load(found)


def cast_columns(df: DataFrame, schema: T.StructType, strict: bool = True) -> DataFrame:
    """Columns cast to a flat schema; a value that does not fit is an error, or null if not strict."""
    cols = []
    for f in schema.fields:
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            raise TypeError(f"column {f.name} is nested")
        c = F.col(f.name)
        cols.append((c.cast(f.dataType) if strict else c.try_cast(f.dataType)).alias(f.name))
    return df.select(*cols)


def save_with_schema(df: DataFrame, path: str) -> None:
    """Parquet keeps the columns' metadata; the schema is also written beside it as JSON."""
    df.write.mode("overwrite").parquet(path)
    df.sparkSession.createDataFrame([(df.schema.json(),)], "json string").coalesce(1).write.mode("overwrite").text(f"{path}.schema")


def load_with_schema(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(spark.read.text(f"{path}.schema").first()[0]))
    return spark.read.schema(schema).parquet(path)


def schema_json(spark: SparkSession, path: str, kind: str = "csv") -> str:
    df = spark.read.csv(path, header=True, inferSchema=True) if kind == "csv" else spark.read.format(kind).load(path)
    return df.schema.json()
