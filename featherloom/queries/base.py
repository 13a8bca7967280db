"""How queries are registered, and helpers that they share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with DuckDB SQL where SQL can express it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column) -> Column:
    """Floating results are rounded on both sides: sums are added up in different orders."""
    return F.round(c.cast("double"), 6)


def event_ms(c: str = "ts") -> Column:
    return F.unix_millis(F.col(c).cast("timestamp"))


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder's path below the folder that all machines share (spark.checkpoint.dir), or in local mode a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        shared = tempfile.mkdtemp(prefix="featherloom-")
    return f"{shared}/{what}-{uuid.uuid4().hex}"
