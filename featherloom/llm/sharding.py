"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A stable key and the number of shards decide the shard; there is no ring table. When shards are appended, a row
either stays or goes to one of the new shards, and only the necessary fraction of rows moves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows that one task numbers within a shard, on average.
ROWS_PER_BUCKET = 20_000


def jump_hash(keys: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each unsigned 64-bit key among n, for all keys at once."""
    if n < 1:
        raise ValueError("at least one shard is needed")
    key = keys.astype(np.uint64)
    b = np.zeros(len(key), np.int64)
    j = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(live):
            b[live] = j[live]
            k = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
            key[live] = k
            step = (b[live] + 1) * (float(1 << 31) / ((k >> np.uint64(33)).astype(np.float64) + 1.0))
            j[live] = np.minimum(step, float(n)).astype(np.int64)
            live = live[j[live] < n]
    return b


def shard_of(key: Column, n: int) -> Column:
    """Jump-hash bucket of a 64-bit integer column; null keys count as 0."""

    @F.pandas_udf("int")
    def jump(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(dtype=np.int64).view(np.uint64), n).astype(np.int32))

    return jump(F.coalesce(key.cast("long"), F.lit(0)))


def stable_key(*cols: str) -> Column:
    """A well-mixed 64-bit key that depends on the values only; nulls are a value of their own."""
    return F.xxhash64(*[F.coalesce(F.concat(F.lit("v"), F.col(f"`{c}`").cast("string")), F.lit("n")) for c in cols])


def assign_shards(df: DataFrame, key_cols: list[str], n: int, grown: int | None = None) -> DataFrame:
    """All columns of df plus `shard` and, when `grown` is given, `grown_shard` for that many shards.

    Columns of these names in df give way. Rows with equal keys share a shard, repeated rows included; a null key is a
    key like any other; an empty table gives an empty table. No shuffle.
    """
    new = {"shard", "grown_shard"} if grown else {"shard"}
    base = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in new], stable_key(*key_cols).alias("__key"))
    out = base.withColumn("shard", shard_of(F.col("__key"), n))
    if grown:
        out = out.withColumn("grown_shard", shard_of(F.col("__key"), grown))
    return out.drop("__key")


def number_slots(df: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Give the rows of each shard gapless numbers from 0 (column `slot`), with no task that holds a whole shard.

    df should be narrow: it is written to the checkpoint folder, so that numbering sees the same rows twice. Rows are
    dealt to buckets by their place in the written files, so that a key with many repeated rows is dealt out too.
    """
    saved = cut(df)
    rows = saved.count()
    shards = max(1, saved.select("shard").distinct().count())
    buckets = max(1, -(-rows // (shards * rows_per_bucket)), min(8, -(-rows // (shards * 256))))
    spread = cut(saved.withColumn("__bucket", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)).cast("int")))
    sizes = spread.groupBy("shard", "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("shard", "__bucket").orderBy(*[F.col(f"`{c}`") for c in df.columns if c != "shard"])
    numbered = spread.withColumn("__row", F.row_number().over(within) - 1)
    out = numbered.join(offsets, ["shard", "__bucket"])
    return out.withColumn("slot", (F.col("__row") + F.col("__before")).cast("long")).drop("__row", "__before", "__bucket")


def shard_documents(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sharding plan of documents: id, size (UTF-8 bytes plus 1; a null text has none), text_crc32 (of the UTF-8
    bytes; 0 for null), law, shard, slot and grown_shard (with one shard more). A row for each row of docs."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    narrow = docs.select(
        F.col(f"`{id_col}`").alias(id_col),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = assign_shards(narrow, [id_col], n, n + 1)
    return number_slots(placed).select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
