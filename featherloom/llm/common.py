"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that a Python worker turns into Python objects at a time.
SLICE_ROWS = 256
#: Characters after which a slice ends early, so that long texts do not pile up.
SLICE_BYTES = 8 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster. Where none is set there is a temporary one in local mode (tests); on a cluster, whose
    machines do not see each other's folders, that is an error."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not shared:
        shared = sc.getCheckpointDir()
    if not shared:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        shared = tempfile.mkdtemp(prefix="featherloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared)
    return shared


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder and go on from there: what follows survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a derived table (links, postings, classes) for each of its parts. Without this, small tables would be dealt over all
#: shuffle partitions, and every shuffle and every written step of theirs would be that many nearly empty files.
PART_ROWS = 50_000


def gathered(df: DataFrame, rows: int, each: int = PART_ROWS) -> DataFrame:
    """df in no more parts than `rows` rows fill. Parts are put together without a shuffle; enough rows leave df as it is."""
    return df.coalesce(max(1, -(-rows // each)))


def counted(df: DataFrame, *more: Column) -> tuple[DataFrame, dict]:
    """cut(df), and what was seen of its rows in the same pass: their number `n`, and `more` named aggregates."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n"), *more))
    return out, seen.get


#: Bytes of a batch that goes to a Python worker. Spark's own limit is eight times that, for each of two copies in the JVM.
BATCH_BYTES = 8 << 20
_BATCH_CONF = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b")


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python workers in batches of BATCH_BYTES, unless the session has a limit of its own."""
    name, default = _BATCH_CONF
    if spark.conf.get(name, default) == default:
        spark.conf.set(name, str(BATCH_BYTES))


def release() -> None:
    """Give the memory that a task has freed back to the system: workers live on for other tasks and stages, side by side with
    the JVM."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


#: What clears the caches that an operator's tasks keep from task to task, by operator.
_KEPT: dict[str, Callable[[], None]] = {}


def keeps(own: str, clear: Callable[[], None]) -> None:
    """Say that the tasks of an operator keep caches; tasks of others clear them first."""
    _KEPT[own] = clear


def forget_others(own: str | None) -> None:
    for name, clear in _KEPT.items():
        if name != own:
            clear()


def tidy(run: Callable[[Iterator], Iterator], *forget: Callable[[], None], own: str | None = None) -> Callable[[Iterator], Iterator]:
    """A task function that begins without the caches of other operators and gives memory back when it ends. forget: functions
    of a module that clear its caches at the end (a cache itself would travel as a copy)."""

    def task(batches: Iterator) -> Iterator:
        forget_others(own)
        try:
            yield from run(batches)
        finally:
            for f in forget:
                f()
            release()

    return task


def slices(batch: pa.RecordBatch, text_col: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most SLICE_ROWS rows and about SLICE_BYTES bytes of text, one row at least."""
    import pyarrow.compute as pc

    if batch.num_rows <= 1:
        yield batch
        return
    sizes = pc.binary_length(batch.column(text_col)).fill_null(0).to_pylist()
    at = held = 0
    for i, n in enumerate(sizes):
        if i > at and (i - at >= SLICE_ROWS or held + n > SLICE_BYTES):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    yield batch.slice(at)


def map_texts(
    df: DataFrame,
    text_col: str,
    fields: list[T.StructField],
    make: Callable[[], Callable[[list], list[list]]],
    keep: list[str] | None = None,
    own: str | None = None,
) -> DataFrame:
    """Add columns computed from whole texts, in Arrow batches, without a shuffle.

    `make()` runs once per task and returns a function from a list of texts (None for null) to one list
    per new field. `keep` names the input columns to return (all by default). A kept column with the name of a new
    field gives way to the new field. Column names are compared without regard to case, as Spark does. `own`: the operator
    whose caches stay from task to task.
    """
    new = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    hidden = "__text"
    while hidden in {c.lower() for c in kept} | new:
        hidden += "_"
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("string").alias(hidden))
    out = T.StructType([source.schema[i] for i in range(len(kept))] + fields)
    arrow_new = to_arrow_schema(T.StructType(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            for part in slices(batch, hidden):
                cols = apply(part.column(hidden).to_pylist())
                arrays = [part.column(i) for i in range(len(kept))]
                arrays += [pa.array(c, type=f.type) for c, f in zip(cols, arrow_new, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *[f.name for f in fields]])

    small_batches(df.sparkSession)
    return source.mapInArrow(tidy(run, own=own), out)
