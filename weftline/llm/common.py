"""Helpers shared by the operators: scratch tables in the shared folder, Arrow mapping, folds."""

from __future__ import annotations

import contextvars
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Scratch tables written since the innermost ``settle`` began.
_WRITTEN: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("written", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a local session takes a folder of its own; a cluster has none that its
    executors share, so it is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        kept = spark.sparkContext.getCheckpointDir()
        if kept:
            return kept.rsplit("/", 1)[0]
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/weftline-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, in a folder for each value of ``by``, and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    if (written := _WRITTEN.get()) is not None:
        written.append(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def settle(make: Callable[[], DataFrame], spark: SparkSession, name: str) -> DataFrame:
    """Materialise what ``make`` returns and delete the scratch tables that were written on the way to it."""
    inner: list[str] = []
    token = _WRITTEN.set(inner)
    try:
        df = make()
        path = scratch_path(spark, name)
        df.write.parquet(path)
    finally:
        _WRITTEN.reset(token)
    discard(spark, inner)
    if (written := _WRITTEN.get()) is not None:
        written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files that no table needs any more; it acts on what the driver's collector has found."""
    spark.sparkContext._jvm.java.lang.System.gc()


def discard(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete folders of the shared file system."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def give_back() -> None:
    """Return to the system what a finished task's worker holds and no longer needs, as Spark keeps the worker."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` whose workers give memory back at the end of a task."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(whole, schema)


#: Bytes of text that a batch function gets at once, unless a single row has more.
STEP_BYTES = 2 << 20


def slices(batch: pa.RecordBatch, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of at most ``most`` bytes of text, or of one longer row; nothing is copied."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """Apply a batch function to slices of Arrow batches, bounded in bytes of text; ``make`` runs once in each task and returns it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            for part in slices(batch):
                step = step or make()
                done = step(part)
                if done is not None and done.num_rows:
                    yield done

    return map_arrow(df, run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(col: str, mod: int):
    """crc32 of a column's text form, modulo ``mod``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % mod
