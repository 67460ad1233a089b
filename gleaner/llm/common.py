"""What several of the training-data operators need from Spark."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("*",)))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut off from its lineage, in the folder of spark.checkpoint.dir, which the executors share.
    Where that setting is absent, a temporary folder is set if Spark runs on this machine alone (tests)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    # Spark removes the shuffle files behind earlier checkpoints when the driver collects its garbage
    context._jvm.System.gc()
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Have Spark remove the files of shuffles and checkpoints that nothing refers to any more; it learns of
    them when Python and the driver's JVM collect their garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """From now on, in this session, Spark hands no more than so many rows at once to Python tasks (10,000
    if left alone): rows here are whole texts, and each task holds a batch or two on either side."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: What operators remember in a Python worker between their tasks.
_caches: list[dict] = []


def worker_cache() -> dict:
    """A dict that lasts until a task of an operator that calls empty_caches runs in the same worker."""
    _caches.append({})
    return _caches[-1]


def give_back() -> None:
    """Hand memory that is free in this worker back to the system, for the executor and other workers."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def empty_caches() -> None:
    """Free what tasks of other operators have left in this worker."""
    for cache in _caches:
        cache.clear()
    give_back()


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of no more than ``rows``, so that what is made of a batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def per_batch(function: Callable[[pa.RecordBatch], pa.RecordBatch | None]):
    """A mapInArrow function from one of a single batch; batches without rows are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty_caches()
        for batch in in_parts(batches):
            if (out := function(batch)) is not None:
                yield out

    return run


def held_out_remainder(id_column: str, divisor: int):
    """crc32 of the id as text, modulo the divisor."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % divisor


def most_frequent(counts: DataFrame, size: int) -> DataFrame:
    """The rows of counts (with a column n of positive counts) that are the ``size`` most frequent, or
    somewhat fewer: all rows above the smallest bound that leaves no more than that. The bound comes
    from a histogram of at most 64 * 32 cells, so no task sorts all rows."""
    cell = F.floor(F.log2(F.col("n").cast("double")) * 32)
    cells = sorted(((r["cell"], r["rows"]) for r in counts.groupBy(cell.alias("cell")).agg(F.count("*").alias("rows")).collect()), reverse=True)
    total, bound = 0, None
    for at, rows in cells:
        if total + rows > size:
            break
        total, bound = total + rows, at
    return counts.filter(F.lit(False) if bound is None else cell >= bound)
