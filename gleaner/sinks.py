"""Sinks: appends, versioned snapshots and request files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, *partitions: str) -> None:
    df.write.mode("append").partitionBy(*partitions).parquet(path)


def write_snapshot(df: DataFrame, path: str, version: int) -> str:
    """A snapshot under a path of its own; a reader of an earlier version isn't disturbed."""
    target = f"{path}/version={version:012d}"
    df.write.mode("overwrite").parquet(target)
    return target


def read_snapshot(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version:012d}")


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function. Each batch has a folder of its own and replaces what an earlier try left
    there, so after a restart no row is missing or there twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def write_requests(df: DataFrame, path: str) -> None:
    """JSON lines, one a request."""
    df.write.mode("overwrite").json(path)


def request_batches(df: DataFrame, key: str, order: str, text: str, size: int, inline_below: int) -> DataFrame:
    """Fixed-size batches of each key's requests, with what each holds and how it is sent."""
    number = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    rows = df.select(key, F.length(text).alias("n"), F.floor(number / size).cast("int").alias("batch"))
    total = F.sum("n")
    return rows.groupBy(key, "batch").agg(F.count("*").alias("requests"), total.alias("chars"), F.when(total < inline_below, "inline").otherwise("file").alias("route"))
