"""Jobs of several stages that go on where they stopped."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Stage = tuple[str, Column, Callable[[DataFrame], DataFrame]]


def committed(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to the end."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def run_stages(items: DataFrame, stages: Sequence[Stage], path: str, stop: Callable[[DataFrame], bool] = lambda done: False) -> DataFrame:
    """items after the stages, each a name, the items it takes (the others skip it) and what it does.

    What each stage leaves is written under ``path`` as a table of its own, with the last stage an item
    took as ``stage``; a stage whose table is there isn't run again, so a job that failed is run again with
    the same path and goes on. ``stop`` looks at each stage's table and may end the job early. A condition
    that is null skips the item. A stage keeps the columns that later ones read."""
    spark = items.sparkSession
    current = items.withColumn("stage", F.lit(None).cast("string"))
    for number, (name, takes, work) in enumerate(stages):
        target = f"{path}/{number:02d}-{name}"
        if not committed(spark, target):
            taken = F.coalesce(takes, F.lit(False))
            done = work(current.filter(taken)).withColumn("stage", F.lit(name))
            done.unionByName(current.filter(~taken), allowMissingColumns=True).write.mode("overwrite").parquet(target)
        current = spark.read.parquet(target)
        if stop(current):
            break
    return current
