"""Filters, joins, ranks, pages and set operations as functions of DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def all_of(*conditions: Column | None) -> Column:
    """The conjunction of the conditions that are given."""
    given = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a & b, given, F.lit(True))


def prefix_filter(column: Column, prefix: str | None, wildcards: bool = False) -> Column | None:
    """A literal prefix; with wildcards, % and _ in it act as in LIKE. No prefix: no condition."""
    if not prefix:
        return None
    return column.like(prefix + "%") if wildcards else column.startswith(prefix)


def contains_any(columns: Sequence[Column], needle: str | None, wildcards: bool = False) -> Column | None:
    """Case-insensitive containment in any of the columns; null columns don't match."""
    if needle is None or not needle.strip():
        return None
    found = [F.coalesce(F.lower(c).like(f"%{needle.lower()}%") if wildcards else F.contains(F.lower(c), F.lit(needle.lower())), F.lit(False)) for c in columns]
    return reduce(lambda a, b: a | b, found)


def by_keys(df: DataFrame, column: str, keys: Sequence) -> DataFrame:
    """Rows with one of the given keys."""
    return df.filter(F.col(column).isin(list(keys))) if keys else df.limit(0)


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """The number-th page (from 1) of a total order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def ordered_by(column: str, descending: bool, key: str) -> list[Column]:
    """Nulls as in SQL databases (last going up, first going down), ties by key."""
    return [F.desc_nulls_first(column) if descending else F.asc_nulls_last(column), F.asc(key)]


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("__n") <= n).drop("__n")


def latest_per_key(df: DataFrame, keys: Sequence[str], at: str, tie: str) -> DataFrame:
    """The last row of each key, by an aggregation that combines before it shuffles."""
    row = F.struct(at, tie, *[c for c in df.columns if c not in (at, tie, *keys)])
    best = df.groupBy(*keys).agg(F.max(row).alias("r"))
    return best.select(*[c if c in keys else F.col("r")[c].alias(c) for c in df.columns])


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, since: str, value: str) -> DataFrame:
    """left with the value of the last right row of its keys with since <= at, else null.

    Both sides are put into one ordered stream a key, a right row before a left row of the same time;
    ties of right rows by value. One shuffle, no pairs."""
    columns = left.columns
    a = left.select(*columns, F.col(at).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__v"))
    b = right.select(*[F.col(k) if k in keys else F.lit(None).cast(left.schema[k].dataType).alias(k) for k in columns], F.col(since).alias("__t"), F.lit(0).alias("__side"), F.col(value).alias("__v"))
    order = Window.partitionBy(*keys).orderBy("__t", "__side", F.col("__v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn(value, F.last("__v", True).over(order)).filter("__side = 1").select(*columns, value)


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, area: str, children: str) -> DataFrame:
    """key and change: added, removed, resized (area by over a fifth) or children."""
    b = before.select(F.col(key).alias("k"), F.col(area).alias("a0"), F.col(children).alias("c0"), F.lit(True).alias("was"))
    a = after.select(key, F.col(area).alias("a1"), F.col(children).alias("c1"), F.lit(True).alias("now"))
    both = a.join(b, a[key] == b["k"], "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.abs(F.col("a1") - F.col("a0")) > 0.2 * F.col("a0"), "resized").when(F.col("c1") != F.col("c0"), "children")
    return both.select(F.coalesce(key, "k").alias(key), change.alias("change")).filter("change is not null")


def budget_prefix(df: DataFrame, keys: Sequence[str], order: Sequence[Column], size: str, budget: int) -> DataFrame:
    """Of each key, the rows up to the first at which the running size passes the budget (left out)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__sum", F.sum(size).over(w)).filter(F.col("__sum") <= budget).drop("__sum")


def failure_streaks(df: DataFrame, key: str, order: Sequence[Column], failed: Column) -> DataFrame:
    """df with streak: how many failures in a row end at this row (0 at a success)."""
    w = Window.partitionBy(key).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    islands = df.withColumn("__island", F.sum(F.when(failed, 0).otherwise(1)).over(so_far))
    inner = Window.partitionBy(key, "__island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return islands.withColumn("streak", F.sum(F.when(failed, 1).otherwise(0)).over(inner)).drop("__island")
