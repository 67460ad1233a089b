"""Merge semantics: a new snapshot from an old one and a delta, both DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _both(old: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    o = old.select(*[F.col(c).alias(f"o_{c}") for c in old.columns], F.lit(True).alias("in_old"))
    d = delta.select(*[F.col(c).alias(f"d_{c}") for c in delta.columns], F.lit(True).alias("in_delta"))
    return o.join(d, F.col(f"o_{key}") == F.col(f"d_{key}"), "full_outer")


def upsert(old: DataFrame, delta: DataFrame, key: str, version: str = "version") -> tuple[DataFrame, DataFrame]:
    """The new snapshot and the conflicts. A delta row replaces the old one as version + 1 if its version is
    the old one's, and starts at 1 if there is none; any other version is a conflict and changes nothing."""
    both = _both(old, delta, key)
    conflict = F.col("in_old") & F.col("in_delta") & ~F.col(f"o_{version}").eqNullSafe(F.col(f"d_{version}"))
    conflict = F.coalesce(conflict, F.lit(False))
    take = F.col("in_delta").isNotNull() & ~conflict
    columns = [F.when(take, F.coalesce(F.col(f"o_{c}"), F.lit(0)) + 1).otherwise(F.col(f"o_{c}")).alias(c) if c == version else F.when(take, F.col(f"d_{c}")).otherwise(F.col(f"o_{c}")).alias(c) for c in old.columns]
    return both.select(*columns), both.filter(conflict).select(*[F.col(f"d_{c}").alias(c) for c in delta.columns])


def update_columns(old: DataFrame, delta: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Inserts whole delta rows; of rows that exist, only the given columns change."""
    both = _both(old, delta, key)
    out = [F.when(F.col("in_delta").isNotNull() & (F.lit(c in columns) | F.col("in_old").isNull()), F.col(f"d_{c}")).otherwise(F.col(f"o_{c}")).alias(c) for c in old.columns]
    return both.select(*out)


def replace_links(old: DataFrame, delta: DataFrame, owner: str, item: str, now_ms: int) -> DataFrame:
    """owner, item, is_active, created_at_ms: of owners in the delta, its items become active (created now)
    and their others inactive; all other owners' rows stay."""
    named = delta.select(owner, item).distinct()
    owners = named.select(F.col(owner).alias("__owner")).distinct()
    marked = old.join(owners, F.col(owner) == F.col("__owner"), "left")
    rest = marked.join(named, [owner, item], "left_anti").withColumn("is_active", F.col("is_active") & F.col("__owner").isNull()).select(*old.columns)
    return rest.unionByName(named.select(owner, item, F.lit(True).alias("is_active"), F.lit(now_ms).cast("long").alias("created_at_ms")).select(*old.columns))


def replace_provenance(old: DataFrame, delta: DataFrame, source: str) -> DataFrame:
    """old without any row of the delta's sources, and the delta."""
    return old.join(delta.select(source).distinct(), source, "left_anti").unionByName(delta)


def flag_in(df: DataFrame, keys: DataFrame, key: str, flag: str) -> DataFrame:
    """df with flag true where the key is among keys, as it was elsewhere."""
    marked = df.join(keys.select(F.col(keys.columns[0]).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left")
    return marked.withColumn(flag, F.col(flag) | F.col("__k").isNotNull()).select(*df.columns)


def recache(old: DataFrame, delta: DataFrame, key: str, now_ms: int) -> DataFrame:
    """Pages cached anew: content from the delta, no embedding until indexed again, created_at stays."""
    both = _both(old, delta, key)
    new = F.col("in_delta").isNotNull()
    special = {"embedding": F.lit(None), "updated_at_ms": F.lit(now_ms), "created_at_ms": F.coalesce("o_created_at_ms", F.lit(now_ms)), "version": F.coalesce("o_version", F.lit(0)) + 1}
    return both.select(*[F.when(new, special.get(c, F.col(f"d_{c}") if c in delta.columns else F.col(f"o_{c}"))).otherwise(F.col(f"o_{c}")).alias(c) for c in old.columns])


def claim(tasks: DataFrame, n: int, now_ms: int) -> DataFrame:
    """tasks with the n oldest pending ones in progress, one attempt more."""
    first = tasks.filter("status = 'PENDING'").orderBy("task_id").limit(n).select(F.col("task_id").alias("__t"))
    marked = tasks.join(first, F.col("task_id") == F.col("__t"), "left")
    hit = F.col("__t").isNotNull()
    return marked.withColumns({"status": F.when(hit, "IN_PROGRESS").otherwise(F.col("status")), "attempts": F.col("attempts") + hit.cast("int"), "claimed_at_ms": F.when(hit, now_ms).otherwise(F.col("claimed_at_ms"))}).select(*tasks.columns)


def retry_or_fail(status: Column, attempts: Column, max_attempts: Column, failed: Column) -> Column:
    """The next state of a task that failed: pending while attempts are left."""
    return F.when(failed & (attempts < max_attempts), "PENDING").when(failed, "FAILED").otherwise(status)


def release_stale(tasks: DataFrame, now_ms: int, threshold_ms: int) -> DataFrame:
    stale = (F.col("status") == "IN_PROGRESS") & (F.col("claimed_at_ms") <= now_ms - threshold_ms)
    return tasks.withColumns({"status": F.when(stale, "PENDING").otherwise(F.col("status")), "claimed_at_ms": F.when(stale, None).otherwise(F.col("claimed_at_ms"))})


def drop_finished(tasks: DataFrame, before_ms: int) -> DataFrame:
    return tasks.filter(~F.coalesce((F.col("status") == "COMPLETED") & (F.col("updated_at_ms") < before_ms), F.lit(False)))


def due(enabled: Column, period_days: Column, last_run_ms: Column, now_ms: int) -> Column:
    """Whether an indexing job is due; a period of 0 days runs once."""
    return F.when(~enabled, False).when(last_run_ms.isNull(), True).when(period_days == 0, False).otherwise(last_run_ms + period_days * 86_400_000 <= now_ms)


def consume_quota(subscriptions: DataFrame) -> DataFrame:
    """One search used, of each user, from the row that expires first of those with searches left; rows
    that never expire come before all others, as nulls sort first."""
    left = F.col("max_searches") + F.col("rollover_searches") - F.col("used_searches")
    w = Window.partitionBy("user_id", left > 0).orderBy(F.col("expires_at_ms").asc_nulls_first(), "subscription_id")
    hit = (F.row_number().over(w) == 1) & (left > 0)
    return subscriptions.withColumn("__hit", hit).withColumn("used_searches", F.col("used_searches") + F.col("__hit").cast("int")).drop("__hit")


def ingestion_action(documents: DataFrame, stored: DataFrame, key: str, now_ms: int, ttl_ms: int) -> DataFrame:
    """documents with action: add, skip (stored and fresh) or replace (stored and expired), by content hash."""
    s = stored.select(F.col(key).alias("__k"), "updated_at_ms")
    j = documents.join(s, F.col(key) == F.col("__k"), "left")
    return j.withColumn("action", F.when(F.col("__k").isNull(), "add").when(now_ms - F.col("updated_at_ms") < ttl_ms, "skip").otherwise("replace")).drop("__k", "updated_at_ms")


def current_plan(subscriptions: DataFrame, user: str) -> DataFrame:
    """Each user's plan: with paid ones, the one with searches left that allows the most, of equals the first; with
    free ones alone, the first with searches left. Users without such a plan are absent."""
    left = F.col("max_searches") + F.col("rollover_searches") - F.col("used_searches") > 0
    paid = F.col("tier") == "PAID"
    users = subscriptions.groupBy(user).agg(F.max(paid).alias("__paid"), F.min_by("subscription_id", F.when(left & paid, F.struct(-F.col("max_searches"), F.col("subscription_id")))).alias("__best"), F.min(F.when(left & ~paid, F.col("subscription_id"))).alias("__free"))
    plan = F.when(F.col("__paid"), F.col("__best")).otherwise(F.col("__free"))
    return users.select(user, plan.alias("subscription_id")).filter("subscription_id is not null")


def work(tasks: DataFrame, process: Callable[[DataFrame], DataFrame], read: Callable[[int], DataFrame], write: Callable[[DataFrame, int], object], each: int | None, now_ms: int, rounds: int) -> int:
    """Rounds of a worker over a queue that is kept as versions of a table: each claims the ``each`` oldest pending
    tasks of every kind (None: all of them), has them processed (process gives task_id and ok) and writes the next version, in
    which they are completed, pending again, or failed. Ends with the version in which nothing is pending, or
    after some rounds; returns its number. A round that is lost is done again from the version before."""
    write(tasks, 0)
    for version in range(rounds):
        now = read(version)
        pending = now.filter("status = 'PENDING'")
        kinds = [r["kind"] for r in pending.select("kind").distinct().collect()]
        if not kinds:
            return version
        claimed = pending if each is None else reduce(DataFrame.unionByName, [pending.filter(F.col("kind") == k).orderBy("task_id").limit(each) for k in kinds])
        # results are as many as tasks, in few bytes each: never sent to all by way of the driver
        results = process(claimed).select(F.col("task_id").alias("__t"), F.coalesce("ok", F.lit(False)).alias("__ok"))
        marked = now.join(results.hint("merge"), F.col("task_id") == F.col("__t"), "left").withColumn("__ok", F.coalesce("__ok", F.lit(False)))
        if each is None:
            marked = marked.withColumn("__hit", F.coalesce(F.col("status") == "PENDING", F.lit(False)))
        else:
            named = claimed.select(F.col("task_id").alias("__c"))
            marked = marked.join(named.hint("merge"), F.col("task_id") == F.col("__c"), "left").withColumn("__hit", F.col("__c").isNotNull())
        hit, attempts = F.col("__hit"), F.col("attempts") + F.col("__hit").cast("int")
        status = F.when(~hit, F.col("status")).when(F.col("__ok"), "COMPLETED").otherwise(retry_or_fail(F.col("status"), attempts, F.col("max_attempts"), ~F.col("__ok")))
        write(marked.withColumns({"status": status, "attempts": attempts, "updated_at_ms": F.when(hit, now_ms).otherwise(F.col("updated_at_ms"))}).select(*now.columns), version + 1)
    return rounds
