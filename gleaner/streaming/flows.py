"""Dataflow operators. Each has a batch form over an event log; the stateful ones share their step with
a Structured Streaming form."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def microbatches(events: DataFrame, keys: list[str], at: str, tie: str, size: int, gap_ms: int) -> DataFrame:
    """events (at in epoch ms) with batch, 0, 1, ... within a key: a batch ends after ``size`` items or
    before a pause of at least gap_ms; the pause is counted from the last item."""
    w = Window.partitionBy(*keys).orderBy(at, tie)
    new = F.coalesce((F.col(at) - F.lag(at).over(w) >= gap_ms).cast("int"), F.lit(1))
    runs = events.withColumn("__run", new)
    runs = runs.withColumn("__run", F.sum("__run").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy(*keys, "__run").orderBy(at, tie)
    runs = runs.withColumn("__part", F.floor((F.row_number().over(inner) - 1) / size))
    return runs.withColumn("batch", F.dense_rank().over(Window.partitionBy(*keys).orderBy("__run", "__part")) - 1).drop("__run", "__part")


def over_limit(events: DataFrame, key: str, at: Column, limit: int, minutes: int = 1) -> DataFrame:
    """key, window start and how many requests were above the limit in each window that had some."""
    counts = events.groupBy(key, F.window(at, f"{minutes} minutes").alias("w")).agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") > limit).select(key, F.col("w.start").alias("start"), (F.col("n") - limit).alias("rejected"))


def refilling_bucket(requests: DataFrame, key: str, at: str, tie: str, cost: str, capacity: int, period_ms: int, block_ms: int = 600_000, piece: int = 1024) -> DataFrame:
    """requests with ``level`` (before the request) and ``accepted``: a key's bucket holds ``capacity`` tokens, gains
    that many a period, steadily, and loses each request's cost; a request that finds less than its cost is
    turned away and leaves the bucket empty. Levels are whole numbers, in tokens times period_ms.

    What a request does to a level, adding within bounds, is of the same kind as what many requests in a row
    do. So each block of time is summed up apart, blocks are chained by their sums, and a key of many
    requests is spread over its blocks."""
    full, zero = F.lit(capacity * period_ms).cast("long"), F.lit(0).cast("long")
    rows = requests.withColumn("__block", F.floor(F.col(at) / block_ms)).withColumn("__cost", F.col(cost).cast("long") * period_ms)
    within = Window.partitionBy(key, "__block").orderBy(at, tie)
    before, number = F.lag(at).over(within), F.row_number().over(within) - 1
    rows = rows.withColumns({"__gain": F.when(number % piece != 0, F.least(full, (F.col(at) - before).cast("long") * capacity)), "__piece": F.floor(number / piece)})
    one = F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"), F.coalesce("__gain", zero).alias("gain"), F.col("__cost").alias("cost"))
    blocks = rows.groupBy(F.col(key).alias("__key"), F.struct("__block", "__piece").alias("__block")).agg(F.array_sort(F.collect_list(one)).alias("all"))
    bounded = lambda x, low, high: F.greatest(low, F.least(high, x))
    bounds = lambda add, low, high: F.struct(add.alias("add"), low.alias("low"), high.alias("high"))

    def then(s: Column, r: Column) -> Column:
        add, high = r["gain"] - r["cost"], F.greatest(zero, full - r["cost"])
        return bounds(s["add"] + add, bounded(s["low"] + add, zero, high), bounded(s["high"] + add, zero, high))

    blocks = blocks.withColumn("sum", F.aggregate("all", bounds(zero, zero, full), then)).withColumns({"first": F.get("all", F.lit(0))["at"], "last": F.element_at("all", -1)["at"]})
    chain = F.array_sort(F.collect_list(F.struct("__block", "first", "last", "sum")))
    start = F.struct(full.alias("level"), F.lit(None).cast("long").alias("last"), F.array().cast("array<struct<block:struct<__block:long,__piece:long>,level:long>>").alias("out"))

    def link(s: Column, b: Column) -> Column:
        level = F.when(s["last"].isNull(), full).otherwise(F.least(full, s["level"] + F.least(full, (b["first"] - s["last"]).cast("long") * capacity)))
        return F.struct(bounded(level + b["sum"]["add"], b["sum"]["low"], b["sum"]["high"]).alias("level"), b["last"].cast("long").alias("last"), F.array_append(s["out"], F.struct(b["__block"].alias("block"), level.alias("level"))).alias("out"))

    starts = blocks.groupBy("__key").agg(F.aggregate(chain, start, link)["out"].alias("out")).select(F.col("__key").alias("__k"), F.explode("out").alias("s"))
    joined = blocks.join(starts, F.col("__key").eqNullSafe(F.col("__k")) & (F.col("__block") == F.col("s.block")))
    begun = F.struct(F.col("s.level").alias("level"), F.array().cast("array<struct<at:long,tie:long,level:long,accepted:boolean>>").alias("out"))

    def take(s: Column, r: Column) -> Column:
        level = F.least(full, s["level"] + r["gain"])
        item = F.struct(r["at"].cast("long").alias("at"), r["tie"].cast("long").alias("tie"), level.alias("level"), (level >= r["cost"]).alias("accepted"))
        return F.struct(F.greatest(zero, level - r["cost"]).alias("level"), F.array_append(s["out"], item).alias("out"))

    done = joined.select(F.col("__key").alias(key), F.explode(F.aggregate("all", begun, take)["out"]).alias("r"))
    return done.select(key, F.col("r.at").alias(at), F.col("r.tie").alias(tie), "r.level", "r.accepted")


@dataclass
class Rate:
    """Additive increase, multiplicative decrease of a domain's concurrency."""

    limit: int = 100
    successes: int = 0

    def step(self, limited: bool, every: int = 10, most: int = 100) -> int:
        if limited:
            self.limit, self.successes = max(1, self.limit // 2), 0
        else:
            self.successes += 1
            if self.successes == every:
                self.limit, self.successes = min(most, self.limit + 1), 0
        return self.limit


def adaptive_limits(events: DataFrame, key: str, at: str, tie: str, limited: str, block_ms: int = 3_600_000, every: int = 10, most: int = 100) -> DataFrame:
    """Each key's last limit and its number of events, in order of time (epoch ms) and tie.

    A block of time is summed up apart from the others: the successes before its first limited event,
    those after its last one, and what the events between make of each limit. So a key's events are
    spread over its blocks, and only one row a block is brought together. A null flag is a success."""
    flag = F.coalesce(F.col(limited).cast("boolean"), F.lit(False))
    rows = events.select(key, at, tie, flag.alias("__limited"), F.floor(F.col(at) / block_ms).alias("__block"))
    so_far = Window.partitionBy(key, "__block").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__run", F.sum(F.col("__limited").cast("int")).over(so_far))
    runs = rows.groupBy(key, "__block", "__run").agg(F.count("*").alias("n"), F.sum((~F.col("__limited")).cast("long")).alias("ok"))
    blocks = runs.groupBy(key, "__block").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("__run", "ok"))).alias("runs"))

    def halved(limit: Column, successes: Column) -> Column:
        return F.greatest(F.lit(1).cast("long"), F.floor(F.least(F.lit(most).cast("long"), limit + F.floor(successes / every)) / 2))

    # the runs after a limited event; the last of them ends with the block, not with a limited event
    after = F.filter("runs", lambda r: r["__run"] > 0)
    between = F.transform(F.slice(after, 1, F.greatest(F.size(after) - 1, F.lit(0))), lambda r: r["ok"])
    limits = F.transform(F.sequence(F.lit(1), F.lit(max(1, most // 2))), lambda x: x.cast("long"))
    blocks = blocks.select(
        key, "__block", "n", F.coalesce(F.try_element_at(F.filter("runs", lambda r: r["__run"] == 0), F.lit(1))["ok"], F.lit(0)).alias("lead"),
        F.try_element_at(after, F.lit(-1))["ok"].alias("trail"), F.aggregate(between, limits, lambda all_, ok: F.transform(all_, lambda x: halved(x, ok))).alias("ends"),
    )

    def step(state: Column, block: Column) -> Column:
        run = state["run"] + block["lead"]
        whole = F.struct(F.element_at(block["ends"], halved(state["limit"], run).cast("int")).alias("limit"), block["trail"].alias("run"))
        return F.when(block["trail"].isNull(), F.struct(state["limit"].alias("limit"), run.alias("run"))).otherwise(whole)

    ordered = F.array_sort(F.collect_list(F.struct("__block", "lead", "trail", "ends")))
    start = F.struct(F.lit(most).cast("long").alias("limit"), F.lit(0).cast("long").alias("run"))
    keys = blocks.groupBy(key).agg(F.sum("n").alias("events"), F.aggregate(ordered, start, step).alias("end"))
    return keys.select(key, F.least(F.lit(most).cast("long"), F.col("end.limit") + F.floor(F.col("end.run") / every)).alias("limit"), "events")


def adaptive_limits_stream(events: DataFrame, key: str, limited: str) -> DataFrame:
    """The same over a stream, in order of arrival; a key's state goes after an hour without events."""

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rate = Rate(*state.get) if state.exists else Rate()
        n = 0
        for rows in frames:
            for x in rows[limited]:
                rate.step(bool(x))
            n += len(rows)
        state.update((rate.limit, rate.successes))
        state.setTimeoutDuration(3_600_000)
        yield pd.DataFrame({key: [group[0]], "limit": [rate.limit], "events": [n]})

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, limit long, events long", "limit long, successes long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def deduplicated(stream: DataFrame, key: str, at: str, within: str) -> DataFrame:
    """The first event of each key within a time; state older than that goes."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str, key: str, size: str, late: str) -> DataFrame:
    """Counts by event time; events later than ``late`` are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size), key).agg(F.count("*").alias("n"))


def running_sources(batches: DataFrame, session: str, batch: str, url: str, tie: str) -> DataFrame:
    """For each session and batch, how many sources are known by then; the first batch of a URL wins."""
    firsts = batches.groupBy(session, url).agg(F.min(F.struct(batch, tie)).alias("f"))
    new = firsts.groupBy(session, F.col("f")[batch].alias(batch)).agg(F.count("*").alias("new"))
    w = Window.partitionBy(session).orderBy(batch).rowsBetween(Window.unboundedPreceding, 0)
    all_batches = batches.select(session, batch).distinct().join(new, [session, batch], "left").withColumn("new", F.coalesce("new", F.lit(0)))
    return all_batches.withColumn("known", F.sum("new").over(w))


def smallest(rows: DataFrame, order: list[Column], n: int, checkpoint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The n first rows in an order, without all of them in one task: rows are sorted by ranges, ranges are counted,
    and each row's number is its place in its range after those before."""
    names = rows.columns
    if n <= 0:
        return rows.limit(0)
    ranges = checkpoint(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id()))
    before, total = {}, 0
    for r in ranges.groupBy("__range").agg(F.count("*").alias("n")).orderBy("__range").collect():
        before[r["__range"]], total = total, total + r["n"]
    if total <= n:
        return ranges.select(names)
    whole = [k for k, start in before.items() if start < n]
    last = whole[-1]
    number = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    cut = ranges.filter(F.col("__range") == last).withColumn("__number", number).filter(F.col("__number") <= n - before[last])
    return ranges.filter(F.col("__range").isin(whole[:-1])).select(names).unionByName(cut.select(names))


def crawl(
    seeds: DataFrame, links: DataFrame, prefix: str, most: int | None, rounds: int, checkpoint: Callable[[DataFrame], DataFrame] = lambda df: df.checkpoint(), until: Callable[[], bool] = lambda: False
) -> DataFrame:
    """url and round of up to ``most`` pages (None: all), breadth first: each round takes the new URLs under the
    prefix, the shallowest first, follows their links (from_url, to_url), and stops when nothing is new, when so
    many are known, after some rounds, or when ``until`` says so (a deadline, a spent budget)."""
    depth = F.size(F.filter(F.split(F.regexp_replace("url", "^https?://[^/]*", ""), "/"), lambda s: s != ""))
    seen = None
    frontier = seeds.select("url").distinct()
    taken = 0
    for number in range(rounds):
        fresh = frontier.filter(F.col("url").startswith(prefix))
        if seen is not None:
            fresh = fresh.join(seen, "url", "left_anti")
        fresh = fresh.select("url")
        if most is not None:
            fresh = smallest(fresh, [depth, F.col("url")], most - taken, checkpoint)
        fresh = checkpoint(fresh.withColumn("round", F.lit(number)))
        seen = fresh if seen is None else seen.unionByName(fresh)
        n = taken + fresh.count()
        if n == taken or (most is not None and n >= most) or until():
            break
        taken = n
        frontier = links.join(fresh, F.col("from_url") == F.col("url"), "left_semi").select(F.col("to_url").alias("url")).distinct()
    return seen


def foreach_once(write: Callable[[DataFrame, int], None], done: Callable[[int], bool]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that skips batches written before, so a restart writes nothing twice."""

    def run(batch: DataFrame, batch_id: int) -> None:
        if not done(batch_id):
            write(batch, batch_id)

    return run
