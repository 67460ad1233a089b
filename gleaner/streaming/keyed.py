"""Streams with state of their own for each key: batches by count or pause, first events within a time, and
running numbers of sources. State is kept by Spark in its checkpoint, so a stream goes on where it ended.

The processors see a key's rows of a micro-batch in order of time and tie; across micro-batches, in order of
arrival. Items of a key that waits longer than a pause (by the clock) are handed out by a timer, which starts
anew with each item."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession, ends: bool = False):
    """Streams started within use the state store that keyed state and timers need. Those that end with what
    is there now (``ends``) run no batches without data, for which timers would ask without end; a timer that
    is due then waits for the next run."""
    settings = {PROVIDER: ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": "false" if ends else "true"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _sorted(rows: Iterator[pd.DataFrame]) -> list[tuple[int, int]]:
    return sorted((int(a), int(t)) for part in rows for a, t in zip(part["at"], part["tie"]))


class _Batches(StatefulProcessor):
    def __init__(self, size: int, gap_ms: int):
        self.size, self.gap_ms = size, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "at long, tie long")
        self.number = handle.getValueState("number", "batch long")

    def _out(self, key, ended: list[tuple[str, list[tuple[int, int]]]]) -> pd.DataFrame:
        """The items of batches that have ended. Each call to the state waits for an answer: the number is asked for
        and stored once, and all batches are one frame."""
        known = self.number.get()
        n = int(known[0]) if known else 0
        self.number.update((n + len(ended),))
        rows = [(key[0], n + i, at, tie, reason) for i, (reason, items) in enumerate(ended) for at, tie in items]
        return pd.DataFrame(rows, columns=["key", "batch", "at", "tie", "reason"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        waiting = [(int(a), int(t)) for a, t in self.pending.get()] if self.pending.exists() else []
        waited = bool(waiting)
        ended = []
        for at, tie in _sorted(rows):
            if waiting and at - waiting[-1][0] >= self.gap_ms:
                ended.append(("pause", waiting))
                waiting = []
            waiting.append((at, tie))
            if len(waiting) == self.size:
                ended.append(("full", waiting))
                waiting = []
        if waited:  # only what waits has a timer
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
        if waiting:
            self.pending.put(waiting)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.gap_ms)
        elif waited:
            self.pending.clear()
        if ended:
            yield self._out(key, ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting = [(int(a), int(t)) for a, t in self.pending.get()] if self.pending.exists() else []
        self.pending.clear()
        if waiting:
            yield self._out(key, [("idle", waiting)])

    def close(self) -> None:
        pass


def batches(stream: DataFrame, key: str, at: str, tie: str, size: int, gap_ms: int) -> DataFrame:
    """key, batch (0, 1, ... within a key), at, tie and reason of the items of each batch that has ended: after
    ``size`` items, before an item that comes gap_ms or more after the last one, or when none has come for
    gap_ms. A null key is left out."""
    rows = stream.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(at).cast("long").alias("at"), F.col(tie).cast("long").alias("tie"))
    kind = dict(rows.dtypes)["key"]
    return rows.groupBy("key").transformWithStateInPandas(_Batches(size, gap_ms), f"key {kind}, batch long, at long, tie long, reason string", "Update", "ProcessingTime")


def waiting(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What a stream of ``batches`` that has ended still holds: key, at, tie, and the batch it would have been."""
    state = lambda name: spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    pending = state("pending").select(F.col("key.key").alias("key"), F.col("list_element.at").alias("at"), F.col("list_element.tie").alias("tie"))
    numbers = state("number").select(F.col("key.key").alias("__key"), F.col("value.batch").alias("__n"))
    return pending.join(numbers, F.col("key") == F.col("__key"), "left").select("key", F.coalesce("__n", F.lit(0)).alias("batch"), "at", "tie", F.lit("end").alias("reason"))


class _First(StatefulProcessor):
    def __init__(self, within_ms: int):
        self.within_ms = within_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "at long", ttlDurationMs=self.within_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = _sorted(rows)[0]
        if not self.seen.exists():
            self.seen.update((first[0],))
            yield pd.DataFrame({"key": [key[0]], "at": [first[0]], "tie": [first[1]]})

    def close(self) -> None:
        pass


def first_of_each(stream: DataFrame, key: str, at: str, tie: str, within_ms: int) -> DataFrame:
    """key, at and tie of the first item of each key; a key is forgotten within_ms (by the clock) after that."""
    rows = stream.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(at).cast("long").alias("at"), F.col(tie).cast("long").alias("tie"))
    return rows.groupBy("key").transformWithStateInPandas(_First(within_ms), f"key {dict(rows.dtypes)['key']}, at long, tie long", "Append", "ProcessingTime")


class _Sources(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.urls = handle.getMapState("urls", "url string", "batch long")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        firsts, new = {}, {}
        for part in rows:
            part = part.dropna(subset=["batch"]) if part["batch"].hasnans else part
            for batch, url in zip(part["batch"].tolist(), part["url"].tolist()):
                new[int(batch)] = 0
                firsts[url] = min(int(batch), firsts.get(url, int(batch)))
        counted = self.count.get()
        known = total = int(counted[0]) if counted else 0
        # each call to the state waits for an answer: what is known is read at once, unless it is much more than what has come
        if known <= 8 * len(firsts):
            before = {u for (u,) in self.urls.keys()} if known else set()
        else:
            before = {u for u in firsts if self.urls.containsKey((u,))}
        for url, batch in firsts.items():
            if url not in before:
                self.urls.updateValue((url,), (batch,))
                new[batch] += 1
        out = []
        for batch in sorted(new):
            total += new[batch]
            out.append((key[0], batch, new[batch], total))
        if total > known:
            self.count.update((total,))
        yield pd.DataFrame(out, columns=["session", "batch", "new", "known"])

    def close(self) -> None:
        pass


def running_sources(stream: DataFrame, session: str, batch: str, url: str) -> DataFrame:
    """session, batch, new and known: how many sources a batch has brought, and how many there are by then. A
    batch that goes on in a later micro-batch gives a further row for what that brings."""
    rows = stream.filter(F.col(session).isNotNull() & F.col(url).isNotNull()).select(F.col(session).alias("session"), F.col(batch).cast("long").alias("batch"), F.col(url).cast("string").alias("url"))
    return rows.groupBy("session").transformWithStateInPandas(_Sources(), f"session {dict(rows.dtypes)['session']}, batch long, new long, known long", "Update", "None")
