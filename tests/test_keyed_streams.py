"""Streams over files, started anew after each file, against their batch forms."""

import random
import time

import pandas as pd
from pyspark.sql import functions as F

from gleaner import sinks
from gleaner.streaming import flows as S
from gleaner.streaming import keyed as K

SCHEMA = "k string, at long, n long"


def run_in_parts(spark, tmp_path, parts, schema, make):
    """Writes one part after another and runs the stream over what is new each time, from its checkpoint."""
    source, log, progress = (str(tmp_path / x) for x in ("in", "log", "progress"))
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        with K.keyed_state(spark, ends=True):
            run = make(spark.readStream.schema(schema).parquet(source)).writeStream.outputMode("update").foreachBatch(sinks.batch_writer(log)).option("checkpointLocation", progress).trigger(availableNow=True).start()
            assert run.awaitTermination(120)
    return spark.read.parquet(f"{log}/*").collect(), progress


def test_batches_by_count_or_pause(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "b", "hot", "hot", "hot"]), rnd.randrange(5_000_000), i) for i in range(150)]
    rows.sort(key=lambda r: r[1:])
    parts = [rows[:60], rows[60:90], rows[90:] + [(None, 6_000_000, 999)]]
    got, progress = run_in_parts(spark, tmp_path, parts, SCHEMA, lambda s: K.batches(s, "k", "at", "n", 4, 100_000))
    got = [(r.key, r.batch, r.at, r.tie) for r in got]
    left = [(r.key, r.batch, r.at, r.tie) for r in K.waiting(spark, progress).collect()]
    want = [(r.k, r.batch, r.at, r.n) for r in S.microbatches(spark.createDataFrame(rows, SCHEMA), ["k"], "at", "n", 4, 100_000).collect()]
    assert sorted(got + left) == sorted(want) and left
    last = {k: max(b for key, b, *_ in want if key == k) for k in ("a", "b", "hot")}
    assert all(b == last[k] for k, b, *_ in left)  # what waits is the last batch


class Kept:
    """Calls to a state that keeps one key's value."""

    def __init__(self, value=None):
        self.value, self.calls, self.timers = value, 0, []

    def __getattr__(self, name):
        def call(*given):
            self.calls += 1
            if name in ("update", "put"):
                self.value = given[0]
            elif name == "clear":
                self.value = None
            elif name == "registerTimer":
                self.timers.append(given[0])
            elif name == "deleteTimer":
                self.timers.remove(given[0])
            return {"exists": self.value is not None, "get": self.value, "listTimers": list(self.timers)}.get(name)

        return call

    getCurrentProcessingTimeInMs = staticmethod(lambda: 1000)


def test_calls_to_the_state_do_not_grow_with_the_batches_of_a_key():
    made = K._Batches(3, 100)
    made.handle, made.pending, made.number = Kept(), Kept(), Kept()
    calls = []
    for start in (0, 1000):
        frames = list(made.handleInputRows(("k",), iter([pd.DataFrame({"at": range(start, start + 1000), "tie": range(1000)})]), Kept()))
        calls.append(made.handle.calls + made.pending.calls + made.number.calls)
        assert len(frames) == 1 and list(frames[0].columns) == ["key", "batch", "at", "tie", "reason"]
        assert made.handle.timers == [1100] and made.number.value == ((333,) if start == 0 else (666,))
    # 333 batches and one item that waits, then with that item 333 and two
    assert len(frames[0]) == 999 and list(frames[0]["batch"])[:4] == [333, 333, 333, 334] and len(made.pending.value) == 2
    assert calls[0] <= 6 and calls[1] - calls[0] <= 9


def test_an_idle_batch_is_handed_out_by_its_timer(spark, tmp_path):
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    spark.createDataFrame([("a", 1, 1), ("a", 2, 2)], SCHEMA).coalesce(1).write.parquet(source)
    with K.keyed_state(spark):
        stream = K.batches(spark.readStream.schema(SCHEMA).parquet(source), "k", "at", "n", 100, 1500)
        run = stream.writeStream.outputMode("update").foreachBatch(sinks.batch_writer(log)).option("checkpointLocation", str(tmp_path / "progress")).trigger(processingTime="500 milliseconds").start()
        try:
            until = time.time() + 60
            rows = []
            while time.time() < until and not rows:
                time.sleep(1)
                try:
                    rows = [(r.key, r.batch, r.tie, r.reason) for r in spark.read.parquet(f"{log}/*").collect()]
                except Exception:  # nothing written yet
                    rows = []
        finally:
            run.stop()
    assert sorted(rows) == [("a", 0, 1, "idle"), ("a", 0, 2, "idle")]


def test_first_of_each_key(spark, tmp_path):
    parts = [[("a", 5, 1), ("b", 6, 2), ("a", 4, 3)], [("a", 7, 4), ("c", 8, 5), (None, 1, 6)], [("b", 9, 7)]]
    got, _ = run_in_parts(spark, tmp_path, parts, SCHEMA, lambda s: K.first_of_each(s, "k", "at", "n", 3_600_000).withColumn("x", F.lit(1)))
    assert sorted((r.key, r.at, r.tie) for r in got) == [("a", 4, 3), ("b", 6, 2), ("c", 8, 5)]


def test_running_sources(spark, tmp_path):
    rnd = random.Random(6)
    rows = [(rnd.choice(["s", "t"]), b, f"u{rnd.randrange(25)}", i) for i, b in enumerate(sorted(rnd.randrange(9) for _ in range(120)))]
    schema = "s string, b long, u string, n long"
    parts = [[r for r in rows if lo <= r[1] < hi] for lo, hi in ((0, 3), (3, 4), (4, 9))]
    got, _ = run_in_parts(spark, tmp_path, parts, schema, lambda s: K.running_sources(s, "s", "b", "u"))
    want = S.running_sources(spark.createDataFrame(rows, schema), "s", "b", "u", "n").collect()
    assert sorted((r.session, r.batch, r.new, r.known) for r in got) == sorted((r.s, r.b, r.new, r.known) for r in want)


class Sources(dict):
    """Calls to a state that keeps one key's sources."""

    calls = 0

    def keys(self):
        self.calls += 1
        return list(super().keys())

    def containsKey(self, url):
        self.calls += 1
        return url in self

    def updateValue(self, url, batch):
        self.calls += 1
        self[url] = batch


def test_calls_to_the_state_do_not_grow_with_the_batches_of_a_session():
    made = K._Sources()
    made.urls, made.count = Sources(), Kept()
    frame = pd.DataFrame({"batch": [b for b in range(100) for _ in range(3)], "url": [f"u{n % 4}" for n in range(300)]})
    first, again = (next(made.handleInputRows(("s",), iter([frame.iloc[::2], frame.iloc[1::2]]), None)) for _ in range(2))
    assert list(first["new"]) == [3, 1] + [0] * 98 and list(first["known"]) == [3] + [4] * 99
    assert list(again["new"]) == [0] * 100 and list(again["known"]) == [4] * 100 and list(again["batch"]) == list(range(100))
    assert made.urls == {("u0",): (0,), ("u1",): (0,), ("u2",): (0,), ("u3",): (1,)} and made.urls.calls == 5 and made.count.calls == 3
    # few urls against many known ones are asked for one by one
    made.urls.update({(f"v{n}",): (0,) for n in range(100)})
    made.count.value = (104,)
    few = next(made.handleInputRows(("s",), iter([pd.DataFrame({"batch": [7, 7], "url": ["v5", "w"]})]), None))
    assert few.values.tolist() == [["s", 7, 1, 105]] and made.urls.calls == 8
