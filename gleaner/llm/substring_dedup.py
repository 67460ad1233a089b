"""Removal of passages of whole words that an earlier document has: seed and extend.

* Seeds. Of each window of ``window`` words, the ``seed``-word sequence of the smallest hash is its anchor
  (winnowing): equal windows have equal anchors at the same place. Neighbouring windows of one anchor
  make a run. A run is the anchor's occurrence with its context, just the words that its windows cover.
* Join. Documents meet on anchors. Anchors of one document alone are dropped; equal contexts of an anchor
  become one, with the smallest id among their documents, before any words are fetched.
* Extend. From each anchor, matches grow word by word to both sides, all occurrences at once: those
  with equal words so far form a class, and whoever is left alone stops. So n occurrences cost n steps
  a word, never n * n pairs. Where the extensions to the left and to the right add up to a window, the
  class of both sides has equal windows, and the smallest id among them is the earliest.
* Keep what is long enough. A document's windows that start in one of a smaller id cover what goes.

An anchor with over ``hot`` different contexts (a common line, say) isn't extended in one task: its
windows are dealt out by two 64-bit hashes of their words, and Spark finds the smallest id of each.
Everything else compares 64-bit hashes of the words, one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm import kernels as K
from gleaner.llm.common import checkpointed, in_parts, release

BLOCK = 2 << 20
#: Bytes of contexts in one bucket.
BUCKET = 8 << 20
SECOND = np.uint64(0xA0761D6478BD642F)
SEEDS = "doc long, key long, anchor long, print long, first int, count int"
CONTEXTS = "bucket int, anchor long, print long, lo long, at int, count int, words binary"
FOUND = "anchor long, print long, spans array<struct<offset:int,count:int,lo:long>>"


def _blocks(batches: Iterator[pa.RecordBatch]):
    """Rows of a batch, a block of texts at a time: the batch, the rows' range, hashes of all words, and offsets
    of the rows in words."""
    for batch in in_parts(batches):
        data, offsets = K.flat(batch.column("text"))
        for a, b in K.blocks(offsets, BLOCK):
            part = data[offsets[a] : offsets[b]]
            first, last, counts = K.word_spans(part, offsets[a : b + 1] - offsets[a])
            yield batch, a, b, K.span_hashes(part, first, last), np.concatenate(([0], np.cumsum(counts)))


class _Job:
    """The steps for one set of parameters; a plain object, so that Spark can ship it."""

    def __init__(self, window: int, seed: int, buckets: int = 1, with_kept: bool = False):
        self.window, self.seed, self.buckets, self.with_kept = window, seed, buckets, with_kept

    def seeds(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each run."""
        for batch, a, _, hashes, offsets in _blocks(batches):
            first, count, anchor, value, print_ = K.anchors(hashes, offsets, self.window, self.seed, 24)
            if len(first):
                row = np.searchsorted(offsets, first, side="right") - 1
                take = pa.array(row + a)
                columns = [batch.column("doc").take(take), batch.column("key").take(take), value.view(np.int64), print_.view(np.int64), (first - offsets[row]).astype(np.int32), count.astype(np.int32)]
                yield pa.record_batch(columns, ["doc", "key", "anchor", "print", "first", "count"])

    def contexts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words of the runs asked for, as hashes; of hot anchors' runs each window on its own, as two.
        Of equal rows, which the join has brought together, one answers."""
        seen: set[tuple[int, int]] = set()
        for batch, a, b, hashes, offsets in _blocks(batches):
            asked = batch.column("asked").slice(a, b - a)
            keys = list(zip(batch.column("doc").slice(a, b - a).to_pylist(), batch.column("key").slice(a, b - a).to_pylist()))
            new = [k not in seen and not seen.add(k) for k in keys]
            row = np.repeat(np.flatnonzero(new), np.diff(asked.offsets.to_numpy())[new])
            runs = asked.filter(pa.array(new)).flatten()
            f = {c: runs.field(c).to_numpy(zero_copy_only=False) for c in ("anchor", "print", "lo", "first", "count", "hot")}
            begin, size = offsets[row] + f["first"], f["count"].astype(np.int64) + self.window - 1
            hot = f["hot"].astype(bool)
            sums = [K.prefix_sums(x) for x in (hashes, K.mix(hashes ^ SECOND))]
            inverse = K.powers(len(hashes) + 1)[1]
            # where in its run the anchor stands
            at = np.zeros(len(begin), np.int64)
            cold = np.flatnonzero(~hot)
            for some in np.array_split(cold, max(1, size[cold].sum() // (1 << 20))):
                if len(some):
                    at[some] = self._anchor_places(sums[0], inverse, begin[some], size[some], f["anchor"][some])
                    binary = [hashes[x:y].tobytes() for x, y in zip(begin[some].tolist(), (begin + size)[some].tolist())]
                    bucket = (K.mix(f["anchor"][some].view(np.uint64)) % np.uint64(self.buckets)).astype(np.int32)
                    yield self._rows(bucket, f, some, at[some], f["count"][some], binary)
            some = np.flatnonzero(hot)
            if len(some):
                n = f["count"][some].astype(np.int64)
                which, shift = np.repeat(some, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = begin[which] + shift
                pair = np.stack([(s[start + self.window] - s[start]) * inverse[start] for s in sums], axis=1)
                yield self._rows(np.full(len(which), -1, np.int32), f, which, shift, np.ones(len(which), np.int32), [p.tobytes() for p in pair])

    @staticmethod
    def _rows(bucket, f, some, at, count, words) -> pa.RecordBatch:
        columns = [bucket, f["anchor"][some], f["print"][some], f["lo"][some], at.astype(np.int32), count.astype(np.int32), pa.array(words, pa.binary())]
        return pa.record_batch(columns, ["bucket", "anchor", "print", "lo", "at", "count", "words"])

    def _anchor_places(self, sums, inverse, begin, size, anchor) -> np.ndarray:
        """All windows of a run hold its anchor, so it lies between the last one's begin and the first one's end."""
        last = size - self.window
        reach = self.window - self.seed + 1 - last  # candidates: last ... window - seed
        shift = np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
        place = np.repeat(begin + last, reach) + shift
        same = K.mix((sums[place + self.seed] - sums[place]) * inverse[place]) == np.repeat(anchor.view(np.uint64), reach)
        # the leftmost of equals is what winnowing takes
        hit = np.flatnonzero(same)
        run = np.repeat(np.arange(len(begin)), reach)[hit]
        new = np.r_[True, run[1:] != run[:-1]]
        return last + shift[hit[new]]

    def extend(self, table: pa.Table) -> pa.Table:
        """For the windows of each context, the smallest id of a document that has an equal one."""
        anchor, lo = (table.column(c).to_numpy() for c in ("anchor", "lo"))
        at, count = (table.column(c).to_numpy().astype(np.int64) for c in ("at", "count"))
        words = np.frombuffer(b"".join(table.column("words").to_pylist()), np.uint64)
        size = count + self.window - 1
        begin = np.cumsum(size) - size
        start = np.unique(anchor, return_inverse=True)[1]
        grow = self.window - self.seed  # words that a window has besides its anchor

        def classes(begin_at: np.ndarray, step: int, room: np.ndarray) -> list[np.ndarray]:
            """Class of each occurrence after 0, 1, ... words to one side; -1 once it is alone."""
            now, out = start.copy(), []
            alone = np.bincount(start)[start] == 1
            now[alone] = -1
            out.append(now)
            for j in range(grow):
                live = np.flatnonzero((out[-1] >= 0) & (room > j))
                now = np.full(len(start), -1)
                if len(live):
                    word, old = words[begin_at[live] + step * j], out[-1][live]
                    order = np.lexsort((word, old))
                    word, old = word[order], old[order]
                    new = np.r_[True, (word[1:] != word[:-1]) | (old[1:] != old[:-1])]
                    number = np.cumsum(new) - 1
                    number[np.bincount(number)[number] == 1] = -1
                    now[live[order]] = number
                out.append(now)
            return out

        right = classes(begin + at + self.seed, 1, size - at - self.seed)
        left = classes(begin + at - 1, -1, at)
        edge = np.cumsum(count) - count
        earliest = np.repeat(lo, count)
        for to_left in range(grow + 1):
            a, b = left[to_left], right[grow - to_left]
            offset = at - to_left
            live = np.flatnonzero((a >= 0) & (b >= 0) & (offset >= 0) & (offset < count))
            if len(live):
                order = live[np.lexsort((lo[live], b[live], a[live]))]
                new = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]
                earliest[edge[order] + offset[order]] = lo[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        run = np.repeat(np.arange(len(count)), count)
        new = np.flatnonzero(np.r_[True, (run[1:] != run[:-1]) | (earliest[1:] != earliest[:-1])])
        length = np.diff(np.r_[new, len(run)])
        spans = pa.StructArray.from_arrays([pa.array((new - edge[run[new]]).astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(earliest[new])], ["offset", "count", "lo"])
        offsets = np.searchsorted(run[new], np.arange(len(count) + 1)).astype(np.int32)
        return pa.table([table.column("anchor"), table.column("print"), pa.ListArray.from_arrays(pa.array(offsets), spans)], ["anchor", "print", "spans"])

    def cut(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            data, offsets = K.flat(batch.column("text"))
            counts = K.word_spans(data, offsets)[2]
            ends = np.concatenate(([0], np.cumsum(counts)))
            spans = batch.column("spans")
            inner = spans.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.nan_to_num(pa.compute.list_value_length(spans).to_numpy(zero_copy_only=False)).astype(np.int64))
            begin = ends[row] + inner.field("offset").to_numpy(zero_copy_only=False).astype(np.int64)
            edge = np.zeros(ends[-1] + 1, np.int64)
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + inner.field("count").to_numpy(zero_copy_only=False) + self.window - 1, -1)
            kept = np.cumsum(edge[:-1]) == 0
            sums = np.concatenate(([0], np.cumsum(~kept)))
            removed = sums[ends[1:]] - sums[ends[:-1]]
            texts = []
            for i in range(batch.num_rows):
                words = data[offsets[i] : offsets[i + 1]].tobytes().split()
                texts.append(b" ".join(compress(words, kept[ends[i] : ends[i + 1]].tolist()) if removed[i] else words))
            columns = [batch.column("doc_id"), pa.array(counts), pa.array(removed), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
            if self.with_kept:
                columns.append(pa.array([t.decode("utf-8", "replace") for t in texts], pa.string()))
            yield pa.record_batch(columns, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: len(columns)])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, doc (the smallest number for a null id), text, and key: with doc, it tells rows apart unless they
    are equal."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.xxhash64("text").alias("key"), "text")


def _shifted(by: Column):
    return lambda s: F.struct((s["offset"] + by).alias("offset"), s["count"].alias("count"))


def _apart(df: DataFrame, *keys: str) -> DataFrame:
    """df, dealt out so that a join by the keys shuffles it too; Spark then splits what a hot key has on the
    join's other side."""
    return df.repartition(F.xxhash64(*keys))


def _shared_seeds(texts: DataFrame, job: _Job) -> DataFrame:
    """Runs of anchors that documents of different ids have."""
    seeds = checkpointed(texts.select("doc", "key", "text").mapInArrow(job.seeds, SEEDS))
    common = seeds.groupBy("anchor").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi").select("anchor")
    return checkpointed(seeds.join(_apart(common, "anchor"), "anchor", "left_semi"))


def _contexts(shared: DataFrame, hot: int) -> DataFrame:
    """One run of each context of an anchor, the smallest and largest ids that have it, how many contexts
    the anchor has (n), and whether these are too many for a task (hot)."""
    # first() of each column comes from one row; any row of a context has its words
    contexts = shared.groupBy("anchor", "print").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), *[F.first(c).alias(c) for c in ("doc", "key", "first", "count")])
    sizes = contexts.groupBy("anchor").agg(F.count("*").alias("n"))
    return checkpointed(contexts.join(_apart(sizes, "anchor"), "anchor").withColumn("hot", F.col("n") > hot))


def earlier_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, seed: int = 10, hot: int = 10_000) -> DataFrame:
    """doc, key, spans: of each document with windows that also start in one of a smaller id, these
    windows, as runs of starts (offset in words, count)."""
    texts = _texts(docs, id_col, text_col)
    shared = _shared_seeds(texts, _Job(window, seed))
    contexts = _contexts(shared, hot)
    numbers = contexts.agg(F.coalesce(F.sum(F.col("count") + window), F.lit(0)), F.coalesce(F.max(F.col("hot").cast("int")), F.lit(0))).first()
    job = _Job(window, seed, max(16, numbers[0] * 8 // BUCKET))
    settled = contexts.filter("n = 1 and lo < hi").select("anchor", "print", F.array(F.struct(F.lit(0).alias("offset"), "count", "lo")).cast("array<struct<offset:int,count:int,lo:long>>").alias("spans"))

    def words_of(some: DataFrame) -> DataFrame:
        asked = some.groupBy("doc", "key").agg(F.collect_list(F.struct("anchor", "print", "lo", "first", "count", "hot")).alias("asked"))
        return texts.select("doc", "key", "text").join(asked, ["doc", "key"]).mapInArrow(job.contexts, CONTEXTS)

    found = settled.unionByName(words_of(contexts.filter("n > 1 and not hot")).groupBy("bucket").applyInArrow(lambda table: job.extend(table), FOUND))
    if numbers[1]:  # an empty branch would still shuffle all texts
        windows = words_of(contexts.filter("hot"))
        earliest = _apart(windows.groupBy("words").agg(F.min("lo").alias("earliest")).withColumnRenamed("words", "__words"), "__words")
        dealt = windows.join(earliest, F.col("words") == F.col("__words"))
        one = F.struct(F.col("at").alias("offset"), F.col("count"), F.col("earliest").alias("lo"))
        found = found.unionByName(dealt.groupBy("anchor", "print").agg(F.collect_list(one).alias("spans")))
    found = _apart(found.dropDuplicates(["anchor", "print"]), "anchor", "print")
    later = F.filter("spans", lambda s: s["lo"] < F.col("doc"))
    hits = shared.join(found, ["anchor", "print"]).select("doc", "key", F.transform(later, _shifted(F.col("first"))).alias("spans")).filter(F.size("spans") > 0)
    return checkpointed(hits.groupBy("doc", "key").agg(F.flatten(F.collect_set("spans")).alias("spans")))


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, seed: int = 10, hot: int = 10_000, with_kept: bool = False) -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by one
    space); with_kept adds kept_text.

    Words are runs of bytes other than white space, as they stand. A word goes if one of the windows of
    ``window`` words that cover it has the words of a window of a document with a smaller id, judged on
    the input; a document's own repeats stay. A null id is smaller than any other, and rows that repeat
    an id don't count as earlier than one another. Null texts count as empty; texts of fewer words than a
    window keep everything. An empty table gives no rows; further columns are ignored. ``seed`` is at most
    ``window``; neither it nor ``hot`` changes a result.
    """
    spans = earlier_windows(docs, id_col, text_col, window, seed, hot)
    release(docs.sparkSession)
    texts = _texts(docs, id_col, text_col).join(spans, ["doc", "key"], "left").select("doc_id", "text", "spans")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_kept
    return texts.mapInArrow(_Job(window, seed, with_kept=with_kept).cut, schema)
