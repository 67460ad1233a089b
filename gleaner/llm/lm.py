"""Language-model scoring with Brown's class-based bigrams.

Words are bytes outside white space, A-Z lower-cased, and one end token a text. All counts come from
every training text:

1. Spark counts all words (by 64-bit hash). The ``clustered`` most frequent ones start the classes;
   every other word starts in an open class by its last two bytes.
2. Spark counts bigrams of these items, a matrix of fixed size. Exchange clustering assigns the
   ``clustered`` words to classes: each word in turn moves to the class that raises the likelihood of
   the class bigrams most.
3. Every word of the training texts joins in: Spark counts, for each word, the classes of the words
   before and after it, and each word moves to the class that raises the likelihood most, all words of
   a round at once. Tasks reduce their counts to packed rows, one for each range of hashes, so that
   neither a frequent word nor a frequent pair is a hot key, and a range is read into counts of bounded
   size. The matrix of class bigrams, which is counted again after each round, gets the classes of the
   ``frequent`` most frequent words, which are shipped, from memory and those of all others by a join. A
   round that lowers the likelihood is taken back. A word that training hasn't seen counts to the class
   that most kinds of words with its last two bytes (hashed to an open class) are in.
4. A word costs p(class | class before) * p(word | class), mixed with its unigram probability, by
   weights that depend on how often the class before was seen (Witten-Bell):
   (count + 0.5) * [w * p(c | c') / emissions(c) + (1 - w) / total].

Counts and classes of the ``frequent`` most frequent words are shipped to all tasks; those of all other
words reach their documents by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import kernels as K
from gleaner.llm.common import checkpointed, empty_caches, held_out_remainder, most_frequent, shuffle_partitions, small_batches

BLOCK = 4 << 20
PSEUDO = 0.5
#: Stands for the end token among word hashes.
END = np.uint64(0xFFFFFFFFFFFFFFFF)


def _word_batches(batches: Iterator[pa.RecordBatch], column: str = "text"):
    """(batch, first row, last row, hash, row, last two bytes, words in each row) by blocks."""
    for batch in batches:
        data, offsets = K.flat(batch.column(column))
        for start, end in K.blocks(offsets, BLOCK):
            part, at = data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
            hashes, row, counts, tails = K.words_with_tails(part, at)
            yield batch, start, end, hashes, row, tails, counts


def _bucket(tails: np.ndarray, open_classes: int) -> np.ndarray:
    return (K.mix(tails.astype(np.uint64)) % np.uint64(open_classes)).astype(np.int64)


def word_counts(texts: DataFrame, open_classes: int) -> DataFrame:
    """word (64-bit hash), bucket (open class by the last two bytes) and n over the column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0

        def out():
            words, buckets, n = (np.concatenate(x) for x in zip(*kept))
            words, first, where = np.unique(words, return_index=True, return_inverse=True)
            n = np.bincount(where, n, len(words)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(buckets[first]), pa.array(n)], ["word", "bucket", "n"])

        for _, _, _, hashes, _, tails, _ in _word_batches(batches):
            words, first, n = np.unique(hashes, return_index=True, return_counts=True)
            kept.append((words, _bucket(tails[first], open_classes), n))
            size += len(words)
            if size > 4_000_000:
                yield out()
                kept, size = [], 0
        if kept:
            yield out()

    table = texts.mapInArrow(run, "word long, bucket long, n long")
    return table.groupBy("word").agg(F.min("bucket").alias("bucket"), F.sum("n").alias("n"))


def _stream(values: np.ndarray, counts: np.ndarray, end) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left and right value of every bigram of some rows, and its row: ``end`` stands before the first
    word of a row and after its last."""
    rows = len(counts)
    n = len(values) + rows
    ends = np.cumsum(counts + 1) - 1
    right = np.empty(n, values.dtype)
    inner = np.ones(n, bool)
    inner[ends] = False
    right[ends], right[inner] = end, values
    left = np.empty(n, values.dtype)
    left[1:] = right[:-1]
    left[ends - counts] = end
    return left, right, np.repeat(np.arange(rows), counts + 1)


class Items:
    """Item numbers: closed words by falling count, then open classes, then the end token."""

    def __init__(self, closed: np.ndarray, open_classes: int):
        self.order = np.argsort(closed)
        self.sorted, self.closed, self.open = closed[self.order], len(closed), open_classes
        self.end = self.closed + open_classes
        self.size = self.end + 1

    def of(self, hashes: np.ndarray, tails: np.ndarray) -> np.ndarray:
        item = self.closed + _bucket(tails, self.open)
        if self.closed:
            at = np.minimum(np.searchsorted(self.sorted, hashes), self.closed - 1)
            item = np.where(self.sorted[at] == hashes, self.order[at], item)
        return item


def item_bigrams(texts: DataFrame, items: Items) -> np.ndarray:
    """Bigram counts of items over the column ``text``, at most size * size numbers."""
    size = items.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for _, _, _, hashes, _, tails, counts in _word_batches(batches):
            left, right, _ = _stream(items.of(hashes, tails), counts, items.end)
            keys, n = np.unique(left * size + right, return_counts=True)
            total[keys] += n
        keys = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total[keys])], ["pair", "n"])

    table = texts.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    matrix = np.zeros(size * size)
    matrix[table.column("pair").to_numpy()] = table.column("n").to_numpy()
    return matrix.reshape(size, size)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def exchange_clusters(bigrams: np.ndarray, closed: int, classes: int, sweeps: int = 3) -> np.ndarray:
    """The class of every item. Closed words start dealt out by frequency and move while that raises the
    likelihood of the class bigrams; all other items are classes of their own."""
    size = len(bigrams)
    classes = min(classes, max(1, closed))
    of = np.concatenate((np.arange(closed) % classes, classes + np.arange(size - closed)))
    n = classes + size - closed
    member = np.zeros((size, n))
    member[np.arange(size), of] = 1
    right, left = bigrams @ member, bigrams.T @ member  # of each item: counts after and before it, by class
    joint = member.T @ right
    own = np.diag(bigrams)
    for _ in range(sweeps if closed and classes > 1 else 0):
        moved = 0
        for w in range(closed):
            r, c, s, k = right[w].copy(), left[w].copy(), own[w], of[w]
            r[k] -= s
            c[k] -= s
            joint[k] -= r
            joint[:, k] -= c
            joint[k, k] -= s
            total_r, total_c = r.sum() + s, c.sum() + s
            row, column = joint[:classes], joint[:, :classes].T
            gain = (_xlogx(row + r) - _xlogx(row)).sum(1) + (_xlogx(column + c) - _xlogx(column)).sum(1)
            spot = np.diag(joint)[:classes]
            r1, c1 = r[:classes], c[:classes]
            gain += _xlogx(spot + r1 + c1 + s) - _xlogx(spot + r1) - _xlogx(spot + c1) + _xlogx(spot)
            out, into = joint.sum(1)[:classes], joint.sum(0)[:classes]
            gain -= _xlogx(out + total_r) - _xlogx(out) + _xlogx(into + total_c) - _xlogx(into)
            best = int(np.argmax(gain))
            if gain[best] <= gain[k] + 1e-9:
                best = k
            joint[best] += r
            joint[:, best] += c
            joint[best, best] += s
            if best != k:
                moved += 1
                of[w] = best
                for matrix, counts in ((right, bigrams[:, w]), (left, bigrams[w])):
                    matrix[:, k] -= counts
                    matrix[:, best] += counts
        if not moved:
            break
    return of


class Lookup:
    """Counts and classes of some words; -1 is the class of any other."""

    def __init__(self, words: np.ndarray, n: np.ndarray, classes: np.ndarray):
        order = np.argsort(words)
        self.words, self.n, self.classes = words[order], n[order], classes[order]

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each word is here, its count (0 if not) and its class."""
        if not len(self.words):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64), np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        hit = self.words[at] == hashes
        return hit, np.where(hit, self.n[at], 0), np.where(hit, self.classes[at], -1)

    @classmethod
    def shipped(cls, assigned: DataFrame, frequent: int) -> Lookup:
        top = most_frequent(assigned, frequent).select("word", "n", "class").toArrow()
        return cls(top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy(), top.column("class").to_numpy())


#: Words whose contexts a reducing task holds at once, on average.
HELD = 20_000
#: Words of a task that are reduced to counts and sent at once.
SENT = 1_000_000
PARCEL = "target int, kind int, words binary, sizes binary, slots binary, counts binary"
_STATE, _CONTEXT = 0, 1


def _targets(words: np.ndarray, targets: int) -> np.ndarray:
    """The target of each word; it doesn't fall where hashes rise."""
    return ((words >> np.uint64(32)) * np.uint64(targets) >> np.uint64(32)).astype(np.int64)


def _parcels(kind: int, targets: int, words: np.ndarray, sizes: np.ndarray, slots: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A row for each target: its words (ascending hashes), and the slots and counts of each word."""
    of = _targets(words, targets)
    cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
    ends, at = np.r_[cuts[1:], len(of)], np.concatenate(([0], np.cumsum(sizes)))
    packed = [
        [words[a:b].astype("<u8").tobytes() for a, b in zip(cuts, ends)], [sizes[a:b].astype("<u4").tobytes() for a, b in zip(cuts, ends)],
        *([x[at[a] : at[b]].astype(t).tobytes() for a, b in zip(cuts, ends)] for x, t in ((slots, "<u2"), (counts, "<u4"))),
    ]
    columns = [pa.array(of[cuts], pa.int32()), pa.array(np.full(len(cuts), kind), pa.int32()), *(pa.array(x, pa.binary()) for x in packed)]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PARCEL.split(", ")])


def _beside(values: np.ndarray, counts: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    """What stands before and after every word; ``end`` where nothing does."""
    before, after = np.r_[values[:1], values[:-1]], np.r_[values[1:], values[:1]]
    stop = np.cumsum(counts)
    some = counts > 0
    before[(stop - counts)[some]] = end
    after[stop[some] - 1] = end
    return before, after


def contexts(texts: DataFrame, near: Lookup, still: np.ndarray, size: int, classes: int, open_classes: int, targets: int, opened: bool) -> DataFrame:
    """Parcels of every word outside ``still`` (ascending): how often which class stands after it (slots
    below ``size``) and before it (slots from ``size`` on). near has the classes of neighbours; others
    count to their open class (opened) or not at all. Each task reduces its words before it sends them."""
    sent = texts.sparkSession.sparkContext.broadcast((near, still))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty_caches()
        near, still = sent.value
        kept, total = [], 0

        def out() -> pa.RecordBatch:
            words, before, after = (np.concatenate(x) for x in zip(*kept))
            unique, where = np.unique(words, return_inverse=True)
            keys = [where[s >= 0] * (2 * size) + s[s >= 0] for s in (after.astype(np.int64), np.where(before >= 0, before.astype(np.int64) + size, -1))]
            keys, n = np.unique(np.concatenate(keys), return_counts=True)
            return _parcels(_CONTEXT, targets, unique, np.bincount(keys // (2 * size), minlength=len(unique)), keys % (2 * size), n)

        for _, _, _, hashes, _, tails, counts in _word_batches(batches):
            c = near.of(hashes)[2].astype(np.int16)
            if opened:
                c = np.where(c < 0, classes + _bucket(tails, open_classes), c).astype(np.int16)
            before, after = _beside(c, counts, size - 1)
            moves = ~_contains(still, hashes)
            kept.append((hashes[moves], before[moves], after[moves]))
            total += len(kept[-1][0])
            if total > SENT:
                yield out()
                kept, total = [], 0
        if total:
            yield out()

    return texts.mapInArrow(run, PARCEL)


def _contains(ascending: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(values), bool)
    return ascending[np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)] == values


def class_bigrams(texts: DataFrame, lookup: Lookup, assigned: DataFrame, size: int) -> np.ndarray:
    """Counts of class bigrams, apart for bigrams of two shipped words (0), with only the second (1) or
    the first (2) one shipped, and of two others (3): four matrices of size * size. The classes of words
    that aren't shipped come by a join, of counts that the tasks have reduced."""
    sent = texts.sparkSession.sparkContext.broadcast(lookup)
    end, whole = size - 1, size * size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty_caches()
        lookup, total, names = sent.value, np.zeros(whole, np.int64), ["word", "near", "cell", "n"]
        for _, _, _, hashes, _, _, counts in _word_batches(batches):
            left, right, _ = _stream(lookup.of(hashes)[2].astype(np.int32), counts, end)
            first, second, _ = _stream(hashes, counts, END)
            met = (left >= 0) & (right >= 0)
            total += np.bincount(left[met].astype(np.int64) * size + right[met], minlength=whole)
            for word, cell, take in ((first, whole + right, (left < 0) & (right >= 0)), (second, 2 * whole + left * size, (left >= 0) & (right < 0))):
                word, cell = word[take].view(np.int64), cell[take].astype(np.int64)
                order = np.lexsort((cell, word))
                word, cell = word[order], cell[order]
                new = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (cell[1:] != cell[:-1])]) if len(word) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(word[new]), pa.nulls(len(new), pa.int64()), pa.array(cell[new]), pa.array(np.diff(np.r_[new, len(word)]))], names)
            both = (left < 0) & (right < 0)
            word, near = first[both].view(np.int64), second[both].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(near), pa.array(np.full(len(word), 3 * whole)), pa.array(np.ones(len(word), np.int64))], names)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(cells), pa.int64()), pa.nulls(len(cells), pa.int64()), pa.array(cells), pa.array(total[cells])], names)

    of = assigned.select("word", "class")
    rows = texts.mapInArrow(run, "word long, near long, cell long, n long")
    # a first word's class is the row of the matrix, a second one's the column; cells of two shipped words are as they are
    rows = rows.withColumn("key", F.coalesce("word", -1 - F.col("cell")))  # no null keys: these would all meet in one task
    rows = rows.join(of.withColumnRenamed("word", "w"), F.col("key") == F.col("w"), "left")
    part = F.expr(f"cell div {whole}")
    cell = F.when(part == 2, F.col("cell") + F.col("class")).when(part > 0, F.col("cell") + F.col("class") * size).otherwise(F.col("cell"))
    first = rows.select("near", cell.alias("cell"), "n").groupBy("near", "cell").agg(F.sum("n").alias("n"))
    first = first.withColumn("key", F.coalesce("near", -1 - F.col("cell")))
    second = first.join(of.select(F.col("word").alias("w"), F.col("class").alias("column")), F.col("key") == F.col("w"), "left")
    second = second.select((F.col("cell") + F.when(F.col("near").isNotNull(), F.col("column")).otherwise(F.lit(0))).alias("cell"), "n")
    table = second.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    joint = np.zeros(4 * whole)
    joint[table.column("cell").to_numpy()] = table.column("n").to_numpy()
    return joint.reshape(4, size, size)


def likelihood(joint: np.ndarray) -> float:
    return float(_xlogx(joint).sum() - _xlogx(joint.sum(0)).sum() - _xlogx(joint.sum(1)).sum())


class Gains:
    """How much a word's pairs raise the likelihood in each class. after: counts of the classes (rows) by
    what stands after them; before: by what stands before."""

    def __init__(self, after: np.ndarray, before: np.ndarray, classes: int, tabled: int = 32):
        self.classes, self.sums = classes, (after.sum(1), before.sum(1))
        self.table = np.concatenate((after.T, before.T))  # by slot
        self.plain = _xlogx(self.table)
        self.steps = np.array([_xlogx(self.table + n) - self.plain for n in range(tabled)])

    def best(self, now: np.ndarray, owner: np.ndarray, slot: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The class that each word, taken out of its present one (``now``; from ``classes`` on: none), raises
        the likelihood most in, while its neighbours keep their classes. owner, which rises, slot and n
        are the words' pairs."""
        classes, size = self.classes, len(self.table) // 2
        gain, at = np.zeros((len(now), classes)), np.arange(len(now))
        for begin in range(0, len(owner), 20_000):
            o, s, k = (x[begin : begin + 20_000] for x in (owner, slot, n))
            many = np.flatnonzero(k >= len(self.steps))
            step = self.steps[np.where(k < len(self.steps), k, 0), s]
            if len(many):
                step[many] = _xlogx(self.table[s[many]] + k[many, None]) - self.plain[s[many]]
            mine = np.flatnonzero(now[o] < classes)
            own = self.table[s[mine], now[o[mine]]]
            step[mine, now[o[mine]]] = _xlogx(own) - _xlogx(np.maximum(own - k[mine], 0))
            starts = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
            gain[o[starts]] += np.add.reduceat(step, starts)
        inside = np.flatnonzero(now < classes)
        for side, sums in enumerate(self.sums):
            of = (slot >= size) == bool(side)
            total = np.bincount(owner[of], n[of], len(now))
            kinds, where = np.unique(total, return_inverse=True)  # few: most words are rare
            loss = (_xlogx(sums[None] + kinds[:, None]) - _xlogx(sums)[None])[where]
            own = sums[now[inside]]
            loss[inside, now[inside]] = _xlogx(own) - _xlogx(np.maximum(own - total[inside], 0))
            gain -= loss
        best = gain.argmax(1)
        stay = (now < classes) & (gain[at, best] <= gain[at, np.minimum(now, classes - 1)] + 1e-9)
        return np.where(stay, now, best)


def moved(found: DataFrame, assigned: DataFrame, gains: Gains, still: np.ndarray, targets: int) -> DataFrame:
    """word, bucket, n and class of all words after a round; those of ``still`` keep their class. A task
    reads the parcels of a target one after another into the counts of its words."""
    spark = found.sparkSession
    sent = spark.sparkContext.broadcast((gains, still))
    names = ["word", "bucket", "n", "class"]

    def state(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, bucket, n, c = (batch.column(x).to_numpy(zero_copy_only=False) for x in names)
            order = np.argsort(word.view(np.uint64), kind="stable")
            ones = np.full(len(word), 4)
            # four counts of a word: bucket, class, and the two halves of n
            counts = np.stack((bucket, c, n >> 32, n & 0xFFFFFFFF), 1)[order]
            yield _parcels(_STATE, targets, word.view(np.uint64)[order], ones, np.zeros(4 * len(word), np.int64), counts.ravel())

    parcels = assigned.select(*names).mapInArrow(state, PARCEL).unionByName(found)
    parcels = parcels.repartition(min(targets, 64 * shuffle_partitions(spark)), "target").sortWithinPartitions("target", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty_caches()
        gains, still = sent.value
        size = len(gains.table) // 2

        def settled(states: list) -> tuple:
            words, counts = np.concatenate([w for w, _ in states]), np.concatenate([c for _, c in states]).reshape(-1, 4)
            order = np.argsort(words)
            return words[order], counts[order], np.zeros((len(words), 2 * size), np.int64)

        def out(words: np.ndarray, counts: np.ndarray, beside: np.ndarray) -> pa.RecordBatch:
            owner, slot = np.nonzero(beside)
            best = gains.best(counts[:, 1], owner, slot, beside[owner, slot])
            best = np.where(_contains(still, words) | ~beside.any(1), counts[:, 1], best)
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts[:, 0]), pa.array(counts[:, 2] << 32 | counts[:, 3]), pa.array(best)], names)

        target, states, held = None, [], None
        for batch in batches:
            for row in batch.to_pylist():
                if row["target"] != target:
                    if target is not None:
                        yield out(*(held or settled(states)))
                    target, states, held = row["target"], [], None
                word, sizes, slots, counts = (np.frombuffer(row[c], t) for c, t in (("words", "<u8"), ("sizes", "<u4"), ("slots", "<u2"), ("counts", "<u4")))
                if row["kind"] == _STATE:  # these come first
                    states.append((word, counts.astype(np.int64)))
                    continue
                held = held or settled(states)
                at = np.repeat(np.searchsorted(held[0], word), sizes)
                held[2][at, slots] += counts
        if target is not None:
            yield out(*(held or settled(states)))

    return checkpointed(parcels.mapInArrow(run, "word long, bucket long, n long, class long"))


def cluster_all(training: DataFrame, counts: DataFrame, items: Items, item_class: np.ndarray, bigrams: np.ndarray, classes: int, frequent: int, rounds: int, distinct: int) -> tuple[DataFrame, Lookup, np.ndarray]:
    """The class of every training word (word, bucket, n, class), the shipped words, and the class bigrams.

    In the first round a word's neighbours are the closed words, by class, and all others by open class;
    in later rounds, the shipped words by class. Closed words stay where exchange has put them."""
    spark, size = counts.sparkSession, classes + items.open + 1
    targets = max(shuffle_partitions(spark), -(-distinct // HELD))
    closed = items.sorted.view(np.int64).tolist()
    first = spark.createDataFrame(list(zip(closed, item_class[items.order].tolist())), "word long, first long")
    assigned = counts.join(F.broadcast(first), "word", "left").select("word", "bucket", "n", F.coalesce("first", classes + F.col("bucket")).alias("class"))
    member = np.zeros((len(bigrams), size))
    member[np.arange(len(bigrams)), item_class] = 1
    joint = member.T @ bigrams @ member
    near, after, before_ = Lookup(items.sorted, np.ones(items.closed, np.int64), item_class[items.order]), joint[:classes], joint[:, :classes].T
    best = None
    for k in range(max(1, rounds)):
        found = contexts(training, near, items.sorted, size, classes, items.open, targets, k == 0)
        assigned = moved(found, assigned, Gains(after, before_, classes), items.sorted, targets)
        near = Lookup.shipped(assigned, frequent)
        parts = class_bigrams(training, near, assigned, size)
        joint = parts.sum(0)
        if best and likelihood(joint) <= likelihood(best[2]):
            break
        best = assigned, near, joint
        after, before_ = (parts[0] + parts[1])[:classes], (parts[0] + parts[2])[:, :classes].T
    return best


class ClassModel:
    """log10 of the bracket of the module's formula for every pair of classes. types: words in each class;
    opened: whether unseen words count to it; fallback: the class of unseen words by bucket."""

    def __init__(self, joint: np.ndarray, types: np.ndarray, opened: np.ndarray, fallback: np.ndarray):
        emissions = joint.sum(0) + PSEUDO * (types + opened)
        total = emissions.sum()
        prior = emissions / max(total, 1e-300)
        seen = joint.sum(1)
        kinds = (joint > 0).sum(1)
        weight = (seen / np.maximum(seen + kinds, 1))[:, None]
        transition = weight * joint / np.maximum(seen, 1)[:, None] + (1 - weight) * prior
        trust = (seen / (seen + 50.0))[:, None] * 0.95
        with np.errstate(divide="ignore", invalid="ignore"):
            per_emission = np.where(emissions > 0, transition / emissions, 0.0)
            self.table = np.log10(np.maximum(trust * per_emission + (1 - trust) / max(total, 1.0), 1e-300))
        self.fallback = fallback


def score_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out=None, clustered: int = 1000, classes: int = 50, open_classes: int = 64, frequent: int = 300_000, sweeps: int = 3, rounds: int = 2
) -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    perplexity (by the class model, of its own tokens).

    held_out: a boolean column of docs (default: crc32 of the id as text, modulo 5, is 1); its documents,
    and those where it is null, are scored but not learned from. Null text counts as empty: one end
    token. Texts of any length are scored whole. Rows that repeat an id and text are all returned. With
    no training text all counts are 0. An empty table gives no rows. Words are told apart by 64-bit
    hashes.
    """
    small_batches(docs.sparkSession)
    if held_out is None:
        held_out = held_out_remainder(id_col, 5) == 1
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(held_out, F.lit(True)).alias("held_out"))
    training = narrow.filter(~F.col("held_out")).select("text")
    counts = checkpointed(word_counts(training, open_classes))
    n_texts = training.count()
    tokens, words = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, distinct = tokens + n_texts, words + (n_texts > 0)
    top = most_frequent(counts, frequent).toArrow()
    top_words, top_n = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy()
    items = Items(top_words[np.lexsort((top_words, -top_n))][:clustered].copy(), open_classes)
    bigrams = item_bigrams(training, items)
    item_class = exchange_clusters(bigrams, items.closed, classes, sweeps)
    classes = min(classes, max(1, items.closed))
    assigned, lookup, joint = cluster_all(training, counts, items, item_class, bigrams, classes, frequent, rounds, words)
    kinds = np.zeros((open_classes, len(joint)))
    for r in assigned.groupBy("bucket", "class").agg(F.count("*").alias("kinds")).collect():
        kinds[r["bucket"], r["class"]] = r["kinds"]
    fallback = np.where(kinds.sum(1) > 0, kinds.argmax(1), kinds.sum(0).argmax())
    opened, types = np.zeros(len(joint)), kinds.sum(0)
    opened[fallback] = 1.0
    types[-1] = float(n_texts > 0)
    model = ClassModel(joint, types, opened, fallback)
    whole_lookup = len(lookup.words) >= words
    shipped = docs.sparkSession.sparkContext.broadcast((lookup, model))
    unit = float(np.log10(tokens + PSEUDO * (distinct + 1)))
    end_log = float(np.log10(n_texts + PSEUDO))
    end = len(joint) - 1

    def parts(kind: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lookup, model = shipped.value
            for batch, start, stop, hashes, row, tails, lengths in _word_batches(batches):
                rows = stop - start
                hit, n, c = lookup.of(hashes)
                unseen = model.fallback[_bucket(tails, open_classes)]
                if whole_lookup:
                    c = np.where(hit, c, unseen)
                left, right, of = _stream(c, lengths, end)
                mark = K.mix(np.bincount(row, minlength=rows).astype(np.uint64))
                with np.errstate(over="ignore"):
                    np.add.at(mark, row, K.mix(hashes * np.uint64(3) + np.arange(len(hashes), dtype=np.uint64) - (np.cumsum(lengths) - lengths).astype(np.uint64)[row]))
                fields = [batch.column("doc_id").slice(start, rows), pa.array(mark.view(np.int64)), batch.column("held_out").slice(start, rows)]
                if kind == "texts":
                    met = (left >= 0) & (right >= 0)
                    bracket = np.bincount(of[met], model.table[left[met], right[met]], rows)
                    known = np.bincount(row[hit], minlength=rows) + (n_texts > 0)
                    if whole_lookup:
                        hit = np.ones(len(hashes), bool)
                    value = np.bincount(row[hit], np.log10(n[hit] + PSEUDO), rows)
                    yield _batch(_TEXTS, *fields, np.ones(rows, np.int64), lengths + 1, known, value + end_log, bracket)
                    continue
                # words beyond the shipped ones, once for each row and classes beside it; -1: as rare itself
                rare = np.flatnonzero(~hit)
                if kind == "rare":
                    at = rare + row[rare]
                    keys = (row[rare], hashes[rare], left[at], right[at + 1], unseen[rare])
                else:
                    follow = np.flatnonzero((left < 0) & (right < 0))
                    second = follow - of[follow]
                    keys = (of[follow], hashes[second - 1], hashes[second], unseen[second - 1], unseen[second])
                if len(keys[0]):
                    o = np.lexsort(keys[::-1])
                    keys = [k[o] for k in keys]
                    new = np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])
                    times = np.diff(np.r_[new, len(o)])
                    take = pa.array(keys[0][new])
                    rest = [k[new].view(np.int64) for k in keys[1:]]
                    yield _batch(_RARE if kind == "rare" else _PAIRS, *(f.take(take) for f in fields), times, *rest)

        return narrow.mapInArrow(run, {"texts": _TEXTS, "rare": _RARE, "pairs": _PAIRS}[kind])

    def priced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shipped.value[1].table
        for batch in batches:
            before, own, after, times, count = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("before", "own", "after", "times", "count"))
            bracket = times * (np.where(before >= 0, table[before, own], 0.0) + np.where(after >= 0, table[own, after], 0.0))
            alone = count >= 0  # not a pair
            zeros = np.zeros(len(times), np.int64)
            yield _batch(_TEXTS, *(batch.column(c) for c in ("doc_id", "mark", "held_out")), zeros, zeros, np.where(count > 0, times, 0), np.where(alone, times * np.log10(np.maximum(count, 0) + PSEUDO), 0.0), bracket)

    sums = parts("texts")
    if not whole_lookup:
        names = ("doc_id", "mark", "held_out", "before", "own", "after", "times", "count")
        rare = parts("rare").join(assigned.select("word", "n", "class"), "word", "left")
        rare = rare.withColumns({"own": F.coalesce("class", "unseen"), "count": F.coalesce("n", F.lit(0))}).select(*names)
        pairs = parts("pairs").join(assigned.select(F.col("class").alias("class1"), F.col("word").alias("word1")), "word1", "left")
        pairs = pairs.join(assigned.select(F.col("class").alias("class2"), F.col("word").alias("word2")), "word2", "left")
        pairs = pairs.withColumns({"before": F.coalesce("class1", "unseen1"), "own": F.coalesce("class2", "unseen2"), "after": F.lit(-1).cast("long"), "count": F.lit(-1).cast("long")}).select(*names)
        sums = sums.unionByName(rare.unionByName(pairs).mapInArrow(priced, _TEXTS))
    sums = sums.groupBy("doc_id", "mark", "held_out").agg(*(F.sum(c).alias(c) for c in ("copies", "n_tokens", "known", "value", "bracket")))
    whole = F.round(F.col("n_tokens") / F.col("copies")).cast("long")
    out = sums.select(
        "doc_id", "held_out", whole.alias("n_tokens"), F.round(F.col("known") / F.col("copies")).cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("value") / F.col("copies") - whole * unit).alias("base_score"), ((F.col("value") + F.col("bracket")) / F.col("copies")).alias("score"), F.expr("explode(sequence(1, cast(copies as int)))").alias("copy"),
    )
    return out.drop("copy").withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


_KEYS = "doc_id long, mark long, held_out boolean"
_TEXTS = f"{_KEYS}, copies long, n_tokens long, known long, value double, bracket double"
_RARE = f"{_KEYS}, times long, word long, before long, after long, unseen long"
_PAIRS = f"{_KEYS}, times long, word1 long, word2 long, unseen1 long, unseen2 long"


def _batch(schema: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], [c.split()[0] for c in schema.split(", ")])
