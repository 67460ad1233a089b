"""Ranked lexical search with posting lists that are blocked by geometry.

Documents become vectors over the terms that the asked items hold, a shard of some thousand at a time.
Within a shard, each term's posting list is clustered by the similarity of its documents' vectors, and
each block of a list is stored with the coordinatewise maximum of its documents. An item's weights times
that summary can't be less than the score of any document in the block, so a block is skipped exactly
if that bound fails the item's worst score so far; what remains is scored in whole numbers.

Items are searched in blocks of a bounded number of terms, each against all documents. A block's terms
and weights are what is broadcast. Some shards are searched first, on their own: the fiftieth best score
there, however few they are, is one that every later shard's blocks have to reach, so that only a few
rows for each item are ever shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm import kernels as K
from gleaner.llm.common import checkpointed, in_parts

BLOCK = 2 << 20
#: Items and terms of a block of items; an item of more terms is a block of its own.
ITEMS, TERMS = 256, 16_384
#: Documents of a shard, and cells (documents by terms) that it may have.
DOCS, CELLS = 2048, 8 << 20
#: Documents of a block of a posting list: aimed at, and at most; lists of up to SHORT have no summary.
AIM, MOST, SHORT = 24, 64, 8
#: Columns of a summary: beyond, neighbouring ones share one.
WIDTH = 4096
SKETCH = 32
#: One shard in so many is searched first.
FIRST = 16
NO_TERM = np.ones(256, bool)
NO_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
VECTORS = "docs long, terms long, payload binary"
HITS = "item int, doc_id long, score long"
VECTOR_ARRAYS = ("<i8", "u1", "<i8", "<i4", "<i4", "<i4")  # ids, whether null, terms, offsets, columns, occurrences
INDEX_ARRAYS = ("<i8", "u1", "<i4", "<i4", "<i4", "<i4", "<i4", "<i4", "<i4", "<i4")


def pack(arrays: list[np.ndarray], kinds: tuple[str, ...]) -> bytes:
    raw = [np.ascontiguousarray(a, k).tobytes() for a, k in zip(arrays, kinds, strict=True)]
    body = np.array([len(r) for r in raw], "<i8").tobytes() + b"".join(raw)
    return np.int64(len(body)).tobytes() + pa.compress(body, "zstd", asbytes=True)


def unpack(payload: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    body = pa.decompress(payload[8:], int(np.frombuffer(payload, "<i8", 1)[0]), "zstd", asbytes=True)
    ends = 8 * len(kinds) + np.cumsum(np.concatenate(([0], np.frombuffer(body, "<i8", len(kinds)))))
    return [np.frombuffer(body[a:b], k) for a, b, k in zip(ends[:-1].tolist(), ends[1:].tolist(), kinds)]


def term_hashes(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows from, rows to, hashes of their terms (A-Z as a-z), and the number of terms of each row."""
    data, offsets = K.flat(texts)
    for a, b in K.blocks(offsets, BLOCK):
        part = K._LOWER[data[offsets[a] : offsets[b]]]
        first, last, counts = K.word_spans(part, offsets[a : b + 1] - offsets[a], NO_TERM)
        yield a, b, K.span_hashes(part, first, last), counts


def pack_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of items with their distinct terms; items without a term find nothing and are left out."""
    kept: list[tuple[int | None, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        sizes = np.cumsum([0, *(len(t) for _, t in kept)])
        ids = [i for i, _ in kept]
        null = np.array([i is None for i in ids])
        row = (pack([np.array([i or 0 for i in ids]), null, sizes, np.concatenate([t for _, t in kept])], ("<i8", "u1", "<i8", "<u8")),)
        return pa.record_batch([pa.array(row, pa.binary())], ["payload"])

    for batch in in_parts(batches):
        ids = batch.column("item_id").to_pylist()
        for a, b, hashes, counts in term_hashes(batch.column("text")):
            ends = np.cumsum(counts)
            for i in range(a, b):
                terms = np.unique(hashes[ends[i - a] - counts[i - a] : ends[i - a]])
                if not len(terms):
                    continue
                if kept and (len(kept) == ITEMS or sum(len(t) for _, t in kept) + len(terms) > TERMS):
                    yield flush()
                    kept = []
                kept.append((ids[i], terms))
    if kept:
        yield flush()


class Asked:
    """A block of items: their ids, the sorted hashes of all terms, each item's terms as places in these, and,
    once the documents are counted, what terms weigh."""

    def __init__(self, payload: bytes):
        ids, null, sizes, terms = unpack(payload, ("<i8", "u1", "<i8", "<u8"))
        self.ids = [None if gone else int(i) for i, gone in zip(ids, null)]
        self.vocabulary = np.unique(terms)
        places = np.searchsorted(self.vocabulary, terms)
        self.items = [places[a:b] for a, b in zip(sizes[:-1], sizes[1:])]
        self.docs = self.terms = 0
        self.weights = np.zeros(len(self.vocabulary), np.int64)

    def weigh(self, docs: int, terms: int, held: dict[int, int]) -> None:
        self.docs, self.terms = docs, terms
        for t, df in held.items():
            self.weights[t] = math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))

    def prepare(self) -> "Asked":
        """What tasks look up: the items of each term, and a column of weights for each item."""
        item = np.repeat(np.arange(len(self.items)), [len(i) for i in self.items])
        term = np.concatenate(self.items)
        order = np.argsort(term, kind="stable")
        self.of_term = np.split(item[order], np.cumsum(np.bincount(term, minlength=len(self.vocabulary)))[:-1])
        self.table = np.zeros((len(self.vocabulary), len(self.items)))
        self.table[term, item] = self.weights[term]
        self.cached: dict[bytes, np.ndarray] = {}
        self.room = 8 << 20
        return self

    def columns(self, term: int) -> np.ndarray:
        """The terms of all items that have this one: no other coordinate matters to its list."""
        items = self.of_term[term]
        if len(items) == 1:
            return self.items[items[0]]
        if (found := self.cached.get(key := items.tobytes())) is None:
            found = np.unique(np.concatenate([self.items[i] for i in items]))
            if self.room > len(found):
                self.room -= len(found)
                self.cached[key] = found
        return found

    def shard_docs(self) -> int:
        return int(np.clip(CELLS // len(self.vocabulary), 16, DOCS))


def folds(columns: np.ndarray) -> np.ndarray | None:
    """Where groups of neighbouring columns begin, if there are more columns than a summary has."""
    return None if len(columns) <= WIDTH else np.arange(0, len(columns), -(-len(columns) // WIDTH))


def vectorise(shared):
    """Shards of documents: occurrences of the asked terms, and how many documents have any term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        size, vocabulary = asked.shard_docs(), asked.vocabulary
        total, terms, held, parts = 0, 0, 0, []

        def row() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0)] * 6
            columns[3] = np.concatenate(([0], np.cumsum(columns[3])))
            return pa.record_batch([pa.array([total]), pa.array([terms]), pa.array([pack(columns, VECTOR_ARRAYS)], pa.binary())], ["docs", "terms", "payload"])

        for batch in in_parts(batches):
            ids = batch.column("doc_id")
            null, id_ = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            for a, b, hashes, counts in term_hashes(batch.column("text")):
                place = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                hit = vocabulary[place] == hashes
                pair, times = np.unique(np.repeat(np.arange(b - a), counts)[hit] * len(vocabulary) + place[hit], return_counts=True)
                of, column = np.divmod(pair, len(vocabulary))
                number = np.bincount(of, minlength=b - a)
                at = np.concatenate(([0], np.cumsum(number)))
                with_hits = np.flatnonzero(number)
                total, terms = total + int((counts > 0).sum()), terms + int(counts.sum())
                while len(with_hits):
                    some, with_hits = with_hits[: size - held], with_hits[size - held :]
                    x, y = at[some[0]], at[some[-1] + 1]  # rows between have no hits
                    parts.append((id_[a:b][some], null[a:b][some], counts[some], number[some], column[x:y], times[x:y]))
                    held += len(some)
                    if held == size:
                        yield row()
                        total, terms, held, parts = 0, 0, 0, []
        if total:
            yield row()

    return run


def held_by(shared):
    """For each asked term, how many documents of this task have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(shared.value.vocabulary), np.int64)
        for batch in batches:
            for payload in batch.column("payload"):
                count += np.bincount(unpack(payload.as_py(), VECTOR_ARRAYS)[4], minlength=len(count))
        at = np.flatnonzero(count)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(count[at])], ["term", "df"])

    return run


def dense(offsets: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(offsets) - 1, width), np.int32)
    out[np.repeat(np.arange(len(out)), np.diff(offsets)), columns] = values
    return out


def build_shard(asked: Asked, payload: bytes) -> bytes:
    """Documents with their terms' impacts, and for each term the blocks of its list: lists' terms, lists' ends
    in blocks, blocks' ends in places, places of documents, lists' ends in summaries, summaries."""
    ids, null, n, offsets, columns, times = unpack(payload, VECTOR_ARRAYS)
    m = 50 + (50 * n * asked.docs) // max(asked.terms, 1)
    tf = times.astype(np.int64)
    impact = 1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(m, np.diff(offsets)))
    table = dense(offsets, columns, impact, len(asked.vocabulary))
    # a random projection keeps the angles between the vectors of weighted impacts, roughly
    signs = np.random.default_rng(12).choice(np.array([-1, 1], np.float32), (len(asked.vocabulary), SKETCH))
    sketch = (table.astype(np.float32) / 1e6) @ (signs * asked.weights[:, None].astype(np.float32))
    sketch /= np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)
    order = np.argsort(columns, kind="stable")
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(offsets))[order]
    terms, begin = np.unique(columns[order], return_index=True)
    list_ends, block_ends, places, summary_ends, summaries = [0], [0], [], [0], []
    for t, a, b in zip(terms.tolist(), begin.tolist(), [*begin[1:].tolist(), len(doc)]):
        docs, starts = doc[a:b], np.zeros(1, np.int64)
        if b - a > SHORT:
            centres = docs[np.arange(-(-(b - a) // AIM)) * AIM]
            cluster = (sketch[docs] @ sketch[centres].T).argmax(axis=1)
            by = np.argsort(cluster, kind="stable")
            docs, cluster = docs[by], cluster[by]
            new = np.flatnonzero(np.r_[True, cluster[1:] != cluster[:-1]])
            within = np.arange(len(docs)) - np.repeat(new, np.diff(np.r_[new, len(docs)]))
            starts = np.flatnonzero(within % MOST == 0)
            wanted = asked.columns(t)
            summary = np.maximum.reduceat(table[np.ix_(docs, wanted)], starts, axis=0)
            if (groups := folds(wanted)) is not None:
                summary = np.maximum.reduceat(summary, groups, axis=1)
            summaries.append(summary.ravel())
        places.append(docs)
        block_ends.extend((block_ends[-1] + np.r_[starts[1:], len(docs)]).tolist())
        list_ends.append(list_ends[-1] + len(starts))
        summary_ends.append(summary_ends[-1] + (summaries[-1].size if b - a > SHORT else 0))
    empty = [np.zeros(0, np.int32)]
    return pack([ids, null, offsets, columns, impact, terms, list_ends, block_ends, np.concatenate(places or empty), np.concatenate([np.array(summary_ends, np.int32), *summaries])], INDEX_ARRAYS)


class Best:
    """The best scores of one item so far, equal ones by ascending id, null first."""

    def __init__(self, k: int, least: int):
        self.k, self.least = k, max(least, 1)
        self.score, self.null, self.doc = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, score: np.ndarray, null: np.ndarray, doc: np.ndarray) -> None:
        take = score >= self.least
        if not take.any():
            return
        score, null, doc = (np.r_[old, new[take]] for old, new in ((self.score, score), (self.null, null), (self.doc, doc)))
        order = np.lexsort((doc, null == 0, -score))[: self.k]
        self.score, self.null, self.doc = score[order], null[order], doc[order]
        if len(order) == self.k:
            self.least = max(self.least, int(self.score[-1]))


def search_shard(asked: Asked, payload: bytes, best: list[Best]) -> tuple[int, int]:
    """Puts the shard's documents into ``best``; how many (item, block) pairs there were, and how many were
    skipped by their bounds."""
    ids, null, offsets, columns, impact, terms, list_ends, block_ends, places, rest = unpack(payload, INDEX_ARRAYS)
    summary_ends, summaries = rest[: len(terms) + 1], rest[len(terms) + 1 :]
    table = dense(offsets, columns, impact, len(asked.vocabulary))
    least = np.array([b.least for b in best], float)
    of, block, bound, all_pairs = [], [], [], 0
    for j, t in enumerate(terms.tolist()):
        items, first, last = asked.of_term[t], list_ends[j], list_ends[j + 1]
        all_pairs += len(items) * int(last - first)
        if summary_ends[j + 1] == summary_ends[j]:
            of.append(items)
            block.append(np.full(len(items), first))
            bound.append(np.full(len(items), np.inf))
            continue
        wanted = asked.columns(t)
        weights = asked.table[np.ix_(wanted, items)]
        if (groups := folds(wanted)) is not None:
            weights = np.add.reduceat(weights, groups, axis=0)
        # sums below 2**53 are exact in doubles; beyond, the bound is raised by more than they round
        bounds = summaries[summary_ends[j] : summary_ends[j + 1]].reshape(last - first, -1).astype(float) @ weights
        bounds[bounds > 2.0**53] *= 1 + 1e-9
        a, b = np.nonzero(bounds >= least[items])
        of.append(items[b])
        block.append(first + a)
        bound.append(bounds[a, b])
    if not of:
        return 0, 0
    of, block, bound = np.concatenate(of), np.concatenate(block), np.concatenate(bound)
    order = np.lexsort((-bound, of))
    of, block, bound = of[order], block[order], bound[order]
    scored = 0
    for a, b in zip(cuts := np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), np.r_[cuts[1:], len(of)]):
        item, mine, step = asked.items[of[a]], best[of[a]], 16
        weights, seen = asked.weights[item], np.zeros(len(ids), bool)
        while a < b and bound[a] >= mine.least:
            some = block[a : min(b, a + step)][bound[a : min(b, a + step)] >= mine.least]
            begin, n = block_ends[some], block_ends[some + 1] - block_ends[some]
            docs = places[np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            docs = np.unique(docs[~seen[docs]])
            seen[docs] = True
            mine.add(table[np.ix_(docs, item)].astype(np.int64) @ weights, null[docs].astype(np.int64), ids[docs])
            scored, a, step = scored + len(some), a + step, 2 * step
    return all_pairs, all_pairs - scored


def build(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value.prepare()
        for batch in batches:
            for shard, payload in zip(batch.column("shard"), batch.column("payload")):
                yield pa.record_batch([pa.array([shard.as_py()], pa.int64()), pa.array([build_shard(asked, payload.as_py())], pa.binary())], ["shard", "payload"])

    return run


def search(shared, k: int, least: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value.prepare()
        best = [Best(k, x) for x in least]
        for batch in batches:
            for payload in batch.column("payload"):
                search_shard(asked, payload.as_py(), best)
        item = np.repeat(np.arange(len(best), dtype=np.int32), [len(b.score) for b in best])
        doc = pa.array(np.concatenate([b.doc for b in best]), mask=np.concatenate([b.null for b in best]).astype(bool))
        yield pa.record_batch([pa.array(item), doc, pa.array(np.concatenate([b.score for b in best]))], ["item", "doc_id", "score"])

    return run


def _top(hits: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
    return hits.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def _search_block(docs: DataFrame, asked: Asked, k: int) -> DataFrame:
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(asked)
    vectors = checkpointed(docs.mapInArrow(vectorise(shared), VECTORS).withColumn("shard", F.monotonically_increasing_id()))
    total = vectors.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    held = vectors.mapInArrow(held_by(shared), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    asked.weigh(total[0], total[1], {r["term"]: r["df"] for r in held})
    shared = context.broadcast(asked)
    index = checkpointed(vectors.select("shard", "payload").mapInArrow(build(shared), "shard long, payload binary"))
    early = F.pmod(F.xxhash64("shard"), F.lit(FIRST)) == 0
    first = checkpointed(_top(index.filter(early).mapInArrow(search(shared, k, [0] * len(asked.items)), HITS), k))
    least = [0] * len(asked.items)
    for r in first.filter(F.col("rank") == k).collect():
        least[r["item"]] = r["score"]
    later = index.filter(~early).mapInArrow(search(shared, k, least), HITS)
    ids = docs.sparkSession.createDataFrame(list(enumerate(asked.ids)), "item int, item_id long")
    return _top(first.drop("rank").unionByName(later), k).join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 50) -> DataFrame:
    """For each item its k best documents: item_id, rank (from 1), doc_id, score.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z as a-z, and are told apart by 64-bit hashes. A score is the
    sum, over the item's distinct terms, of weight times impact, as whole numbers; a document whose score is
    0 isn't returned, and of equal scores the smaller id comes first, a null id before all. Null and empty
    texts have no terms: as items they find nothing, as documents they aren't counted. Rows that repeat an
    id are items, or documents, of their own. Empty tables give no rows; other columns aren't read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, size[0] // ITEMS, size[1] // (8 * TERMS))
    blocks = checkpointed(asked.repartition(parts).mapInArrow(pack_items, "payload binary").withColumn("block", F.monotonically_increasing_id()))
    found = []
    for number in sorted(r["block"] for r in blocks.select("block").collect()):
        found.append(_search_block(texts, Asked(blocks.filter(F.col("block") == number).first()["payload"]), k))
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)
