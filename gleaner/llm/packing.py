"""Best-fit packing of documents into sequences of a fixed number of tokens.

Every piece of a document is first reduced to its length. The number of pieces of each length (at
most ``capacity`` numbers, whatever the size of the corpus) is all that the packing plan needs:

* Large pieces, above a third of the capacity, are matched greedily: the longest one is put with the
  longest other large piece that still fits, so that a sequence holds at most two of them.
* The smaller pieces, longest first, go where they leave the smallest gap (best fit).

A step of the plan moves as many equal sequences at once as the counts allow, so its size depends on
the capacity and not on the corpus. Spark then numbers the pieces within each length and looks up
where the plan has put that number. Lengths are numbered in salted groups whose sizes are summed up,
so a length that a third of all pieces have is no hot key.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator
from struct import pack
from string import punctuation

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import checkpointed, small_batches, worker_cache

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers, by a tokenizer that lower-cases, drops white
    space and merges neither across it nor between letters or digits and signs. So each stretch between
    blanks is encoded on its own, apart from the ASCII signs at its end, and remembered: up to ``kept``
    stretches as they stand and ``kept_cores`` without the signs."""

    def __init__(self, path: str, kept: int = 600_000, kept_cores: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kept, self.kept_cores = Tokenizer.from_file(path), kept, kept_cores
        self.known: dict[str, bytes] = worker_cache()
        self.cores: dict[str, bytes] = worker_cache()

    def _encode(self, parts: list[str]) -> list[bytes]:
        return [pack(f"<{len(e.ids)}I", *e.ids) for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        known, cores = self.known, self.cores
        if len(cores) > self.kept_cores:
            cores.clear()
        split, wanted = [], set()
        for x in new:
            core, signs = x, ""
            if "<|" not in x:  # special tokens stay whole
                bare = x.rstrip(punctuation)
                if bare != x and bare[-1:].isalnum() and bare[-1] < "\u0100":
                    core, signs = bare, x[len(bare) :]
                    wanted.add(signs)
                if core.isascii():  # elsewhere lower-casing is the tokenizer's own
                    core = core.lower()
            wanted.add(core)
            split.append((x, core, signs))
        missing = list(wanted.difference(cores))
        cores.update(zip(missing, self._encode(missing)))
        for x, core, signs in split:
            known[x] = cores[core] + cores[signs] if signs else cores[core]

    def encode(self, texts: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > self.kept:
            known.clear()
        stretches = [x.replace("\n", " ").split(" ") for x in texts]
        new = set().union(*stretches).difference(known)
        if new:
            self._learn(list(new))
        look = known.__getitem__
        return [b"".join(map(look, parts)) for parts in stretches]


_encoders: dict[tuple, WordEncoder] = {}


def encoder(path: str, kept: int) -> WordEncoder:
    if (path, kept) not in _encoders:
        _encoders[path, kept] = WordEncoder(path, kept, kept * 4 // 3)
    return _encoders[path, kept]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", remembered: int = 600_000) -> DataFrame:
    """The pieces of every document: its ids and the end id, cut only where longer than capacity. A worker
    remembers the ids of that many stretches of text, which saves time and changes no result."""
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, remembered).encode
        parts = (batch.slice(at, 128) for batch in batches for at in range(0, batch.num_rows, 128))
        for batch in parts:
            out = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode([t or "" for t in batch.column(1).to_pylist()])):
                ids += end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc, i, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


def plan(counts: dict[int, int], capacity: int) -> pd.DataFrame:
    """Where the pieces of each length go, given how many there are: rows (length, first, sequence,
    each, offset): the pieces numbered first, first+1, ... of that length lie ``each`` to a sequence,
    from that sequence and offset on, up to the first number of the next row of that length."""
    left = {k: v for k, v in counts.items() if v}
    used = dict.fromkeys(left, 0)
    rows, groups, sequence = [], [], 0  # groups: [gap, first sequence, number of sequences]

    def put(length: int, group: list, n_sequences: int, each: int) -> None:
        rows.append((length, used[length], group[1], each, capacity - group[0]))
        used[length] += n_sequences * each
        left[length] -= n_sequences * each

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        top = large[-1]
        at = bisect.bisect_right(large, capacity - top) - 1
        partner = large[at] if at >= 0 else None
        if partner == top and left[top] == 1:
            partner = large[at - 1] if at > 0 else None
        if partner is None:
            n = left[top]
        else:
            n = left[top] // 2 if partner == top else min(left[top], left[partner])
        group = [capacity, sequence, n]
        sequence += n
        put(top, group, n, 1)
        group[0] -= top
        if partner is not None:
            put(partner, group, n, 1)
            group[0] -= partner
        groups.append(group)
        for k in {top, partner} - {None}:
            if not left[k]:
                large.remove(k)
    gaps: dict[int, list] = {}
    for g in groups:
        if g[0]:
            gaps.setdefault(g[0], []).append(g)
    order = sorted(gaps)
    for length in sorted((k for k in left if left[k]), reverse=True):
        while left[length]:
            at = bisect.bisect_left(order, length)
            if at < len(order):
                gap = order[at]
                group = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(at)
            else:
                each = capacity // length
                n = max(1, left[length] // each)
                group = [capacity, sequence, n]
                sequence += n
            each = min(group[0] // length, left[length])
            n = min(group[2], left[length] // each)
            rest = [group[0], group[1] + n, group[2] - n]
            group[2] = n
            put(length, group, n, each)
            group[0] -= each * length
            for g in (group, rest):
                if g[2] and g[0]:
                    if g[0] not in gaps:
                        bisect.insort(order, g[0])
                        gaps[g[0]] = []
                    gaps[g[0]].append(g)
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "each", "offset"]).sort_values(["length", "first"], ignore_index=True)


def numbered(items: DataFrame, salts: int = 256) -> DataFrame:
    """items with ``number``: 0, 1, ... among the pieces of the same length."""
    order = ["doc_id", "piece", "ids_crc32"]
    salted = items.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("length", "__salt").orderBy(*order)
    ranked = salted.withColumn("__rank", F.row_number().over(within) - 1)
    return ranked.join(sizes, ["length", "__salt"]).withColumn("number", F.col("__before") + F.col("__rank")).drop("__salt", "__before", "__rank")


def best_fit_pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", remembered: int = 600_000) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of the end id. Texts of any length are cut into pieces of
    ``capacity``; a null id stays null; repeated rows are packed like any others; an empty table gives
    no rows; further columns are ignored. Sequences are gapless from offset 0. remembered: see pieces.
    """
    small_batches(docs.sparkSession)
    items = checkpointed(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, remembered))
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    steps = plan(counts, capacity)
    span = 1 << 40  # above any number of pieces
    keys = steps["length"].to_numpy("int64") * span + steps["first"].to_numpy("int64")
    shipped = docs.sparkSession.sparkContext.broadcast((keys, *(steps[c].to_numpy("int64") for c in ("first", "sequence", "each", "offset"))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, sequence, each, offset = shipped.value
        for batch in batches:
            length, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            row = np.searchsorted(keys, length * span + number, side="right") - 1
            nth = number - first[row]
            more = {"sequence_id": sequence[row] + nth // each[row], "offset": offset[row] + nth % each[row] * length}
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(v, pa.int64()) for v in more.values())], ["doc_id", "piece", "start", "length", "ids_crc32", *more])

    return numbered(items).mapInArrow(place, PIECES + ", sequence_id long, offset long")
