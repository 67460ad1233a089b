"""Byte-level BPE encoding and decoding over a minimal acyclic transducer of frequent words.

1. The whole corpus is cut into words by the tokenizer's pattern and counted.
2. The ``lexicon_size`` most frequent words are encoded once and compiled into a minimal acyclic
   automaton (equal suffixes share their states). Its transitions carry the number of words before
   them, so a path adds up to the word's index and thus to its ids.
3. Tasks memory-map the compiled automaton, look up words in lock step, one byte of all words at a
   time, and merge exactly, by rank, those that it doesn't hold.
4. Ids are decoded through the vocabulary's byte strings.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import tempfile
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import checkpointed, most_frequent
from gleaner.llm.kernels import blocks, flat

#: The words of byte-level BPE, and the white space that its pattern means.
SPACE = r"[\p{White_Space}]"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^\p{{White_Space}}\p{{L}}\p{{N}}]+|{SPACE}+(?!\P{{White_Space}})|{SPACE}+"
NO_RANK = np.int64(1) << 40
#: Bytes from which a word is merged on its own.
LONG = 2048


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 characters
    for themselves, the others from U+0100 on in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in own}
    letters |= {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))}
    return letters


class Vocabulary:
    """Byte strings, merges and special tokens of a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, letters = file["model"], byte_letters()
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        ids = model["vocab"]
        self.bytes = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in ids.items():
            self.bytes[i] = token.encode() if token in self.special else bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.flat_starts = np.cumsum([0, *map(len, self.bytes)])
        self.first = np.full(256, -1, np.int64)
        for c, b in letters.items():
            self.first[b] = ids[c]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([ids[a] << 20 | ids[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.pairs, self.ranks = keys[order], order.astype(np.int64)
        self.by_pair: dict[int, int] | None = None
        self.merged = np.array([ids[a + b] for a, b in merges], np.int64)  # by rank
        self.words = regex.compile(PATTERN)
        self.marks = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def split(self, text: str) -> list[str]:
        """Words and special tokens of a text, in order."""
        if self.marks is None or not any(s in text for s in self.special):
            return self.words.findall(text)
        return list(chain.from_iterable([x] if x in self.special else self.words.findall(x) for x in self.marks.split(text)))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], NO_RANK)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids (as little-endian unsigned 32-bit integers) of each word, by merging the pair of lowest
        rank, leftmost first, until none is left; all words advance by one rank at a time, but for those
        of over LONG bytes, whose ranks would each take a pass over the whole word."""
        if any(len(w) > LONG for w in words):
            short = iter(self.merge([w for w in words if len(w) <= LONG]))
            return [next(short) if len(w) <= LONG else self.merge_long(w) for w in words]
        if not words:
            return []
        sizes = np.array([len(w) for w in words], np.int64)
        done: list[bytes] = [b""] * len(words)
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        ranks = np.full(len(symbols), NO_RANK)
        if len(symbols) > 1:
            ranks[:-1] = np.where(word[1:] == word[:-1], self.rank(symbols[:-1], symbols[1:]), NO_RANK)
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(ranks, starts)
            lengths = np.diff(np.r_[starts, len(symbols)])
            ended = lowest == NO_RANK
            if ended.any():
                stays = np.repeat(~ended, lengths)
                out = symbols[~stays].astype("<u4").tobytes()
                at = 0
                for w, n in zip(word[starts[ended]].tolist(), (lengths[ended] * 4).tolist()):
                    done[w] = out[at : at + n]
                    at += n
                symbols, word, ranks = symbols[stays], word[stays], ranks[stays]
                lowest, lengths = lowest[~ended], lengths[~ended]
                if not len(symbols):
                    break
            hit = ranks == np.repeat(lowest, lengths)
            at = np.flatnonzero(hit)
            # of overlapping pairs of equal symbols, every other one
            new_run = np.r_[True, np.diff(at) != 1]
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run_start) % 2 == 0]
            symbols[at] = self.merged[ranks[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            changed = np.zeros(len(symbols), bool)
            changed[at] = True
            symbols, word, ranks, changed = symbols[keep], word[keep], ranks[keep], changed[keep]
            again = changed.copy()
            again[:-1] |= changed[1:]
            again = np.flatnonzero(again)
            inner = again[(again + 1 < len(symbols))]
            inner = inner[word[inner] == word[inner + 1]]
            ranks[again] = NO_RANK
            ranks[inner] = self.rank(symbols[inner], symbols[inner + 1])
        return done

    def merge_long(self, word: bytes) -> bytes:
        """The same for one word, a pair at a time: those of the start in sorted order, those that merging makes
        in a heap, and the symbols in a linked list. A word of n bytes takes some 60 n bytes of memory."""
        if self.by_pair is None:
            self.by_pair = dict(zip(self.pairs.tolist(), self.ranks.tolist()))
        begin, n, ranks = self.first[np.frombuffer(word, np.uint8)], len(word), self.by_pair
        at = self.rank(begin[:-1], begin[1:]) if n > 1 else np.zeros(0, np.int64)
        places = np.flatnonzero(at != NO_RANK)
        waiting = np.sort(at[places] << 40 | places)
        symbols, after, before = (array("i", x.astype(np.int32).tobytes()) for x in (begin, np.arange(1, n + 1), np.arange(-1, n - 1)))
        merged, mask, heap, read = self.merged, (1 << 40) - 1, [], 0
        part, k = waiting[: 1 << 16].tolist(), 0
        while True:
            if k == len(part):
                read += len(part)
                part, k = waiting[read : read + (1 << 16)].tolist(), 0
            if heap and (k == len(part) or heap[0] < part[k]):
                code = heappop(heap)
            elif k < len(part):
                code, k = part[k], k + 1
            else:
                break
            rank, i = code >> 40, code & mask
            j = after[i]
            if symbols[i] < 0 or j == n or ranks.get(symbols[i] << 20 | symbols[j]) != rank:
                continue  # one of the two has been merged since
            symbols[i], symbols[j], after[i] = int(merged[rank]), -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := ranks.get(symbols[a] << 20 | symbols[b])) is not None:
                    heappush(heap, r << 40 | a)
        left = np.frombuffer(symbols, np.int32)
        return left[left >= 0].astype("<u4").tobytes()

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of the ids between offsets."""
        data, at = gathered(self.flat, self.flat_starts, ids)
        cuts = at[offsets].tolist()
        return [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]


class Automaton:
    """A minimal acyclic transducer from byte strings to ids, kept in flat arrays."""

    PARTS = (("keys", np.int64), ("targets", np.int32), ("before", np.int32), ("final", np.int8), ("starts", np.int64), ("ids", np.uint32))

    def __init__(self, buffer):
        head = np.frombuffer(buffer, np.int64, len(self.PARTS))
        at = head.nbytes
        for n, (name, kind) in zip(head.tolist(), self.PARTS):
            setattr(self, name, np.frombuffer(buffer, kind, n, at))
            at += -(-n * np.dtype(kind).itemsize // 8) * 8

    @classmethod
    def compile(cls, entries: dict[bytes, bytes]) -> bytes:
        """The automaton's bytes. Words are added in order; a state is shared with an equal one as soon
        as no further word can change it."""
        words = sorted(w for w in entries if w)
        edges: list[list] = [[]]  # of each state: [byte, target], in order
        final = [False]
        register: dict[tuple, int] = {}
        path = [0]  # states along the last word
        last = b""

        def settle(depth: int) -> None:
            while len(path) > depth + 1:
                state = path.pop()
                key = (final[state], tuple(map(tuple, edges[state])))
                edges[path[-1]][-1][1] = register.setdefault(key, state)

        for w in words:
            common = len(os.path.commonprefix((last, w)))
            settle(common)
            for byte in w[common:]:
                edges.append([])
                final.append(False)
                edges[path[-1]].append([byte, len(edges) - 1])
                path.append(len(edges) - 1)
            final[path[-1]] = True
            last = w
        settle(0)
        number = {0: 0}
        reached = [0]
        for state in reached:
            for _, t in edges[state]:
                if t not in number:
                    number[t] = len(number)
                    reached.append(t)
        count: dict[int, int] = {}
        stack = [0]
        while stack:
            state = stack[-1]
            missing = [t for _, t in edges[state] if t not in count]
            if missing:
                stack.extend(missing)
            else:
                count[stack.pop()] = final[state] + sum(count[t] for _, t in edges[state])
        keys, targets, before = [], [], []
        for state in reached:
            passed = int(final[state])
            for byte, t in edges[state]:
                keys.append(number[state] << 8 | byte)
                targets.append(number[t])
                before.append(passed)
                passed += count[t]
        outputs = [entries[w] for w in words]
        parts = {
            "keys": keys, "targets": targets, "before": before, "final": [final[s] for s in reached],
            "starts": np.cumsum([0, *(len(o) // 4 for o in outputs)]), "ids": np.frombuffer(b"".join(outputs), "<u4"),
        }
        arrays = [np.asarray(parts[name], kind) for name, kind in cls.PARTS]
        head = np.array([len(a) for a in arrays], np.int64)
        return head.tobytes() + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)

    def find(self, words: list[bytes]) -> np.ndarray:
        """The index of each word, or -1."""
        n = len(words)
        index, state = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if not n or not len(self.keys):
            return np.full(n, -1)
        sizes = np.array([len(w) for w in words], np.int64)
        begin = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(words), np.uint8)
        active = np.flatnonzero(sizes > 0)
        state[sizes == 0] = -1
        step = 0
        while len(active):
            key = state[active] << 8 | data[begin[active] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            state[active] = np.where(ok, self.targets[at], -1)
            index[active] += self.before[at]
            step += 1
            active = active[ok & (sizes[active] > step)]
        good = state >= 0
        good[good] = self.final[state[good]] != 0
        return np.where(good, index, -1)


def memory_mapped(data: bytes) -> mmap.mmap:
    """The bytes in a nameless file of this machine, mapped read-only; each worker maps its own."""
    with tempfile.TemporaryFile() as f:
        f.write(data)
        f.flush()
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)


def gathered(values: np.ndarray, starts: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[starts[i]:starts[i + 1]] for each i of index, one after another, and their offsets."""
    sizes = np.diff(starts)[index]
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    return values[np.arange(offsets[-1]) + np.repeat(starts[:-1][index] - offsets[:-1], sizes)], offsets


def words_of(vocabulary: Vocabulary, texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts, in order, and how many each text has."""
    words, counts = [], []
    for text in texts:
        found = vocabulary.split(text)
        words += found
        counts.append(len(found))
    return pa.array(words, pa.large_string()).dictionary_encode(), np.array(counts, np.int64)


class Encoder:
    """Encodes a block of texts at a time: each distinct word of the block is looked up in the automaton,
    or merged if that doesn't hold it, and the ids of all words are gathered from theirs."""

    def __init__(self, vocabulary: Vocabulary, lexicon: bytes):
        self.vocabulary = vocabulary
        self.automaton = Automaton(memory_mapped(lexicon))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the offsets of the texts."""
        coded, counts = words_of(self.vocabulary, texts)
        words = coded.dictionary.to_pylist()
        raw, special = [w.encode() for w in words], self.vocabulary.special
        index = self.automaton.find(raw)
        unseen = np.flatnonzero(index < 0)
        ids = self.vocabulary.merge([raw[i] for i in unseen.tolist()])
        ids = [np.asarray([special[words[i]]], "<u4").tobytes() if words[i] in special else x for i, x in zip(unseen.tolist(), ids)]
        starts, n = self.automaton.starts, len(self.automaton.starts) - 1
        starts = np.concatenate((starts, starts[-1] + np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)))
        index[unseen] = n + np.arange(len(unseen))
        values = np.concatenate((self.automaton.ids, np.frombuffer(b"".join(ids), "<u4")))
        out, offsets = gathered(values, starts, index[coded.indices.to_numpy(zero_copy_only=False)])
        return out, offsets[np.concatenate(([0], np.cumsum(counts)))]


_vocabularies: dict[str, Vocabulary] = {}
_encoders: dict[tuple, Encoder] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def text_blocks(batches: Iterator[pa.RecordBatch], column: int, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in blocks of about ``limit`` bytes of text at most; a longer text is a block of its own."""
    for batch in batches:
        for row, end in blocks(flat(batch.column(column))[1], limit):
            yield batch.slice(row, end - row)


def word_counts(docs: DataFrame, tokenizer_path: str, longest: int = 64) -> DataFrame:
    """word (bytes) and how often it occurs in the column ``text``, over all rows, for words of at most
    ``longest`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = vocabulary(tokenizer_path), []

        def flush() -> list[pa.RecordBatch]:
            total = pa.concat_tables(counts).group_by("word").aggregate([("n", "sum")])
            counts.clear()
            return total.rename_columns(["word", "n"]).combine_chunks().to_batches()

        for block in text_blocks(batches, 0):
            found = words_of(known, [t or "" for t in block.column(0).to_pylist()])[0].value_counts()
            table = pa.table([found.field(0).dictionary_decode().cast(pa.large_binary()), found.field(1)], ["word", "n"])
            table = table.filter(pa.compute.less_equal(pa.compute.binary_length(table.column("word")), longest))
            counts.append(pa.table([table.column("word").cast(pa.binary()), table.column("n")], ["word", "n"]))
            if sum(c.num_rows for c in counts) > 1_000_000:
                yield from flush()
        if counts:
            yield from flush()

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tokenizer_path: str, lexicon_size: int = 50_000, longest: int = 64) -> bytes:
    """The compiled automaton of the most frequent words of up to ``longest`` bytes (up to lexicon_size of
    them); longer ones are always merged. Counts cover all rows; only those words themselves come to the
    driver, lexicon_size * longest bytes at most."""
    top = most_frequent(checkpointed(word_counts(docs, tokenizer_path, longest)), lexicon_size).select("word").collect()
    words, known = [bytes(r["word"]) for r in top], vocabulary(tokenizer_path)
    words = [w for w in words if w.decode("utf-8", "replace") not in known.special]
    return Automaton.compile(dict(zip(words, known.merge(words))))


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_decode(docs: DataFrame, tokenizer_path: str, lexicon_size: int = 50_000, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each document: digests of its ids and of the text decoded from them; with_ids adds
    ``ids`` (array<int>) and ``decoded``.

    Null counts as empty: no ids, and the digests of no bytes. Special tokens' strings in a text are
    those tokens. Repeated rows and null ids are kept; an empty table gives no rows; further columns
    are ignored.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    lexicon = docs.sparkSession.sparkContext.broadcast(build_lexicon(narrow, tokenizer_path, lexicon_size))
    token = hashlib.sha256(lexicon.value).hexdigest()
    schema = RESULT + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(tokenizer_path)
        if (tokenizer_path, token) not in _encoders:
            _encoders.clear()
            _encoders[tokenizer_path, token] = Encoder(known, lexicon.value)
        encoder = _encoders[tokenizer_path, token]
        for block in text_blocks(batches, 1):
            ids, offsets = encoder.encode([t or "" for t in block.column(1).to_pylist()])
            cuts = offsets.tolist()
            decoded = known.decode(ids, offsets)
            columns = [
                block.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array([hashlib.sha256(ids[a:b]).hexdigest() for a, b in zip(cuts, cuts[1:])]),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded]),
            ]
            if with_ids:
                columns += [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32))), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return narrow.mapInArrow(run, schema)
