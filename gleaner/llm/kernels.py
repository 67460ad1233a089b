"""Vectorised numpy kernels shared by the training-data operators.

They work on one Arrow batch at a time: a column of texts is seen as one flat byte array plus
offsets, so that a batch costs a few passes over memory, whatever the lengths of its texts. Nothing
here knows about Spark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes with A-Z lower-cased.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two rounds of multiply and xor-shift); a bijection."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: A random 64-bit value for each byte.
BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))


def flat(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of texts, one after another, and the offsets; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.chunk(0) if texts.num_chunks else pa.array([], pa.large_string())
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int):
    """Runs of rows of at most about ``limit`` bytes each; one longer row is a run of its own."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end
        row = end


_powers = np.ones(1, U64)
_inverses = np.ones(1, U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64 (kept between calls)."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 1 << 20)
        inverse = pow(int(_BASE), -1, 1 << 64)
        _powers = np.full(size, _BASE, U64)
        _inverses = np.full(size, U64(inverse), U64)
        _powers[0] = _inverses[0] = 1
        np.multiply.accumulate(_powers, out=_powers)
        np.multiply.accumulate(_inverses, out=_inverses)
    return _powers[:n], _inverses[:n]


def prefix_sums(data: np.ndarray, values: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """S with hash(data[i:j]) = (S[j] - S[i]) * base**-i, modulo 2**64. Other values of bytes give hashes
    that are independent of these. In place of bytes, data may hold 64-bit numbers, which are their own values."""
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((values[data] if data.dtype == np.uint8 else data) * powers(len(data))[0], out=sums[1:])
    return sums


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and row of every word (a run of bytes other than white space, A-Z as a-z), in order; and
    the number of words of each row. Words don't cross rows."""
    return words_with_tails(data, offsets)[:3]


def words_with_tails(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same, and the last two bytes of every word (one byte if it has no more)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none.view(U64), none, np.zeros(len(offsets) - 1, np.int64), none
    data = _LOWER[data]
    inside = ~_SPACE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    start[edges] |= inside[edges]
    stop[edges - 1] |= inside[edges - 1]
    first, last = np.flatnonzero(start), np.flatnonzero(stop) + 1
    sums = prefix_sums(data)
    hashes = mix((sums[last] - sums[first]) * powers(len(data) + 1)[1][first])
    counts = np.searchsorted(first, offsets[1:]) - np.searchsorted(first, offsets[:-1])
    tails = data[last - 1].astype(np.int64) | np.where(last - first > 1, data[np.maximum(last - 2, 0)].astype(np.int64) << 8, 0)
    return hashes, np.repeat(np.arange(len(counts)), counts), counts, tails


def word_spans(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word (a run of bytes that aren't ``outside``), in order, and the number of
    words of each row. Words don't cross rows."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets) - 1, np.int64)
    inside = ~outside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[0], edge[-1] = inside[0], inside[-1]
    ends = np.flatnonzero(edge)
    first, last = ends[::2], ends[1::2]
    cuts = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    cuts = np.unique(cuts[inside[cuts] & inside[cuts - 1]])
    if len(cuts):
        first, last = np.sort(np.r_[first, cuts]), np.sort(np.r_[last, cuts])
    counts = np.searchsorted(first, offsets[1:]) - np.searchsorted(first, offsets[:-1])
    return first, last, counts


def span_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    sums = prefix_sums(data)
    return mix((sums[last] - sums[first]) * powers(len(data) + 1)[1][first])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``size``-word shingles of each row as 64-bit hashes, ascending within a row, and
    the offsets of the rows. A row with fewer words has its whole sequence as one shingle; a row
    without words has none."""
    hashes, row, counts = words(data, offsets)
    rows = len(counts)
    if not len(hashes):
        return np.zeros(0, U64), np.zeros(rows + 1, np.int64)
    begin = np.cumsum(counts) - counts
    number = np.arange(len(hashes)) - begin[row]
    take = np.minimum(counts, size)[row]
    keep = number <= (counts[row] - take)
    at = np.flatnonzero(keep)
    value = np.zeros(len(at), U64)
    for i in range(size):
        more = i < take[at]
        source = np.minimum(at + i, len(hashes) - 1)
        value = np.where(more, mix(value * U64(0x2545F4914F6CDD1D) + hashes[source] + U64(i + 1)), value)
    of = row[at]
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    value, of = value[new], of[new]
    return value, np.concatenate(([0], np.cumsum(np.bincount(of, minlength=rows)))).astype(np.int64)


def anchors(data: np.ndarray, offsets: np.ndarray, span: int, inner: int, least_places: int = 0) -> tuple[np.ndarray, ...]:
    """The anchors of all strings of ``span`` bytes within rows: of each such string, its ``inner``-byte
    substring of the smallest hash, the leftmost of equals. Neighbouring starts of one anchor make a
    run: first start, number of starts, anchor (places in data), hash of the anchor, and fingerprint
    of all bytes that the run's strings cover. Equal strings have equal anchors at the same place.
    ``least_places`` low bits of the hashes aren't compared, however short the data."""
    width, n = span - inner + 1, len(data)
    none = np.zeros(0, np.int64)
    if n < span:
        return none, none, none, none.view(U64), none.view(U64)
    sums, inverse = prefix_sums(data), powers(n + 1)[1]
    hashes = mix((sums[inner:] - sums[:-inner]) * inverse[: n + 1 - inner])
    places = U64(max(int(n).bit_length(), least_places))
    low = (hashes >> places << places) | np.arange(len(hashes), dtype=U64)
    reach = 1
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < width:
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
    at = (low & ((U64(1) << places) - U64(1))).astype(np.int64)
    inside = np.zeros(len(at) + 1, np.int32)  # strings that would cross the end of a row are none
    np.add.at(inside, np.clip(offsets[1:-1] - span + 1, 0, len(at)), 1)
    np.add.at(inside, np.clip(offsets[1:-1], 0, len(at)), -1)
    starts = np.flatnonzero(np.cumsum(inside[:-1]) == 0)
    if not len(starts):
        return none, none, none, none.view(U64), none.view(U64)
    at = at[starts]
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first, anchor, count = starts[new], at[new], np.diff(np.r_[new, len(at)])
    covered = (sums[first + count + span - 1] - sums[first]) * inverse[first]
    print_ = mix(covered ^ mix((anchor - first).astype(U64) * U64(4096) + count.astype(U64)))
    return first, count, anchor, hashes[anchor], print_
