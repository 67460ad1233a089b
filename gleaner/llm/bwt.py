"""Common substrings of a minimum length by interval expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np


def suffix_ranks(data: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of all suffixes of some strings, each closed by a terminator of its own (symbol 0 at the
    places ``ends``; earlier terminators are smaller), by prefix doubling from eight symbols; and the
    ranks as they were when suffixes had been compared by ``depth`` (8, 16, 32, ...) symbols: suffixes
    that agree so far share their first one's rank."""
    n = len(data)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    to_end = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | np.where(to_end >= i, padded[i : n + i], 0).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    sorted_keys = key[order]
    closed = to_end[order] < 8
    new = np.r_[True, (sorted_keys[1:] != sorted_keys[:-1]) | closed[1:] | closed[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    length, at_depth = 8, rank if depth == 8 else None
    while True:
        # groups of several suffixes; all of their members reach past `length` symbols
        alone = np.r_[new, True]
        open_ = order[~(alone[:-1] & alone[1:])]
        if not len(open_):
            break
        second = rank[open_ + length]
        by = np.argsort(rank[open_] * np.int64(n) + second, kind="stable")
        open_, second = open_[by], second[by]
        group = rank[open_]
        first = np.r_[True, group[1:] != group[:-1]]
        new = first | np.r_[True, second[1:] != second[:-1]]
        begin = np.maximum.accumulate(np.where(first, np.arange(len(open_)), 0))
        sub = np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))
        rank = rank.copy()
        rank[open_] = group + sub - begin
        order = open_
        length *= 2
        if length == depth:
            at_depth = rank
    return rank, rank if at_depth is None else at_depth


def repeated_strings(data: np.ndarray, lengths: np.ndarray, starts: np.ndarray, least: int, seed: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Which strings of ``least`` bytes, of those at the first ``starts`` places of each row, are equal:
    their places in data and an interval number; places of one number hold equal strings.

    The intervals of depth ``seed`` come from sorting. From there, breadth first, every interval of
    depth d is extended backwards by each symbol that the transform has before it, which gives all
    intervals of depth d + 1: suffixes j - 1 and j stay together if they begin with the same symbol and
    their successors are in one interval of depth d. Expansion stops at ``least``; intervals of one
    suffix are dropped on the way, as are suffixes that can't become the beginning of a wanted string.
    Bytes 254 and 255, which UTF-8 never has, must not occur.
    """
    rows = len(lengths)
    ends = np.cumsum(lengths + 1) - 1
    text = np.zeros(int(ends[-1]) + 1 if rows else 0, np.uint8)
    mask = np.ones(len(text), bool)
    mask[ends] = False
    text[mask] = data + 1
    rank, shallow = suffix_ranks(text, ends, seed)
    place = np.arange(len(text)) - np.repeat(ends - lengths, lengths + 1)  # within the row
    wanted = np.repeat(starts, lengths + 1)
    depth = seed
    # at depth d, the suffixes needed are those whose place is least - d more than that of a wanted start
    reach = least - depth
    live = np.flatnonzero((place >= reach) & (place < reach + wanted) & (text > 0))
    by = np.argsort(rank[live])
    live = live[by]
    interval = shallow[live]
    number = np.full(len(text), -1, np.int64)
    while True:
        new = np.r_[True, interval[1:] != interval[:-1]] if len(live) else np.zeros(0, bool)
        alone = np.r_[new, True]
        several = ~(alone[:-1] & alone[1:]) if len(live) else new
        live, interval = live[several], np.cumsum(new)[several]
        if depth == least or not len(live):
            break
        number[live] = interval
        before = live - 1  # backward extension
        before = before[(place[live] > 0)]
        at = rank[before]
        order = np.argsort(at, kind="stable")
        before = before[order]
        inner = number[before + 1] * 256 + text[before]
        number[live] = -1
        interval = inner
        live = before
        depth += 1
        keep = place[live] >= least - depth
        live, interval = live[keep], interval[keep]
    row = np.repeat(np.arange(rows), lengths + 1)
    return live - row[live], interval
