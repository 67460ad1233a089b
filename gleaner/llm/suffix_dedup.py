"""Removal of repeated passages: every byte that a string of ``least`` bytes covers which also starts
earlier, in an earlier document or further up in the same one.

Common strings are found by threshold-bounded interval expansion on Burrows-Wheeler transforms
(gleaner.llm.bwt). A transform of a whole corpus fits no machine, so strings that may be equal are
brought together first, a few at a time:

* Of each string of ``least`` bytes, the ``inner``-byte substring of the smallest hash is its anchor;
  equal strings have equal anchors. Texts are dealt into shards by document, anchors into buckets by
  hash.
* Step by step (shards to buckets and back): which anchors occur again; of these, the run of strings
  that they anchor. Runs that are equal as a whole need no transform: all but the first are repeats.
  Only of anchors with several different runs are the bytes fetched, once for each different run, and
  a bucket's runs put through one transform after another of bounded size.
* An anchor that occurs more than ``hot`` times is replaced by longer ones, the ``least``-byte strings
  themselves, which spread over all buckets. Within a shard, equal runs are reduced to their first
  before anything is sent, so no bucket gets more of one run than there are shards.

Rows between the steps are few and large: packed arrays for one bucket or shard.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import kernels as K
from gleaner.llm.bwt import repeated_strings

BLOCK = 2 << 20
#: Bytes of runs in one transform.
TRANSFORM = 2 << 20
FLUSH = 1_000_000
#: Values of bytes for a second hash of a string.
SECOND = K.mix(K.BYTE_VALUE)
PARCEL = "target int, kind int, shard int, payload binary"
NAMES = ["target", "kind", "shard", "payload"]
ANCHOR = np.dtype([("hash", "<u8"), ("shard", "<i4"), ("n", "<i4")])
RUN = np.dtype([("hash", "<u8"), ("print", "<u8"), ("doc", "<i8"), ("row", "<i4"), ("start", "<i4"), ("count", "<i4"), ("shard", "<i4")])
SPAN = np.dtype([("row", "<i4"), ("start", "<i4"), ("count", "<i4")])
ANCHORS, KNOWN, RUNS, SPANS, ASKED, BYTES = range(6)


def _parcels(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * 4
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], NAMES)


def _split(records: np.ndarray, target: np.ndarray, kind: int, shard: int = -1) -> list[tuple]:
    """One parcel of records for each target."""
    order = np.argsort(target, kind="stable")
    records, target = records[order], target[order]
    cuts = np.flatnonzero(np.r_[True, target[1:] != target[:-1]]) if len(target) else np.zeros(0, np.int64)
    return [(int(target[a]), kind, shard, records[a:b].tobytes()) for a, b in zip(cuts, np.r_[cuts[1:], len(target)])]


def _read(table: pa.Table, kind: int, dtype: np.dtype) -> np.ndarray:
    rows = [p for k, p in zip(table.column("kind").to_pylist(), table.column("payload").to_pylist()) if k == kind]
    return np.frombuffer(b"".join(rows), dtype)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (K.mix(hashes ^ np.uint64(0x51ED270B)) % np.uint64(buckets)).astype(np.int64)


class _Job:
    """The steps for one set of parameters; a plain object, so that Spark can ship it."""

    def __init__(self, least: int, inner: int, hot: int, shards: int):
        self.least, self.inner, self.hot, self.shards = least, inner, hot, shards

    # -- texts -> buckets
    def send_anchors(self, batches):
        kept, size = [], 0

        def flush():
            found = np.concatenate(kept)
            order = np.lexsort((found["shard"], found["hash"]))
            found = found[order]
            new = np.flatnonzero(np.r_[True, (found["hash"][1:] != found["hash"][:-1]) | (found["shard"][1:] != found["shard"][:-1])])
            out = found[new].copy()
            out["n"] = np.add.reduceat(found["n"], new)
            yield from _parcels(_split(out, _bucket(out["hash"], self.shards), ANCHORS)).to_batches()

        for batch in batches:
            data, offsets = K.flat(batch.column("text"))
            shard = batch.column("shard").to_numpy()
            for a, b in K.blocks(offsets, BLOCK):
                at = offsets[a : b + 1] - offsets[a]
                first, _, _, hashes, _ = K.anchors(data[offsets[a] : offsets[b]], at, self.least, self.inner)
                if len(first):
                    rec = np.empty(len(first), ANCHOR)
                    rec["hash"], rec["n"] = hashes, 1
                    rec["shard"] = shard[a:b][np.searchsorted(at, first, side="right") - 1]
                    kept.append(rec)
                    size += len(rec)
            if size > FLUSH:
                yield from flush()
                kept, size = [], 0
        if kept:
            yield from flush()

    # -- buckets -> shards
    def send_known(self, table: pa.Table) -> pa.Table:
        """Anchors that occur again, to the shards that have them; count -1 marks hot ones."""
        found = _read(table, ANCHORS, ANCHOR)
        if not len(found):
            return _parcels([])
        found = found[np.lexsort((found["shard"], found["hash"]))]
        begin = np.flatnonzero(np.r_[True, found["hash"][1:] != found["hash"][:-1]])
        total = np.repeat(np.add.reduceat(found["n"], begin), np.diff(np.r_[begin, len(found)]))
        found = found.copy()
        found["n"] = np.where(total > self.hot, -1, 1)
        found = found[total > 1]
        found = found[np.r_[True, (found["hash"][1:] != found["hash"][:-1]) | (found["shard"][1:] != found["shard"][:-1])]] if len(found) else found
        return _parcels(_split(found, found["shard"], KNOWN))

    def _shard(self, texts: pa.Table):
        """Row order of a shard (by id, null first, then text), its ids, bytes and offsets."""
        doc = texts.column("doc_id").fill_null(-(1 << 63)).to_numpy()
        text = texts.column("text").fill_null("")
        order = np.argsort(doc, kind="stable")
        same = doc[order][1:] == doc[order][:-1]
        if same.any():
            order = pa.compute.sort_indices(pa.table({"d": doc, "t": text}), sort_keys=[("d", "ascending"), ("t", "ascending")]).to_numpy()
        return order, doc[order], *K.flat(text.take(pa.array(order)))

    # -- shards -> buckets
    def send_runs(self, texts: pa.Table, parcels: pa.Table) -> pa.Table:
        known = _read(parcels, KNOWN, ANCHOR)
        if not len(known) or not len(texts):
            return _parcels([])
        shard = int(known["shard"][0])
        known = known[np.argsort(known["hash"])]
        _, doc, data, offsets = self._shard(texts)
        runs, hot = [], []
        for a, b in K.blocks(offsets, BLOCK):
            part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            first, count, anchor, hashes, prints = K.anchors(part, at, self.least, self.inner)
            where = np.minimum(np.searchsorted(known["hash"], hashes), len(known) - 1)
            hit = known["hash"][where] == hashes
            is_hot = hit & (known["n"][where] < 0)
            row = np.searchsorted(at, first, side="right") - 1
            for take, out in ((hit & ~is_hot, runs), (is_hot, hot)):
                r = np.empty(int(take.sum()), RUN)
                r["hash"], r["print"], r["row"], r["count"], r["shard"] = hashes[take], prints[take], row[take] + a, count[take], shard
                r["start"], r["doc"] = first[take] - at[row[take]], doc[row[take] + a]
                if out is hot and len(r):  # the strings themselves in place of the anchor
                    n = r["count"].astype(np.int64)
                    r = np.repeat(r, n)
                    shift = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)
                    begin = np.repeat(first[take], n) + shift
                    inverse = K.powers(len(part) + 1)[1]
                    strings, prints = ((s[begin + self.least] - s[begin]) * inverse[begin] for s in (K.prefix_sums(part), K.prefix_sums(part, SECOND)))
                    r["start"] += shift.astype(np.int32)
                    r["count"] = 1
                    r["hash"], r["print"] = K.mix(strings ^ np.uint64(0x7F4A7C15)), K.mix(prints)
                out.append(r)
        runs = np.concatenate(runs + hot)
        runs = runs[np.lexsort((runs["start"], runs["row"], runs["print"], runs["hash"]))]
        first = np.r_[True, (runs["hash"][1:] != runs["hash"][:-1]) | (runs["print"][1:] != runs["print"][:-1])] if len(runs) else np.zeros(0, bool)
        firsts = runs[first]
        out = _split(firsts, _bucket(firsts["hash"], self.shards), RUNS)
        repeats = runs[~first]
        if len(repeats):
            spans = _merged(repeats)
            out.append((shard, SPANS, shard, spans.tobytes()))  # through a bucket of the same number
        return _parcels(out)

    # -- buckets -> shards
    def send_repeats(self, table: pa.Table) -> pa.Table:
        """Runs that are equal to an earlier one as a whole; and those whose bytes are asked for."""
        passed = [(s, SPANS, s, p) for k, s, p in zip(*(table.column(c).to_pylist() for c in NAMES[1:])) if k == SPANS]
        runs = _read(table, RUNS, RUN)
        if not len(runs):
            return _parcels(passed)
        runs = runs[np.lexsort((runs["start"], runs["row"], runs["doc"], runs["print"], runs["hash"]))]
        first = np.r_[True, (runs["hash"][1:] != runs["hash"][:-1]) | (runs["print"][1:] != runs["print"][:-1])]
        repeats, runs = runs[~first], runs[first]
        out = []
        for target in np.unique(repeats["shard"]).tolist():
            out.append((target, SPANS, target, _merged(repeats[repeats["shard"] == target]).tobytes()))
        begin = np.r_[True, runs["hash"][1:] != runs["hash"][:-1]]
        alone = begin & np.r_[begin[1:], True]
        asked = runs[~alone]
        return _parcels(passed + out + _split(asked, asked["shard"], ASKED))

    # -- shards -> buckets
    def send_bytes(self, texts: pa.Table, parcels: pa.Table) -> pa.Table:
        asked = _read(parcels, ASKED, RUN)
        if not len(asked):
            return _parcels([])
        _, _, data, offsets = self._shard(texts)
        target = _bucket(asked["hash"], self.shards)
        order = np.argsort(target, kind="stable")
        asked, target = asked[order], target[order]
        cuts = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
        out = []
        for a, b in zip(cuts, np.r_[cuts[1:], len(asked)]):
            some = asked[a:b]
            begin = offsets[some["row"]] + some["start"]
            size = some["count"].astype(np.int64) + self.least - 1
            shift = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            out.append((int(target[a]), BYTES, int(some["shard"][0]), np.int64(len(some)).tobytes() + some.tobytes() + data[np.repeat(begin, size) + shift].tobytes()))
        return _parcels(out)

    # -- buckets -> shards
    def send_matches(self, table: pa.Table) -> pa.Table:
        """Of runs that differ as a whole, the strings that start earlier in another one."""
        runs, texts = [], []
        for p in table.column("payload").to_pylist():
            n = int(np.frombuffer(p, np.int64, 1)[0])
            runs.append(np.frombuffer(p, RUN, n, 8))
            texts.append(np.frombuffer(p, np.uint8, offset=8 + n * RUN.itemsize))
        if not runs:
            return _parcels([])
        runs, data = np.concatenate(runs), np.concatenate(texts)
        size = runs["count"].astype(np.int64) + self.least - 1
        begin = np.cumsum(size) - size
        order = np.lexsort((runs["start"], runs["row"], runs["doc"], runs["hash"]))  # first comes first
        runs, size, begin = runs[order], size[order], begin[order]
        group = np.flatnonzero(np.r_[True, runs["hash"][1:] != runs["hash"][:-1]])
        ends = np.r_[group[1:], len(runs)]
        total = np.cumsum(size)
        found, a = [], 0
        while a < len(runs):  # whole groups, up to TRANSFORM bytes
            limit = int(np.searchsorted(total, (total[a] - size[a]) + TRANSFORM, side="right"))
            b = int(ends[max(np.searchsorted(ends, limit, side="right") - 1, np.searchsorted(ends, a, side="right"))])
            n = size[a:b]
            shift = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            place, interval = repeated_strings(data[np.repeat(begin[a:b], n) + shift], n, runs["count"][a:b].astype(np.int64), self.least)
            by = np.lexsort((place, interval))
            place, interval = place[by], interval[by]
            later = np.r_[False, interval[1:] == interval[:-1]] if len(place) else np.zeros(0, bool)
            # of each interval the first place is the earliest: runs of a group are in order
            place = place[later]
            of = np.searchsorted(np.cumsum(n), place, side="right")
            hit = runs[a:b][of].copy()
            hit["start"] += (place - (np.cumsum(n) - n)[of]).astype(np.int32)
            hit["count"] = 1
            found.append(hit)
            a = b
        found = np.concatenate(found)
        return _parcels([(t, SPANS, t, _merged(found[found["shard"] == t]).tobytes()) for t in np.unique(found["shard"]).tolist()])

    # -- shards -> result
    def cut(self, texts: pa.Table, parcels: pa.Table) -> pa.Table:
        spans = _read(parcels, SPANS, SPAN)
        order, doc, data, offsets = self._shard(texts)
        begin = offsets[spans["row"]] + spans["start"]
        edge = np.zeros(len(data) + 1, np.int64)
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + spans["count"] + self.least - 1, -1)
        gone = np.cumsum(edge[:-1]) > 0
        sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(gone)))
        removed = sums[offsets[1:]] - sums[offsets[:-1]]
        rising = gone.copy()
        rising[1:] &= ~gone[:-1]
        inner = offsets[1:-1][offsets[1:-1] < len(data)]
        rising[inner] |= gone[inner]
        sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(rising)))
        n_spans = sums[offsets[1:]] - sums[offsets[:-1]]
        kept = []
        for a, b, n in zip(offsets[:-1].tolist(), offsets[1:].tolist(), removed.tolist()):
            part = data[a:b]
            kept.append((part if not n else part[~gone[a:b]]).tobytes())
        columns = [texts.column("doc_id").take(pa.array(order)), pa.array(np.diff(offsets)), pa.array(removed), pa.array(n_spans), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(kept, pa.binary())]
        return pa.table(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _merged(runs: np.ndarray) -> np.ndarray:
    """Spans of the runs' starts, neighbouring ones joined."""
    runs = runs[np.lexsort((runs["start"], runs["row"]))]
    end = runs["start"] + runs["count"]
    key = runs["row"].astype(np.int64) << 32
    reach = np.maximum.accumulate(key + end)
    new = np.r_[True, key[1:] + runs["start"][1:] > reach[:-1]] if len(runs) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    out = np.empty(len(at), SPAN)
    out["row"], out["start"] = runs["row"][at], runs["start"][at]
    last = np.r_[at[1:], len(runs)] - 1
    out["count"] = (reach[last] - key[at]) - runs["start"][at] if len(at) else 0
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 100, inner: int = 36, hot: int = 10_000, shard_bytes: int = 8 << 20, with_kept: bool = False) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256
    of the remaining bytes; with_kept adds ``kept`` (binary).

    Matches lie within single texts (as UTF-8) and are judged on the input. "Earlier" is by id, a null id
    first; rows that repeat an id follow one another by text. Null texts count as empty. Texts of under
    ``least`` bytes keep everything. An empty table gives no rows; further columns are ignored. A shard
    of about ``shard_bytes`` or one longer text is held in memory at a time; there are as many shards, and
    as many buckets, as that takes, and at least 16. Strings are told apart by 64-bit hashes of their anchors and, where whole runs are
    compared, by a further 64 bits.
    """
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()[0]
    shards = int(max(16, total // shard_bytes))
    job = _Job(least, inner, hot, shards)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))

    def at_bucket(parcels: DataFrame, step) -> DataFrame:
        return parcels.groupBy("target").applyInArrow(lambda parcels: step(parcels), PARCEL)

    def at_shard(parcels: DataFrame, step, schema: str = PARCEL) -> DataFrame:
        return texts.groupBy("shard").cogroup(parcels.groupBy("target")).applyInArrow(lambda texts, parcels: step(texts, parcels), schema)

    known = at_bucket(texts.mapInArrow(job.send_anchors, PARCEL), job.send_known)
    repeats = at_bucket(at_shard(known, job.send_runs), job.send_repeats)
    matches = at_bucket(at_shard(repeats, job.send_bytes), job.send_matches)
    result = at_shard(repeats.filter(F.col("kind") == SPANS).unionByName(matches), job.cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return result if with_kept else result.drop("kept")
