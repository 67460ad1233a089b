"""Media columns: ISO base-media files as a column, written and read box by box.

``write_container`` stores a payload as one track of 8-bit mono samples (``raw `` in the sample
description) in a file with the usual nesting: ftyp, moov > mvhd, trak > tkhd, mdia > mdhd, hdlr,
minf > smhd, dinf > dref, stbl > stsd, stts, stss, stsc, stsz, stco; and mdat. ``read_container``
walks the boxes of any such file and decodes the sample tables to codec, duration and the byte
ranges of the key frames; it never decodes a payload.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import per_batch

#: Boxes that hold other boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts", b"udta", b"mvex", b"moof", b"traf"}
RATE = 8000
#: Samples in a chunk; each chunk begins at a key sample.
CHUNK = 1 << 16


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    size = len(body) + 8
    if size < 1 << 32:
        return struct.pack(">I4s", size, kind) + body
    return struct.pack(">I4sQ", 1, kind, size + 8) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def write_container(payload: bytes, rate: int = RATE) -> bytes:
    """The payload, one sample a byte, as an ISO media file. Bytes are stored unchanged."""
    n = len(payload)
    chunks = max(1, -(-n // CHUNK))
    last = n - (chunks - 1) * CHUNK
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
    entry = box(b"raw ", b"\0" * 6, struct.pack(">H", 1), b"\0" * 8, struct.pack(">HHHHI", 1, 8, 0, 0, rate << 16 & 0xFFFFFFFF))

    def moov(base: int) -> bytes:
        runs = [(1, CHUNK)] if chunks > 1 else []
        runs += [(chunks, last)] if not runs or last != CHUNK else []
        offsets = [base + i * CHUNK for i in range(chunks)]
        wide = offsets[-1] >= 1 << 32
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, 1)),
            full(b"stss", struct.pack(f">I{chunks}I", chunks, *(i * CHUNK + 1 for i in range(chunks)))),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", first, samples, 1) for first, samples in runs)),
            full(b"stsz", struct.pack(">II", 1, n)),
            full(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets)),
        )
        dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        minf = box(b"minf", full(b"smhd", b"\0" * 4), dinf, stbl)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, rate, n, 0x55C4, 0)), full(b"hdlr", b"\0" * 4, b"soun", b"\0" * 12, b"\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), b"\0" * 8, struct.pack(">HHHH", 0, 0, 0x100, 0), _MATRIX, b"\0" * 8, flags=7)
        mvhd = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, rate, n, 0x10000, 0x100), b"\0" * 10, _MATRIX, b"\0" * 24, struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = 8 if n + 8 < 1 << 32 else 16
    before = len(ftyp) + len(moov(0))
    return ftyp + moov(before + head) + box(b"mdat", payload)


class Malformed(ValueError):
    """A table that its box doesn't hold, or that contradicts itself."""


def walk(data: bytes | memoryview, start: int = 0, end: int | None = None, path: tuple = ()):
    """(path, start, end of the contents) of every box, parents before children. A box whose size
    reaches past its parent ends the walk there; boxes nested deeper than any file has are not entered."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1 and start + 16 <= end:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            return
        yield (*path, kind), start + head, start + size
        if kind in NESTED and len(path) < 16:
            yield from walk(data, start + head, start + size, (*path, kind))
        start += size


def _table(data: bytes | memoryview, at: int, end: int, count: int, fields: str) -> list[tuple]:
    """``count`` entries of some fields from a place on, which the box has to hold."""
    entry = struct.Struct(">" + fields)
    if count * entry.size > end - at:
        raise Malformed(f"{count} entries in {end - at} bytes")
    return list(entry.iter_unpack(data[at : at + count * entry.size]))


def _number(data: bytes | memoryview, at: int, end: int, kind: str = "I") -> int:
    return _table(data, at, end, 1, kind)[0][0]


def read_container(data: bytes | memoryview) -> list[dict]:
    """For each track: codec, timescale, duration, n_samples, chunk ranges and key-frame ranges (start,
    stop in the file). A table that doesn't fit into its box raises Malformed; so nothing is larger than
    the file lets it be."""
    tracks: list[dict] = []
    for path, at, end in walk(data):
        kind = path[-1]
        if kind == b"trak":
            tracks.append({"codec": None, "timescale": 0, "duration": 0, "sync": None})
        if b"trak" not in path:
            continue
        t = tracks[-1]
        if kind == b"mdhd":
            wide = _number(data, at, end, "B") == 1
            ((t["timescale"], t["duration"]),) = _table(data, at + (20 if wide else 12), end, 1, "IQ" if wide else "II")
        elif kind == b"stsd":
            t["codec"] = bytes(data[at + 12 : min(at + 16, end)]).decode("latin-1")
        elif kind == b"stts":
            t["times"] = _table(data, at + 8, end, _number(data, at + 4, end), "II")
        elif kind == b"stss":
            t["sync"] = [x for (x,) in _table(data, at + 8, end, _number(data, at + 4, end), "I")]
            if any(b <= a for a, b in zip([0, *t["sync"]], t["sync"])):
                raise Malformed("key samples that don't rise")
        elif kind == b"stsc":
            t["runs"] = _table(data, at + 8, end, _number(data, at + 4, end), "III")
        elif kind == b"stsz":
            ((t["size"], t["n_samples"]),) = _table(data, at + 4, end, 1, "II")
            t["sizes"] = None if t["size"] else [x for (x,) in _table(data, at + 12, end, t["n_samples"], "I")]
        elif kind in (b"stco", b"co64"):
            t["offsets"] = [x for (x,) in _table(data, at + 8, end, _number(data, at + 4, end), "I" if kind == b"stco" else "Q")]
    for t in tracks:
        t["chunks"], t["keys"] = _ranges(t)
    return tracks


def _ranges(t: dict) -> tuple[list, list]:
    offsets, runs = t.get("offsets", ()), t.get("runs", ())
    if not runs or "n_samples" not in t:
        return [], []
    keys, chunks, sample = [], [], 1
    sync, at_key = t["sync"], 0
    run = 0
    for number, offset in enumerate(offsets, 1):
        while run + 1 < len(runs) and runs[run + 1][0] <= number:
            run += 1
        n = min(runs[run][1], t["n_samples"] - sample + 1)
        ends = list(accumulate(t["sizes"][sample - 1 : sample - 1 + n], initial=0)) if t["sizes"] is not None else None
        total = ends[-1] if ends is not None else n * t["size"]
        chunks.append((offset, offset + total))
        if sync is None:  # without a table every sample is one, and a chunk's samples are neighbours
            if total:
                keys.append((offset, offset + total))
        else:
            while at_key < len(sync) and sync[at_key] < sample + n:
                i = sync[at_key] - sample
                keys.append((offset + ends[i], offset + ends[i + 1]) if ends is not None else (offset + i * t["size"], offset + (i + 1) * t["size"]))
                at_key += 1
        sample += n
    return chunks, keys


def read_payload(data: bytes, track: dict) -> bytes:
    return b"".join(data[a:b] for a, b in track["chunks"])


RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration double, n_keyframes int, keyframe_ranges array<struct<start:long,stop:long>>"
UNIT = 192
_KEYS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def describe(text: str) -> tuple:
    raw = text.encode()
    payload = raw + b" " * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))
    stored = write_container(payload)
    (track,) = read_container(stored)
    back = read_payload(stored, track)
    duration = track["duration"] / track["timescale"]
    keys = [{"start": a, "stop": b} for a, b in track["keys"]]
    ranges = hashlib.md5(",".join(f"{a}-{b}" for a, b in track["keys"]).encode()).hexdigest()
    feature = f"{track['codec'].strip()};{track['timescale']};{track['duration']};{len(keys)};{ranges}"
    return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, track["codec"].strip(), duration, len(keys), keys


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: its bytes stored as an ISO media file and read back.

    A null or empty text is a payload of one unit of blanks. Equal texts give equal values. Repeated
    rows and null ids are kept as they are; an empty table gives no rows; further columns are ignored.
    """
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int32(), _KEYS)
    names = [c.split()[0] for c in RESULT.split(", ")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [describe(t.as_py() or "") for t in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(per_batch(run), RESULT)


def tracks(files: DataFrame, media_col: str = "media") -> DataFrame:
    """files without the media column and with ``tracks``: codec, duration in seconds and the byte ranges of
    the key frames of each track of an ISO media file.

    Payloads are not decoded. A null, an empty file, and bytes that are no such file have no tracks; a
    track without a table of key frames has a key frame in every sample: a range for each chunk. All rows are returned; a
    column that is called ``tracks`` already is replaced.
    """
    files = files.drop("tracks")
    names, kept = files.columns, [c for c in files.columns if c != media_col]
    kind = pa.list_(pa.struct([("codec", pa.string()), ("duration", pa.float64()), ("keyframes", _KEYS)]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for data in batch.column(names.index(media_col)):
            try:
                read = read_container(data.as_py() or b"")
            except Malformed:
                read = []
            found.append([{"codec": (t["codec"] or "").strip(), "duration": t["duration"] / t["timescale"] if t["timescale"] else None, "keyframes": [{"start": a, "stop": b} for a, b in t["keys"]]} for t in read])
        return pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in kept), pa.array(found, kind)], [*kept, "tracks"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*kept).schema.fields)
    return files.mapInArrow(per_batch(run), f"{fields}, tracks array<struct<codec:string,duration:double,keyframes:array<struct<start:long,stop:long>>>>")
