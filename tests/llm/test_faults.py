"""Inputs that broke operators once: malformed files, very long words, columns that clash."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import bpe, exact_dedup, langid, media, near_dedup
from gleaner.llm.media import box, full


def file_of(*tables, mdhd=b"\0" * 12 + struct.pack(">II", 1000, 5000)):
    stbl = box(b"stbl", *tables)
    return box(b"moov", box(b"trak", box(b"mdia", box(b"mdhd", mdhd), box(b"minf", stbl))))


ONE = (full(b"stsc", struct.pack(">IIII", 1, 1, 5, 1)), full(b"stsz", struct.pack(">II", 2, 5)), full(b"stco", struct.pack(">II", 1, 100)))
BAD = {
    "an empty header": file_of(mdhd=b""),
    "key sample 0": file_of(*ONE, full(b"stss", struct.pack(">III", 2, 0, 3))),
    "key samples fall": file_of(*ONE, full(b"stss", struct.pack(">III", 2, 3, 1))),
    "four billion keys": file_of(*ONE, full(b"stss", struct.pack(">II", 0xFFFFFFFF, 1))),
    "four billion sizes": file_of(full(b"stsz", struct.pack(">II", 0, 0xFFFFFFFF)), *ONE[::2]),
    "four billion chunks": file_of(*ONE[:2], full(b"stco", struct.pack(">II", 0xFFFFFFFF, 1))),
    "empty tables": file_of(box(b"stsc"), box(b"stsz"), box(b"stco"), box(b"stss"), box(b"stsd"), box(b"stts")),
}


@pytest.mark.parametrize("kind", BAD)
def test_malformed_files(kind):
    with pytest.raises(media.Malformed):
        media.read_container(BAD[kind])


def test_malformed_files_have_no_tracks(spark):
    deep = b""
    for _ in range(3000):
        deep = box(b"moov", deep)
    many = file_of(full(b"stsc", struct.pack(">IIII", 1, 1, 0xFFFFFFFF, 1)), full(b"stsz", struct.pack(">II", 1, 0xFFFFFFFF)), full(b"stco", struct.pack(">II", 1, 100)))
    rows = [*enumerate(BAD.values()), (100, deep), (101, many), (102, file_of(*ONE)), (103, file_of(*ONE, full(b"stss", struct.pack(">III", 2, 1, 4))))]
    got = {r.id: r.tracks for r in media.tracks(spark.createDataFrame(rows, "id int, media binary")).collect()}
    assert all(got[i] == [] for i in range(len(BAD))) and got[100] == []
    keys = lambda i: [(k.start, k.stop) for k in got[i][0].keyframes]
    assert keys(101) == [(100, 100 + 0xFFFFFFFF)] and keys(102) == [(100, 110)] and keys(103) == [(100, 102), (106, 108)]
    assert got[102][0].duration == 5.0


def test_no_corruption_breaks_the_reader():
    rnd, whole = random.Random(3), media.write_container(bytes(range(256)) * 600)
    head = len(whole) - 256 * 600
    for _ in range(3000):
        data = bytearray(whole[: rnd.choice([head, head + 1000])])
        for _ in range(rnd.randint(1, 6)):
            data[rnd.randrange(head)] = rnd.choice([0, 1, 255, rnd.randrange(256)])
        try:
            media.read_container(bytes(data))
        except media.Malformed:
            pass


def test_exact_dedup_leaves_columns_alone(spark):
    rows = [(1, "same", "own sha", {"k": 1}, "a"), (2, "same", "other sha", {"k": 2}, "b"), (2, "same", "other sha", {"k": 3}, "b"), (3, "alone", "third", None, "c"), (4, None, "n", {}, "d"), (5, "", "m", {}, "e")]
    names = ("__sha", "m", "__key")
    df = spark.createDataFrame(rows, "doc_id long, text string, __sha string, m map<string,int>, __key string")
    df = df.withColumns({c: F.col("__sha") for c in ("sha", "key", "suspect", "gone_id", "tied_sha", "row", "__suspect", "__row", "__tied", "key_")})
    got = sorted((r.doc_id, *(r[c] for c in names), r.sha, r.row) for r in exact_dedup.drop_exact_duplicates(df).collect())
    assert got == [(2, "other sha", {"k": 3}, "b", "other sha", "other sha"), (3, "third", None, "c", "third", "third"), (5, "m", {}, "e", "m", "m")]
    assert exact_dedup.drop_exact_duplicates(df).columns == df.columns


def test_near_dedup_and_language_with_clashing_columns(spark):
    text = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (2, text + " more"), (3, "quite another text")], "doc_id long, text string").withColumns({c: F.lit(7) for c in ("__gone", "gone", "rep", "component_id")})
    assert sorted((r.doc_id, r["__gone"], r.gone) for r in near_dedup.drop_near_duplicates(df).collect()) == [(1, 7, 7), (3, 7, 7)]
    labelled = spark.createDataFrame([(t, lang) for lang, t in (("en", "the cat sat on the mat"), ("de", "der Hund lag auf dem Teppich")) for _ in range(3)], "text string, lang string")
    model = langid.fit(labelled)
    got = langid.predict(labelled.withColumns({"__lang": F.lit("own"), "__score": F.lit("x")}), model)
    assert got.columns.count("__lang") == 1 and {r["__lang"] for r in got.collect()} == {"en", "de"}


def test_lexicon_holds_no_long_words(spark, tokenizer_path, monkeypatch):
    """One unbroken text of three million letters, and one of a repeated byte, twice each."""
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    rnd = random.Random(5)
    long_ = "".join(rnd.choices("etaoinshrdlu", k=300_000))
    rows = [(1, long_), (2, long_), (3, "a" * 200_000), (4, "the cat"), (5, "the " + long_[:70])]
    longest = []
    real = bpe.Automaton.compile
    monkeypatch.setattr(bpe.Automaton, "compile", lambda entries: longest.append(max(map(len, entries))) or real(entries))
    got = {r.doc_id: r for r in bpe.encode_decode(spark.createDataFrame(rows, "doc_id long, text string"), path, with_ids=True).collect()}
    assert longest[0] <= 64
    tokenizer = Tokenizer.from_file(path)
    assert all(got[i].ids == tokenizer.encode(t, add_special_tokens=False).ids and got[i].decoded == t for i, t in rows)


def test_one_long_word_takes_memory_in_proportion(tokenizer_path):
    import tracemalloc

    known, rnd = bpe.Vocabulary(tokenizer_path("byte_bpe_50k.json")), random.Random(7)
    word = bytes(rnd.choices(b"etaoinshr", k=300_000))
    known.merge_long(b"warm up")
    tracemalloc.start()
    ids = np.frombuffer(known.merge_long(word), "<u4")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert b"".join(known.bytes[i] for i in ids) == word and peak < 120 * len(word)
