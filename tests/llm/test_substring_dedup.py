"""Seed and extend against comparison of all windows."""

import hashlib
import random

import numpy as np
import pytest

from gleaner.llm import kernels as K
from gleaner.llm.queries import ORACLE_SQL, QUERIES
from gleaner.llm.substring_dedup import remove_repeated_windows
from tests import oracle


def plain(rows, window):
    """(doc_id, n_words, n_removed, hash) of every row, by a table of all windows."""
    smallest = -(1 << 63)
    texts = [(smallest if i is None else i, (t or "").encode().split()) for i, t in rows]
    earliest = {}
    for i, words in texts:
        for a in range(len(words) - window + 1):
            key = tuple(words[a : a + window])
            earliest[key] = min(earliest.get(key, i), i)
    out = []
    for (i, words), (doc, _) in zip(texts, rows):
        gone = set()
        for a in range(len(words) - window + 1):
            if earliest[tuple(words[a : a + window])] < i:
                gone.update(range(a, a + window))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def collected(df):
    return sorted(map(tuple, df.collect()), key=repr)


def passages(n=80):
    """Documents cut from a few long passages, at any place, with words changed here and there."""
    rnd = random.Random(13)
    base = [[rnd.choice("abcdefgh") * rnd.randint(1, 2) for _ in range(120)] for _ in range(3)]
    line = [f"w{i}" for i in range(14)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rnd.randint(1, 3)):
            part = rnd.choice(base)
            a = rnd.randrange(100)
            words += part[a : a + rnd.randint(5, 90)] + (line if rnd.random() < 0.6 else []) + [f"own{rnd.randrange(40)}" for _ in range(rnd.randint(0, 6))]
        if rnd.random() < 0.5:
            words[rnd.randrange(len(words))] = "CHANGED"
        rows.append((rnd.randint(0, 60), rnd.choice([" ", "\n", " \t "]).join(words)))
    return rows + rows[:5]


@pytest.mark.parametrize(("window", "seed", "hot"), [(20, 5, 10_000), (20, 5, 3), (20, 20, 10_000), (12, 1, 10_000), (50, 10, 5)])
def test_passages(spark, window, seed, hot):
    rows = passages()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert collected(remove_repeated_windows(df, window=window, seed=seed, hot=hot)) == plain(rows, window)


def test_few_words_alike(spark):
    # periodic texts, in which an anchor occurs many times at every place
    rows = [(1, "a b " * 60), (2, "a b " * 40 + "c " + "a b " * 40), (3, "b a " * 30), (4, "a " * 100), (5, "a " * 70)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert collected(remove_repeated_windows(df)) == plain(rows, 50)


@pytest.mark.parametrize("hot", [10_000, 1])
def test_odd_rows(odd, hot):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    with_names = odd.withColumns({c: odd["doc_id"] for c in ("doc", "key", "anchor", "print", "first", "lo", "spans", "words", "at", "offset")})
    for window in (8, 50):
        assert collected(remove_repeated_windows(with_names, window=window, seed=4, hot=hot)) == plain(rows, window)


def test_many_equal_rows_and_a_very_long_text(spark):
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(None, passage)] * 300 + [(i, f"x{i} {passage} y{i}") for i in range(50)] + [(99, "z" * 3_000_000), (100, f"{passage} " * 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert collected(remove_repeated_windows(df, hot=20)) == plain(rows, 50)


def test_kept_text(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    df = spark.createDataFrame([(2, f"before\n{passage}  after "), (1, passage), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.kept_text for r in remove_repeated_windows(df, with_kept=True).collect()}
    assert got == {1: passage, 2: "before after", 3: ""}


def test_empty(empty):
    assert remove_repeated_windows(empty).count() == 0


def test_sql_and_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    got = oracle.rows(QUERIES["op13_substring_dedup"](spark, sf))
    assert got == oracle.expected(oracle.connect(sf), ORACLE_SQL["op13_substring_dedup"])
    assert sum(r[2] > 0 for r in got[1]) > 5


def test_word_spans():
    rnd = random.Random(2)
    for _ in range(200):
        texts = ["".join(rnd.choices(" \tab\n\x0bé", k=rnd.randint(0, 9))).encode() for _ in range(rnd.randint(1, 6))]
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        first, last, counts = K.word_spans(data, offsets)
        assert [bytes(data[a:b]) for a, b in zip(first, last)] == [w for t in texts for w in t.split()]
        assert counts.tolist() == [len(t.split()) for t in texts]
