"""Ranked search against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.llm import lexical
from gleaner.llm.lexical import rank_documents
from gleaner.llm.queries import ORACLE_SQL, QUERIES
from tests import oracle

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        asked, scores = set(terms(text)), []
        for doc, c in held:
            m = 50 + (50 * c.total() * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in asked & c.keys())
            if score > 0:
                scores.append((-score, doc is not None, doc or 0))
        out += [(item, r, d if known else None, -s) for r, (s, known, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def collected(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


def corpus(n=700, vocabulary=150):
    rnd = random.Random(21)
    word = lambda: f"Term{min(int(rnd.paretovariate(0.7)), vocabulary)}"
    docs = [(i, ", ".join(word() for _ in range(rnd.randint(0, 40)))) for i in range(n)]
    items = [(i, " ".join({word() for _ in range(rnd.randint(1, 20))})) for i in range(40)]
    return docs + [(n + i, docs[7][1]) for i in range(60)], items


@pytest.mark.parametrize("limits", [{}, {"CELLS": 3000, "FIRST": 2, "AIM": 4, "SHORT": 2}, {"CELLS": 20_000, "FIRST": 3, "WIDTH": 5, "ITEMS": 7, "MOST": 9}, {"TERMS": 30, "SHORT": 0}])
def test_ranking(spark, limits, monkeypatch):
    for name, value in limits.items():
        monkeypatch.setattr(lexical, name, value)
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    i = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    assert collected(rank_documents(d, i, k=10)) == plain(docs, items, 10)


def test_odd_rows(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    names = {c: odd["doc_id"] for c in ("item_id", "item", "score", "rank", "payload", "term", "df", "docs", "terms")}
    items = [(1, "the quick LAZY house, über"), (None, "EIN text without"), (1, "the quick LAZY house, über"), (3, None), (4, ""), (5, "?!"), (6, "日本語 ΑΣ end long"), (7, "absent")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.col("item_id") for c in ("doc_id", "score", "rank")})
    assert collected(rank_documents(odd.withColumns(names), asked)) == plain(rows, items, 50)


def test_empty(spark, empty):
    items = spark.createDataFrame([(1, "the")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "the end"), (2, None)], "doc_id long, text string")
    assert rank_documents(empty, items).count() == 0
    assert rank_documents(docs, items.limit(0)).count() == 0
    assert rank_documents(docs.filter("doc_id = 2"), items).count() == 0


def test_very_long_item_and_document(spark):
    long_ = " ".join(f"w{i}" for i in range(30_000))
    docs, items = [(1, long_), (2, "w1 w2 w29999 " * 50_000), (3, "w5"), (4, "x" * 2_000_000)], [(1, long_), (2, "w5 w2"), (3, "x" * 2_000_000)]
    got = rank_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert collected(got) == plain(docs, items, 50)


def test_sql_and_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    assert oracle.rows(QUERIES["op12_lexical_search"](spark, sf)) == oracle.expected(oracle.connect(sf), ORACLE_SQL["op12_lexical_search"])


def test_blocks_are_skipped_and_bounds_hold():
    """Documents of a few topics: most blocks are skipped, and no block's bound is below a score in it."""
    rnd = random.Random(4)
    docs = [" ".join(rnd.choices([f"t{topic}x{j}" for j in range(30)] + ["and", "the"], k=60)) for topic in range(60) for _ in range(30)]
    rnd.shuffle(docs)
    (block,) = lexical.pack_items(iter([pa.record_batch([pa.array([1, 2], pa.int64()), pa.array(["the and t3x1 t3x2 t3x3 t3x4 t3x5", "and the t9x1 t9x7"])], ["item_id", "text"])]))
    asked = lexical.Asked(block.column("payload")[0].as_py())

    class Shared:
        value = asked

    batch = pa.record_batch([pa.array(range(len(docs)), pa.int64()), pa.array(docs)], ["doc_id", "text"])
    (row,) = lexical.vectorise(Shared)(iter([batch]))
    held = Counter(t for d in docs for t in set(d.split()))
    known = {int(lexical.term_hashes(pa.array([t])).__next__()[2][0]): n for t, n in held.items()}
    asked.weigh(row.column("docs")[0].as_py(), row.column("terms")[0].as_py(), {i: known[int(h)] for i, h in enumerate(asked.vocabulary)})
    asked.prepare()
    payload = lexical.build_shard(asked, row.column("payload")[0].as_py())
    best = [lexical.Best(10, 0) for _ in asked.items]
    pairs, skipped = lexical.search_shard(asked, payload, best)
    assert pairs > 100 and skipped > 0.5 * pairs
    assert sorted((i + 1, r + 1, int(d), int(s)) for i, b in enumerate(best) for r, (d, s) in enumerate(zip(b.doc, b.score))) == sorted(plain(list(enumerate(docs)), [(1, "the and t3x1 t3x2 t3x3 t3x4 t3x5"), (2, "and the t9x1 t9x7")], 10))
    # the stored summaries are the maxima of their blocks' documents
    ids, _, offsets, columns, impact, terms_, list_ends, block_ends, places, rest = lexical.unpack(payload, lexical.INDEX_ARRAYS)
    table, ends = lexical.dense(offsets, columns, impact, len(asked.vocabulary)), rest[: len(terms_) + 1]
    for j, t in enumerate(terms_.tolist()):
        stored = rest[len(terms_) + 1 :][ends[j] : ends[j + 1]].reshape(list_ends[j + 1] - list_ends[j], -1)
        for b in range(list_ends[j], list_ends[j + 1]) if stored.size else ():
            docs_ = places[block_ends[b] : block_ends[b + 1]]
            assert (stored[b - list_ends[j]] == table[np.ix_(docs_, asked.columns(t))].max(axis=0)).all()
