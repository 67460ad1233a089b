"""Language ID and the forest of secret scans against plain loops."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from gleaner.llm import langid, secrets
from gleaner.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_features(text):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    counts = [0] * langid.DIMENSIONS
    for i in range(len(low) - 1):
        pair = low[i] | low[i + 1] << 8
        counts[(pair * 0x9E3779B1 & 0xFFFFFFFF) >> 20] += 1
        if i + 2 < len(low):
            triple = pair | low[i + 2] << 16
            counts[(triple * 0x85EBCA6B + 0x5BD1E995 & 0xFFFFFFFF) >> 20] += 1
    roots = [math.sqrt(c) for c in counts]
    norm = math.sqrt(sum(r * r for r in roots)) or 1.0
    return [r / norm for r in roots]


def plain_predict(model, x):
    """The family with the largest margin, then in it the language with the most votes of pairs."""
    dot = lambda w: sum(a * float(b) for a, b in zip(x, w[:-1]) if a) + float(w[-1])
    margins = [dot(w) for w in model.family_weights] if len(model.families) > 1 else [4.0]
    family = max(range(len(margins)), key=lambda i: margins[i])
    members = model.members[family]
    if len(members) == 1:
        return members[0], margins[family]
    votes, sums = [0] * len(members), [0.0] * len(members)
    for (a, b), w in zip(model.pairs[family], model.pair_weights[family]):
        m = dot(w)
        votes[a if m >= 0 else b] += 1
        sums[a] += m
        sums[b] -= m
    best = max(range(len(members)), key=lambda i: (votes[i], sums[i]))
    return members[best], min(margins[family], sums[best] / (len(members) - 1))


def test_language_of_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = langid.fit(docs.filter(~held_out))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in QUERIES["op7_language_id"](spark, SF).collect():
        text = texts[r.doc_id]
        if text is None or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        lang, margin = plain_predict(model, plain_features(text))
        assert abs(r.score - 1 / (1 + math.exp(-3 * margin))) < 1e-4
        assert r.lang_pred == lang or abs(margin) < 1e-3


def test_machines_come_near_the_least_loss():
    rnd = np.random.default_rng(3)
    x = rnd.normal(0, 1, (60, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    positive = x[:, 0] + 0.3 * rnd.normal(0, 1, 60) > 0
    weight = np.where(positive, 0.5 / positive.sum(), 0.5 / (~positive).sum())
    y = np.where(positive, 1.0, -1.0)

    def loss(w):
        return 0.5e-4 * (w[:-1] ** 2).sum() + (weight * np.maximum(0, 1 - y * (x @ w[:-1] + w[-1])) ** 2).sum()

    w = np.zeros(9)
    for _ in range(60_000):  # plain descent with small steps
        slack = np.maximum(0, 1 - y * (x @ w[:-1] + w[-1])) * weight * y
        w -= 0.05 * np.concatenate((1e-4 * w[:-1] - 2 * slack @ x, [-2 * slack.sum()]))
    fitted = langid.fit_svm(x, positive).astype(float)
    assert loss(fitted) < loss(w) * 1.02 + 1e-6


def test_forest_by_plain_walks_and_splits():
    rnd = random.Random(8)
    x = np.array([[rnd.choice([0, 1, 2, 5, rnd.random()]) for _ in range(6)] for _ in range(200)])
    y = np.array([float(r[0] + r[1] * rnd.random() > 2) for r in x])
    forest = secrets.Forest(x, y, trees=7, depth=5)

    def walk(tree, row):
        feature, threshold, left, right, share = tree
        at = 0
        while feature[at] >= 0:
            at = int(left[at] if row[feature[at]] <= threshold[at] else right[at])
        return share[at]

    got = forest.predict(x)
    assert all(abs(got[i] - sum(walk(t, row) for t in forest.trees) / 7) < 1e-12 for i, row in enumerate(x))

    # a tree that may use every feature splits where no other split leaves less impurity
    nodes: list = []
    forest._grow(x, y, 3, x.shape[1], np.random.default_rng(1), nodes)

    def impurity(labels):
        p = sum(labels) / len(labels)
        return len(labels) * p * (1 - p)

    def check(at, rows):
        feature, threshold, left, right, share = nodes[at]
        assert abs(share - np.mean([y[i] for i in rows])) < 1e-12
        if feature < 0:
            return
        parts = lambda f, t: ([i for i in rows if x[i, f] <= t], [i for i in rows if x[i, f] > t])
        cost = lambda f, t: sum(impurity([y[i] for i in p]) for p in parts(f, t) if p)
        every = [(f, (a + b) / 2) for f in range(x.shape[1]) for v in [sorted({x[i, f] for i in rows})] for a, b in zip(v, v[1:])]
        assert cost(feature, threshold) <= min(cost(f, t) for f, t in every) + 1e-9
        small, large = parts(feature, threshold)
        check(left, small)
        check(right, large)

    check(0, list(range(len(x))))
