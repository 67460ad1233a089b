"""Whitening against plain numbers, and eigenvectors against another solver."""

import math

import numpy as np
import pytest

from gleaner.llm import eigen
from gleaner.llm.queries import op11_embedding_whitening
from gleaner.llm.whitening import Whitening, whiten


def check_pairs(a, values, vectors, k):
    want = np.linalg.eigvalsh(a)[::-1][:k]
    scale = max(np.abs(a).max(), 1e-300)
    assert np.abs(values - want).max() <= 1e-12 * scale * len(a)
    assert np.abs(vectors @ vectors.T - np.eye(k)).max() < 1e-11
    assert np.abs(vectors @ a - values[:, None] * vectors).max() <= 1e-12 * scale * len(a)


@pytest.mark.parametrize("kind", ["random", "repeated", "identity", "zero", "blocks", "low rank", "graded", "one", "two", "diagonal"])
def test_eigenpairs(kind):
    rnd = np.random.default_rng(5)
    q, _ = np.linalg.qr(rnd.standard_normal((40, 40)))
    x = rnd.standard_normal((40, 40))
    a = {
        "random": x @ x.T, "repeated": (q * np.repeat([9.0, 4.0, 4.0 - 1e-13, 1.0], 10)) @ q.T, "identity": 3 * np.eye(40), "zero": np.zeros((40, 40)), "blocks": np.kron(np.eye(8), x[:5, :5] @ x[:5, :5].T),
        "low rank": x[:, :3] @ x[:, :3].T, "graded": (q * 10.0 ** -np.arange(40)) @ q.T, "one": np.array([[7.0]]), "two": np.array([[2.0, 1.0], [1.0, 2.0]]), "diagonal": np.diag(np.arange(40.0)),
    }[kind]
    a = (a + a.T) / 2
    k = min(32, len(a))
    check_pairs(a, *eigen.leading(a, k), k)


def plain(rows, k=32):
    """vec_id -> (deviation, whitened up to signs), and values by numpy alone."""
    kept = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([v for _, v in kept])
    n, sums = len(x), [sum(c) for c in x.T.tolist()]
    y = x - np.array([s / n for s in sums])
    cov = y.T @ y / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x.tolist()]
    return [i for i, _ in kept], deviation, y @ vectors / np.sqrt(values), values / np.trace(cov)


def compare(df, rows, k):
    ids, deviation, white, explained = plain(rows, k)
    got = df.collect()
    assert len(got) == len(ids) * k
    by = {(r.vec_id, r.component): r for r in got}
    for c in range(k):
        have = np.array([by[i, c + 1].whitened for i in ids])
        assert min(np.abs(have - white[:, c]).max(), np.abs(have + white[:, c]).max()) < 1e-6
        assert abs(by[ids[0], c + 1].explained / explained[c] - 1) < 1e-9
    assert all(by[i, 1].deviation == d and by[i, 1].n == len(ids) for i, d in zip(ids, deviation))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_whitening(spark):
    rnd = np.random.default_rng(7)
    rows = [(i, [float(c) for c in rnd.normal(0, 1 + np.arange(6))]) for i in range(200)]
    rows += [(200, None), (201, []), (202, [1.0] * 5 + [None]), (203, [1.0] * 5 + [math.nan]), (204, [math.inf] + [0.0] * 5)]
    df = spark.createDataFrame([(i, v, i, v) for i, v in rows], "vec_id long, embedding array<double>, component int, vector array<double>").repartition(5)
    compare(whiten(df), rows, 6)
    compare(whiten(df, components=2), rows, 2)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    compare(op11_embedding_whitening(spark, sf), rows, 32)


def test_odd_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten(spark.createDataFrame([], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).count() == 0  # they agree everywhere
    # a line in three dimensions has one component; ids repeat, are null, and another length is left out
    line = [(None, [0.0, 0.0, 0.0]), (1, [1.0, 2.0, 0.0]), (1, [1.0, 2.0, 0.0]), (2, [2.0, 4.0, 0.0]), (3, [5.0])]
    got = whiten(spark.createDataFrame(line, schema)).collect()
    assert [(r.vec_id, r.component, r.n) for r in sorted(got, key=lambda r: (r.vec_id is not None, r.vec_id))] == [(None, 1, 4), (1, 1, 4), (1, 1, 4), (2, 1, 4)]
    assert abs(got[0].explained - 1) < 1e-12
    # entries far beyond what 64-bit numbers hold end no job
    got = whiten(spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 0.0]), (3, [0.0, 1.0])], schema)).collect()
    assert {(r.vec_id, r.deviation) for r in got} == {(1, None), (2, None), (3, 128 * 128)}


def test_deviation_is_exact():
    x = np.array([[1_000_000, 3], [1_000_005, -7], [4, 2_000_000_000]])
    model = Whitening(3, [int(v) for v in x.sum(axis=0)], np.zeros(0), np.zeros((0, 2)), 0.0)
    assert model.deviation(x[:2]) == [sum((3 * int(v) - s) ** 2 for v, s in zip(row, model.sums)) for row in x[:2]]
    # a vector beyond 64 bits doesn't change the others
    assert model.deviation(x[[0, 2]] * np.array([[1], [1]]))[0] == model.deviation(x[:1])[0]
