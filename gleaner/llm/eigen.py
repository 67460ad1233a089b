"""The leading eigenvalues and eigenvectors of a symmetric matrix: Householder tridiagonalisation, Sturm
counts and bisection for the values, inverse iteration with reorthogonalisation of clusters for the
vectors. The matrix is a covariance of a few hundred columns; what is summed over rows happens in Spark.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


def tridiagonalise(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and reflectors (unit vectors as rows, zero where none was needed) with
    T = H(d-3) ... H(0) A H(0) ... H(d-3), where H(k) = I - 2 v v' for the k-th reflector v."""
    a = np.array(matrix, float)
    n = len(a)
    reflectors = np.zeros((max(n - 2, 0), n))
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        rest = np.linalg.norm(x[1:])
        if rest == 0:
            continue
        x[0] += np.copysign(np.hypot(x[0], rest), x[0])
        v = reflectors[k]
        v[k + 1 :] = x / np.linalg.norm(x)
        p = a @ v
        w = 2 * (p - (v @ p) * v)
        a -= np.outer(v, w) + np.outer(w, v)
    return np.diag(a).copy(), np.diag(a, -1).copy() if n > 1 else np.zeros(0), reflectors


def values_below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each number in ``at``, how many eigenvalues of the tridiagonal matrix lie below it: the negative
    terms of its Sturm sequence."""
    small = EPS * max(np.abs(diagonal).max(initial=0), np.abs(off).max(initial=0), np.finfo(float).tiny)
    q, count = np.full(len(at), np.inf), np.zeros(len(at), int)
    for d, e in zip(diagonal, np.r_[0.0, off]):
        q = d - at - e * e / q
        q = np.where(np.abs(q) < small, -small, q)
        count += q < 0
    return count


def largest_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection of all intervals at once."""
    n = len(diagonal)
    radius = np.zeros(n)
    radius[:-1] += np.abs(off)
    radius[1:] += np.abs(off)
    low, high = np.full(k, (diagonal - radius).min()), np.full(k, (diagonal + radius).max())
    pad = EPS * n * max(np.abs(low).max(), np.abs(high).max()) + np.finfo(float).tiny
    low, high = low - pad, high + pad
    wanted = n - 1 - np.arange(k)  # so many values are smaller
    for _ in range(200):
        middle = (low + high) / 2
        if ((middle <= low) | (middle >= high)).all():
            break
        above = values_below(diagonal, off, middle) <= wanted
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return (low + high) / 2


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """x with (T - shift) x = right, by elimination with row exchanges; pivots of under ``least`` become that."""
    n = len(diagonal)
    main, upper, upper2, b = diagonal - shift, np.r_[off, 0.0], np.zeros(n), right.copy()
    for i in range(n - 1):
        below = off[i]
        if abs(main[i]) >= abs(below):
            if abs(main[i]) < least:
                main[i] = least
            factor = below / main[i]
            main[i + 1] -= factor * upper[i]
            b[i + 1] -= factor * b[i]
        else:
            factor = main[i] / below
            main[i], upper[i], main[i + 1] = below, main[i + 1], upper[i] - factor * main[i + 1]
            if i + 2 < n:
                upper2[i], upper[i + 1] = upper[i + 1], -factor * upper[i + 1]
            b[i], b[i + 1] = b[i + 1], b[i] - factor * b[i + 1]
    if abs(main[-1]) < least:
        main[-1] = least
    for i in range(n - 1, -1, -1):
        later = (upper[i] * b[i + 1] if i + 1 < n else 0.0) + (upper2[i] * b[i + 2] if i + 2 < n else 0.0)
        b[i] = (b[i] - later) / main[i]
    return b


def vectors_of(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A unit eigenvector (a row) for each of the falling values; those of values close to one another are
    made orthogonal to each other."""
    n = len(diagonal)
    norm = max(np.abs(diagonal).max(initial=0), np.abs(off).max(initial=0), np.finfo(float).tiny)
    random = np.random.default_rng(11)
    out, cluster, shift = np.zeros((len(values), n)), 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * norm:
            cluster = j
        # equal values are told apart by a few units in the last place
        shift = value if j == cluster else min(value, shift - 4 * EPS * norm)
        x = random.standard_normal(n)
        for _ in range(5):
            x = _solve(diagonal, off, shift, x / np.linalg.norm(x), EPS * norm)
            for _ in range(2):
                near = out[cluster:j]
                x -= near.T @ (near @ x)
            x /= np.linalg.norm(x)
            residue = diagonal * x - value * x
            residue[:-1] += off * x[1:]
            residue[1:] += off * x[:-1]
            if np.abs(residue).max() <= 4 * EPS * norm:
                break
        out[j] = x
    return out


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and a unit eigenvector (a row) for each."""
    scale = np.abs(matrix).max(initial=0)
    if scale == 0:
        return np.zeros(min(k, len(matrix))), np.eye(len(matrix))[:k]
    diagonal, off, reflectors = tridiagonalise(matrix / scale)
    values = largest_values(diagonal, off, min(k, len(diagonal)))
    vectors = vectors_of(diagonal, off, values)
    for v in reflectors[::-1]:
        vectors -= np.outer(2 * (vectors @ v), v)
    return values * scale, vectors
