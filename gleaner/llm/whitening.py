"""Whitening of embeddings by the eigenvectors of their covariance.

Three passes over the vectors sum numbers by task and then by cell: counts and sums of each length of
vector; the covariance, centred before anything is multiplied; and the covariance of the whitened
vectors, which shows how far it is from the identity. The driver sees no more than one matrix of
dimensions by dimensions, finds its leading eigenvectors (gleaner.llm.eigen) and broadcasts these, so
the last pass is a projection without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import in_parts
from gleaner.llm.eigen import EPS, leading

CELLS = "cell long, value double"
SUMS = "length int, cell int, total decimal(38,0)"
LONG = (1 << 63) - 1


def _vectors(batch: pa.RecordBatch, length: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By length of vector (or of one length alone): places in the batch of the vectors without null and
    non-finite entries, and their entries as whole numbers."""
    column = batch.column("vector")
    lengths = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    entries = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null becomes NaN
    for n in np.unique(lengths) if length is None else [length]:
        at = np.flatnonzero(lengths == n)
        if n and len(at):
            values = entries[offsets[at][:, None] + np.arange(n)]
            whole = np.isfinite(values).all(axis=1)
            # a 64-bit number holds no entry beyond this, which keeps its sign
            cells = np.clip(np.floor(64.0 * values[whole]), -(2.0**62), 2.0**62)
            yield at[whole], cells.astype(np.int64) + 1_000_000


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each length: how many vectors there are (cell -1) and the sums of their entries, exact."""
    total: dict[int, list[int]] = {}
    for batch in in_parts(batches, 4096):
        for _, x in _vectors(batch):
            if not len(x):
                continue
            high, low = x >> 31, x & 0x7FFFFFFF  # so that no sum of a part passes 64 bits
            got = [len(x), *((int(a) << 31) + int(b) for a, b in zip(high.sum(axis=0), low.sum(axis=0)))]
            have = total.setdefault(x.shape[1], [0] * len(got))
            for i, v in enumerate(got):
                have[i] += v
    for length, values in total.items():
        yield pa.record_batch([pa.array([length] * len(values), pa.int32()), pa.array(range(-1, length), pa.int32()), pa.array(values, pa.decimal128(38, 0))], ["length", "cell", "total"])


@dataclass
class Whitening:
    """What the vectors were found to be: how many (n), exact sums S by dimension, the eigenvalues and unit
    eigenvectors (rows) that are kept, and the trace of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def dimensions(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: whole parts are taken off before anything becomes a double."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole).astype(float) - rest

    def project(self, centred: np.ndarray) -> np.ndarray:
        return centred @ self.vectors.T / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n * x - S)^2 in whole numbers; None where a 64-bit number can't hold one."""
        about = ((self.n * self.centred(x)) ** 2).sum(axis=1)
        exact = [None] * len(x)
        if about.max(initial=0) < 2.0**62:
            d = self.n * (x - np.array([s // self.n for s in self.sums], np.int64)) - np.array([s % self.n for s in self.sums], np.int64)
            return (d * d).sum(axis=1).tolist()
        for i, row in enumerate(x.tolist()):
            if about[i] < 2.0**64:
                total = sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums))
                exact[i] = total if total <= LONG else None
        return exact


def _covariance(vectors: DataFrame, model: Whitening, transform) -> np.ndarray:
    """Of transform(centred entries), divisor n: every task sums products of its rows, then cells are summed."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total = shared.value, None
        for batch in in_parts(batches, 4096):
            for _, x in _vectors(batch, model.dimensions):
                y = transform(model, model.centred(x))
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            a, b = np.triu_indices(len(total))
            yield pa.record_batch([pa.array(a * len(total) + b, pa.int64()), pa.array(total[a, b])], ["cell", "value"])

    sums = vectors.mapInArrow(products, CELLS).groupBy("cell").agg(F.sum("value").alias("value")).collect()
    size = 1 + max((r["cell"] for r in sums), default=-1)
    d = int(round(size**0.5))
    out = np.zeros((d, d))
    for r in sums:
        a, b = divmod(r["cell"], d)
        out[a, b] = out[b, a] = r["value"] / model.n
    return out


def fit(vectors: DataFrame, components: int = 32) -> Whitening | None:
    """The model of a column ``vector``; None if there is no vector. Of several lengths, the one that most
    vectors have counts (of equals the longest), the other vectors are left out."""
    found: dict[int, dict[int, int]] = {}
    for r in vectors.mapInArrow(_sums, SUMS).groupBy("length", "cell").agg(F.sum("total").alias("total")).collect():
        found.setdefault(r["length"], {})[r["cell"]] = int(r["total"])
    if not found:
        return None
    length = max(found, key=lambda k: (found[k][-1], k))
    model = Whitening(found[length][-1], [found[length][i] for i in range(length)], np.zeros(0), np.zeros((0, length)), 0.0)
    covariance = _covariance(vectors, model, lambda model, y: y)
    values, directions = leading(covariance, min(components, length))
    model.trace = float(np.trace(covariance))
    kept = values > length * EPS * max(model.trace, 0.0)  # along the others all vectors agree
    model.values, model.vectors = values[kept], directions[kept]
    return model


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32) -> DataFrame:
    """A row for each vector and component, up to ``components``: vec_id, component (from 1, by falling
    eigenvalue), n, deviation, whitened, explained, identity_error.

    Entries c become whole numbers floor(64 * c) + 1000000. Rows whose vector is null, empty or has null or
    non-finite entries are left out, and so are vectors of another length than most. Components along
    which all vectors agree (eigenvalue 0 within rounding) don't exist: equal vectors alone, or one
    vector, give no rows. Repeated rows and ids, also null ones, each give their own rows. deviation is
    null where a 64-bit number can't hold it. Other columns are neither read nor returned.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    model = fit(vectors, components)
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema)
    error = float(np.abs(_covariance(vectors, model, lambda model, y: model.project(y)) - np.eye(len(model.values))).max())
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in in_parts(batches, 4096):
            for at, x in _vectors(batch, model.dimensions):
                white = model.project(model.centred(x))
                offsets = pa.array(np.arange(len(white) + 1) * white.shape[1], pa.int32())
                columns = [batch.column("vec_id").take(pa.array(at)), pa.array(model.deviation(x), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(white.ravel()))]
                yield pa.record_batch(columns, ["vec_id", "deviation", "whitened"])

    made = vectors.mapInArrow(projected, "vec_id long, deviation long, whitened array<double>")
    rows_ = made.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    explained = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    return rows_.select("vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("place")).alias("explained"), F.lit(error).alias("identity_error"))
