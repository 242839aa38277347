"""Embedding whitening: a randomised range finder over all centred rows, Rayleigh-Ritz for the components.

Entries become whole numbers (``SCALE`` times the entry, rounded down, plus ``SHIFT``), so numbers of rows, sums and deviations
are exact. Each distinct vector counts once: vectors are compared as bytes, combined in tasks before the shuffle, and the fit
list is written to the shared folder. Every pass over it is one Spark job: a task multiplies its centred rows with a small
basis in numpy and returns one row for each dimension, which tasks add up by dimension after a shuffle, so the driver receives one matrix of
dimensions times basis, whatever the number of rows or tasks.

The basis starts as ``wanted + oversampling`` random directions. A pass gives V Q for the basis Q; Rayleigh-Ritz on Q'VQ gives
components and their residuals |V c - e c|. While a residual is above ``tolerance`` times the largest eigenvalue, VQ is made
orthonormal and the pass repeated, ``passes`` times; after that, or where the basis has as many columns as there are dimensions,
the basis is the identity: V itself, in full. A last pass measures the covariance of the whitened fit list.

Defined cases: rows whose vector is null or holds nulls, NaN or infinities go; so do empty vectors, and vectors of another
length than the most frequent one (of two, the longer). Entries beyond 2 ** 46 in size are cut off there. Repeated rows and ids
give their rows each and count once in the fit list. Components with eigenvalues of ``RANK`` times the largest or less don't
exist; a table whose vectors are all equal, or an empty one, gives no rows. A deviation beyond a long is null. Extra columns
are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomotif.llm.common import dropped, ship, tidy, written

SCALE, SHIFT = 64.0, 1_000_000
LARGEST = 1 << 46
RANK = 1e-12
#: Values that a task multiplies at once.
BLOCK = 1 << 21


def whole(entries: np.ndarray) -> np.ndarray:
    """Entries as whole numbers."""
    return np.floor(np.clip(np.asarray(entries, np.float64) * SCALE, -LARGEST, LARGEST)).astype(np.int64) + SHIFT


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entries as doubles, start and length of each row); rows with a null in them have length 0."""
    offsets = np.asarray(column.offsets, np.int64)
    lengths = np.diff(offsets)
    values = column.values
    bad = np.zeros(len(column), bool)
    if column.null_count:
        bad |= np.asarray(column.is_null())
    entries = values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    wrong = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])
    bad |= wrong[offsets[1:]] > wrong[offsets[:-1]]
    return entries, offsets[:-1], np.where(bad, 0, lengths)


def clean(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, x): the whole-number vectors of usable rows as bytes of longs."""
    id_type = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries, starts, lengths = _lists(batch.column(1))
            some = np.flatnonzero(lengths)
            x = [whole(entries[a : a + n]).tobytes() for a, n in zip(starts[some].tolist(), lengths[some].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.array(x, pa.binary())], names=["id", "x"])

    out = rows.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL").mapInArrow(tidy(run), f"id {id_type}, x binary")
    lengths = out.groupBy(F.octet_length("x").alias("bytes")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("bytes")).first()
    return out.where(F.octet_length("x") == (lengths["bytes"] if lengths else 0))


def _blocks(batches: Iterator[pa.RecordBatch], column: int, d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches with their vectors as a matrix of longs."""
    step = max(1, BLOCK // d)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            piece = batch.slice(at, step)
            yield piece, np.frombuffer(b"".join(piece.column(column).to_pylist()), np.int64).reshape(-1, d)


def _summed(fit: DataFrame, d: int, of: Callable[[np.ndarray], np.ndarray], rows: int, exact: bool = False) -> np.ndarray:
    """The sum over all tasks of ``of(block)``, a matrix with ``rows`` rows: Spark adds the rows up by their place."""
    kind = np.int64 if exact else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches, 0, d):
            part = of(x)
            total = part if total is None else total + part
        if total is not None:
            total = np.asarray(total, kind)
            yield pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int32()), pa.array([v.tobytes() for v in total], pa.binary())], names=["row", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(v, kind)
                sums[row] = sums[row] + part if row in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["row", "v"])

    parts = fit.select("x").mapInArrow(tidy(run), "row int, v binary").repartition("row")
    got = {r["row"]: np.frombuffer(bytes(r["v"]), kind) for r in parts.mapInArrow(tidy(add), "row int, v binary").collect()}  # the rows of one small matrix
    return np.stack([got[k] for k in range(rows)])


class Whitening:
    """A fitted transformation: ``components`` (k, d) by falling eigenvalue, ``n`` fit vectors, their sums ``s``."""

    def __init__(self, n: int, s: np.ndarray, values: np.ndarray, components: np.ndarray, trace: float):
        self.n, self.s, self.values, self.components, self.trace = n, s, values, components, trace
        self.identity_error = 0.0
        self.full = False
        self.passes = 0

    @property
    def _base(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as whole part and remainder, so that x minus the whole part is exact."""
        return self.s // self.n, self.s % self.n

    def centred(self, x: np.ndarray) -> np.ndarray:
        base, rest = self._base
        return (x - base).astype(np.float64) - rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """(rows, k) projections over the square roots of the eigenvalues."""
        return self.centred(x) @ (self.components / np.sqrt(self.values)[:, None]).T

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of (n * x - s) ** 2 of each row."""
        base, rest = self._base
        y = x - base
        most = int(np.abs(y).max(initial=0)) * self.n + self.n
        if most * most * len(self.s) < 1 << 63:
            z = y * self.n - rest
            return (z * z).sum(1).tolist()
        z = y.astype(object) * self.n - rest.astype(object)
        return [v if v < 1 << 63 else None for v in (z * z).sum(1).tolist()]


def ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit vectors as rows, residuals) of V on the basis q, from V q."""
    b = q.T @ vq
    values, y = np.linalg.eigh((b + b.T) / 2)
    values, y = values[::-1], y[:, ::-1]
    vectors = q @ y
    return values, vectors.T, np.linalg.norm(vq @ y - vectors * values, axis=0)


def fit(vectors: DataFrame, wanted: int = 16, oversampling: int = 10, passes: int = 4, tolerance: float = 1e-10, seed: int = 11) -> Whitening | None:
    """Fits on the distinct vectors of (x), which ``clean`` made, all of one length. None without a component."""
    table = written(vectors.select("x").distinct(), "fit-list")
    head = table.agg(F.count("*"), F.max(F.octet_length("x"))).first()
    n, d = head[0], (head[1] or 0) // 8
    if not n:
        dropped(table)
        return None
    s = _summed(table, d, lambda x: x.sum(0)[:, None], d, exact=True)[:, 0]
    model = Whitening(n, s, np.empty(0), np.empty((0, d)), 0.0)
    trace = float(_summed(table, d, lambda x: (model.centred(x) ** 2).sum(0)[:, None], d).sum()) / n

    def times(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = model.centred(x)
            return c.T @ (c @ q)

        return _summed(table, d, part, d) / n

    width = min(d, wanted + oversampling)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0] if width < d else np.eye(d)
    for k in range(passes + 1):
        if k == passes:
            q = np.eye(d)
        values, components, residuals = ritz(q, vq := times(q))
        model.full, model.passes = q.shape[1] == d, k + 1
        if model.full or (residuals[:wanted] <= tolerance * max(values[0], 0)).all():
            break
        q = np.linalg.qr(vq)[0]
    some = [k for k in range(min(wanted, len(values))) if values[k] > RANK * max(values[0], 0) and values[k] > 0]
    if trace > 0 and some:
        model.values, model.components, model.trace = values[some], components[some], trace

        def products(x: np.ndarray) -> np.ndarray:
            w = model.whitened(x)
            return np.vstack([w.T @ w, w.sum(0, keepdims=True)])

        got = _summed(table, d, products, len(some) + 1) / n
        model.identity_error = float(np.abs(got[:-1] - np.outer(got[-1], got[-1]) - np.eye(len(some))).max())
    dropped(table)
    return model if len(model.values) else None


def whiten(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", wanted: int = 16, **options) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each usable row and component."""
    spark = rows.sparkSession
    ship(spark)
    id_type = rows.schema[id_col].dataType.simpleString()
    usable = clean(rows, id_col, vector)
    model = fit(usable, wanted, **options)
    schema = f"id {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if model is None:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    k, d = len(model.values), len(model.s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, x in _blocks(batches, 1, d):
            m = len(x)
            repeated = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(0).take(pa.array(repeated)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n, np.int64)),
                    pa.array(model.deviation(x), pa.int64()).take(pa.array(repeated)), pa.array(model.whitened(x).reshape(-1)), pa.array(np.tile(model.values / model.trace, m)),
                    pa.array(np.full(m * k, model.identity_error)),
                ],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return usable.mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)
