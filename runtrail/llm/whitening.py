"""Embedding whitening: exact integer sums, a distributed centred scatter, cyclic Jacobi on the driver, a broadcast projection.

An entry c becomes the integer ``floor(1024 * c) + 100000``. Sums S are exact; a deviation from the mean is the integer
``n * x - S`` over n, so that nothing is lost before products are taken. Each task adds its own scatter matrix, Spark adds those
by cell, and only the matrix (its side is the dimension, bounded by ``MAX_DIM``) reaches the driver. There symmetric Jacobi
rotations, swept in rounds of disjoint pairs, go on until no off-diagonal cell counts against its diagonal, which keeps small
eigenvalues accurate.

Defined results: rows whose vector is null, empty or holds null or non-finite entries go, as do those of another length than the
most common one (of equally common ones the longer). Repeated rows count as often as they stand. Entries beyond 2^42 are taken as
2^42. A component without variance has whitened and explained values of 0 and does not count in identity_error. A deviation
beyond a long is null. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged

SCALE, SHIFT = 1024.0, 100_000
MAX_DIM = 1024
#: Cells of vectors that a Python worker holds as numbers at once.
SLAB_CELLS = 1 << 20


@dataclass(frozen=True)
class Whitening:
    """``n`` rows of the fit list with sums ``sums``; ``axes`` (dimension x components) are divided by the root of ``eigenvalues``."""

    n: int
    sums: tuple[int, ...]
    eigenvalues: tuple[float, ...]
    explained: tuple[float, ...]
    axes: np.ndarray


def usable(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Rows whose vector has entries, all of them finite."""
    fine = F.forall(vec_col, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return df.where(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & fine)


def slabs(column: pa.Array, dim: int | None) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, last row, integers of shape rows x length) of runs of rows of one length, in bounded pieces."""
    column = column.cast(pa.list_(pa.float64())) if column.type != pa.list_(pa.float64()) else column
    lengths, values = np.diff(column.offsets.to_numpy()), column.values
    start = column.offsets[0].as_py() if len(column) else 0
    edges = np.flatnonzero(np.diff(lengths)) + 1
    for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(lengths)]):
        if lo == hi or (dim is not None and lengths[lo] != dim):
            start += int(lengths[lo:hi].sum())
            continue
        d = int(lengths[lo])
        step = max(1, SLAB_CELLS // d)
        for a in range(lo, hi, step):
            b = min(hi, a + step)
            cells = values.slice(start, (b - a) * d).to_numpy(zero_copy_only=False).reshape(b - a, d)
            yield a, b, np.floor(np.clip(cells * SCALE, -(2.0**52), 2.0**52)).astype(np.int64) + SHIFT
            start += (b - a) * d


def sums_of(df: DataFrame, vec_col: str) -> tuple[int, tuple[int, ...]]:
    """(rows, exact sums by dimension) of the most common length; (0, ()) if there are no rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        totals: dict[int, list[int]] = {}
        for batch in batches:
            for lo, hi, x in slabs(batch.column(0), None):
                d = x.shape[1]
                part = x.astype(object).sum(axis=0).tolist() if np.abs(x).max() > 2**40 else x.sum(axis=0).tolist()
                counts[d] = counts.get(d, 0) + hi - lo
                totals[d] = [a + b for a, b in zip(totals[d], part)] if d in totals else part
        for d, n in counts.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([str(s) for s in totals[d]])], names=["dim", "at", "n", "total"]
            )

    made = staged(df.select(vec_col).mapInArrow(add, "dim int, at int, n long, total string"), "vector-sums")
    common = made.where("at = 0").groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if common is None:
        return 0, ()
    if common["dim"] > MAX_DIM:
        raise ValueError(f"vectors of {common['dim']} entries: the driver's matrix is bounded by {MAX_DIM}")
    rows = made.where(F.col("dim") == common["dim"]).groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("s")).orderBy("at").collect()
    return int(common["n"]), tuple(int(r["s"]) for r in rows)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """The integers n * x - S: 64 bits wide where they fit, else Python's own."""
    room = max(int(np.abs(x).max(initial=0)) * n, max((abs(int(s)) for s in sums), default=0))
    return x * np.int64(n) - sums.astype(np.int64) if room < 2**61 else x.astype(object) * n - sums


def matrix_sum(df: DataFrame, vec_col: str, dim: int, side: int, product, label: str) -> np.ndarray:
    """The sum over all rows of a symmetric matrix that ``product(integers)`` gives for a slab."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, _, x in slabs(batch.column(0), dim):
                part = product(x)
                total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(side)
            yield pa.RecordBatch.from_arrays([pa.array(i * side + j, pa.int64()), pa.array(total[i, j])], names=["cell", "v"])

    cells = df.select(vec_col).mapInArrow(add, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v"))
    full = np.zeros((side, side))
    for row in cells.toLocalIterator():
        i, j = divmod(row["cell"], side)
        full[i, j] = full[j, i] = row["v"]
    return full


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix by cyclic Jacobi.

    A sweep visits every pair once, in rounds of disjoint pairs (a round-robin), so that a round's rotations are one numpy step.
    It ends when every off-diagonal cell is below double precision against the geometric mean of its two diagonal cells.
    """
    a, d = np.array(matrix, dtype=np.float64), len(matrix)
    vectors = np.eye(d)
    eps = np.finfo(np.float64).eps
    ring = list(range(d + d % 2))
    for _ in range(sweeps):
        turned = False
        for _ in range(len(ring) - 1):
            pairs = [(min(p), max(p)) for p in zip(ring[: len(ring) // 2], reversed(ring[len(ring) // 2 :])) if max(p) < d]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            p, q = np.array(pairs, dtype=np.int64).reshape(-1, 2).T
            off = a[p, q]
            need = np.abs(off) > eps * np.sqrt(np.abs(a[p, p] * a[q, q])) + np.finfo(np.float64).tiny
            if not need.any():
                continue
            turned, p, q, off = True, p[need], q[need], off[need]
            theta = (a[q, q] - a[p, p]) / (2.0 * off)
            t = np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.hypot(1.0, theta))
            c = 1.0 / np.hypot(1.0, t)
            s = t * c
            left, right = a[p], a[q]
            a[p], a[q] = c[:, None] * left - s[:, None] * right, s[:, None] * left + c[:, None] * right
            left, right = a[:, p], a[:, q]
            a[:, p], a[:, q] = c * left - s * right, s * left + c * right
            a[p, q] = a[q, p] = 0.0
            left, right = vectors[:, p], vectors[:, q]
            vectors[:, p], vectors[:, q] = c * left - s * right, s * left + c * right
        if not turned:
            break
    else:
        raise RuntimeError(f"Jacobi did not settle in {sweeps} sweeps")
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], vectors[:, order]


def fit(df: DataFrame, vec_col: str = "embedding", components: int = 8) -> Whitening:
    """Whitening by all usable rows of ``df``: covariance with divisor n, components by falling eigenvalue.

    Of either sign of a component the one whose largest entry is positive is taken, so that reruns agree.
    """
    rows = usable(df, vec_col)
    n, sums = sums_of(rows, vec_col)
    d = len(sums)
    if not n:
        return Whitening(0, (), (), (), np.zeros((0, 0)))
    exact = np.array(sums, dtype=object)

    def scatter(x: np.ndarray) -> np.ndarray:
        y = deviations(x, n, exact).astype(np.float64) / n
        return y.T @ y

    covariance = matrix_sum(rows, vec_col, d, d, scatter, "scatter") / n
    values, vectors = jacobi(covariance)
    trace, k = float(np.trace(covariance)), min(components, d)
    values, vectors = values[:k], vectors[:, :k]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    real = values > trace * d * np.finfo(np.float64).eps
    roots = np.sqrt(np.where(real, values, 1.0))
    return Whitening(n, sums, tuple(np.where(real, values, 0.0).tolist()), tuple((np.where(real, values, 0.0) / trace if trace > 0 else np.zeros(k)).tolist()), np.where(real, vectors / roots, 0.0))


def projected(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """(integer deviations, whitened values) of a slab."""
    y = deviations(x, model.n, np.array(model.sums, dtype=object))
    return y, (y.astype(np.float64) / model.n) @ model.axes


def identity_error(df: DataFrame, model: Whitening, vec_col: str = "embedding") -> float:
    """Largest entry of the covariance of the whitened rows, as measured over all of them, less the identity."""
    if not model.n:
        return 0.0
    k = model.axes.shape[1]

    def product(x: np.ndarray) -> np.ndarray:
        w = projected(x, model)[1]
        return w.T @ w

    seen = matrix_sum(usable(df, vec_col), vec_col, len(model.sums), k, product, "whitened") / model.n
    real = np.array(model.eigenvalues) > 0
    return float(np.abs(seen - np.diag(real.astype(np.float64))).max()) if k else 0.0


def whitened(df: DataFrame, model: Whitening, vec_col: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """Usable rows of the model's dimension with ``deviation`` (long) and ``whitened`` (array of doubles, one per component).

    ``keep`` (default: all columns) names what is passed through; outputs replace columns of the same name.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("deviation", "whitened")]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = m.axes.shape[1]
        for batch in batches:
            for lo, hi, x in slabs(batch.column(batch.schema.get_field_index(vec_col)), len(m.sums)):
                y, w = projected(x, m)
                wide = y.dtype == object or (len(y) and int(np.abs(y).max()) ** 2 * y.shape[1] >= 2**63)
                squares = [v if v < 2**63 else None for v in ((y.astype(object) ** 2).sum(axis=1) if wide else (y * y).sum(axis=1)).tolist()]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo + 1) * k, k), pa.int32()) if k else pa.array([0] * (hi - lo + 1), pa.int32()), pa.array(w.reshape(-1)))
                kept = [batch.column(batch.schema.get_field_index(c)).slice(lo, hi - lo) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(squares, pa.int64()), lists], names=[*keep, "deviation", "whitened"])

    return usable(df, vec_col).select(*{c: None for c in [*keep, vec_col]}).mapInArrow(run, schema)


def whitening_digest(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 8) -> DataFrame:
    """Row and component: whitened value, with the exact squared deviation, the component's share and the one identity error."""
    model = fit(df, vec_col, components)
    rows = whitened(df, model, vec_col, [id_col])
    error = identity_error(df, model, vec_col)
    shares = F.array(*[F.lit(e) for e in model.explained]) if model.explained else F.array().cast("array<double>")
    each = rows.select(id_col, "deviation", F.posexplode("whitened").alias("at", "w"))
    return each.select(id_col, (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("w").alias("whitened"), F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
