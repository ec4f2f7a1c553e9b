"""Whitening of embeddings by a one-sided Jacobi SVD of a blockwise QR factor.

Components become whole numbers, so sums over all rows are exact. Rows are centred and, block by block, folded into an
upper triangular R for each task (TSQR); the factors are merged in a tree of fixed fan-in until one is left, of the
dimension's square. Plane rotations then make R's columns orthogonal: their norms are the singular values, accurate
also where they are small, and the rotations' product holds the components. The covariance matrix is never formed, so
no digits are lost to squaring. The driver holds R, of the size of the model, and nothing that grows with the rows.

Defined cases: rows with a null vector, or a null or non-finite component, are dropped, and those without an id are
kept (vec_id null); a shorter vector counts as zero in its missing dimensions; repeated and equal rows each count;
components of no variance (also of a table of one row, or of vectors of no dimension) have null in ``whitened`` and
take no part in ``identity_error``; ``explained`` is null if nothing varies; an empty table has no rows; extra columns
are ignored. Components over 2**40 in size are an error, as sums of them would not be exact, and so is a deviation
beyond 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.llm.common import bounded_batches, own_columns

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Factors merged at once, and the greatest size of a scaled component.
FAN_IN, MOST = 16, 1 << 40
#: Columns whose cosine is under this are orthogonal; singular values under it, against the first, are zero.
PRECISION = 1e-15
SWEEPS = 60


@dataclass
class Whitening:
    """n and sums of the fit list, unit components as columns, and their standard deviations, by falling size."""

    n: int
    sums: list[int]
    components: np.ndarray
    deviations: np.ndarray
    identity_error: float | None = None

    def explained(self) -> list[float | None]:
        total = float((self.deviations**2).sum())
        return [float(s * s) / total if total else None for s in self.deviations]

    def live(self) -> np.ndarray:
        """Components that vary."""
        return self.deviations > len(self.deviations) * PRECISION * self.deviations.max(initial=0.0)


def usable(vectors: DataFrame) -> DataFrame:
    ok = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return own_columns(vectors, "vec_id", "embedding").where(F.coalesce(ok, F.lit(False)))


def _whole(vectors: pa.Array, dimension: int, scale: int, shift: int) -> np.ndarray:
    """Rows of whole numbers; missing dimensions are zero before the shift."""
    sizes = np.diff(vectors.offsets.to_numpy())
    values = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if np.abs(values).max(initial=0.0) > MOST:
        raise ValueError(f"components beyond {MOST // scale} cannot be summed exactly")
    out = np.zeros((len(sizes), max(dimension, int(sizes.max(initial=0)))), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values.astype(np.int64)
    return out + shift


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x less the mean, with one rounding alone."""
    if n * int(np.abs(x).max(initial=0)) < 1 << 62:
        return (n * x - sums) / n
    return np.array([[float(a) for a in r] for r in (x.astype(object) * n - sums.astype(object)) / n]).reshape(x.shape)


def _sums(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows, and per dimension the sum before the shift."""
        n, total = 0, np.zeros(0, object)
        for batch in batches:
            x = _whole(batch.column("embedding"), 0, scale, 0)
            n += len(x)
            wide = np.zeros(max(len(total), x.shape[1]), object)
            wide[: len(total)] = total
            wide[: x.shape[1]] += x.sum(axis=0).astype(object)
            total = wide
        yield pa.record_batch([pa.array([-1, *range(len(total))], pa.int32()), pa.array([str(n), *map(str, total)], pa.string())], names=["dimension", "total"])

    return run


def _factor(rows: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The square triangular factor of rows under an earlier one."""
    d = before.shape[1]
    r = np.linalg.qr(np.vstack([before, rows]), mode="r")
    out = np.zeros((d, d))
    out[: len(r)] = r[:d]
    return out


def _rows_of(part: int, factor: np.ndarray) -> pa.RecordBatch:
    d = len(factor)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(d + 1, dtype=np.int32) * d), pa.array(factor.ravel()))
    return pa.record_batch([pa.array([part] * d, pa.int32()), pa.array(range(d), pa.int32()), lists], names=["part", "line", "entries"])


def _blocks(model: Whitening, scale: int, shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, factor, part = np.array(model.sums, object), np.zeros((0, len(model.sums))), 0
        for batch in batches:
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
                factor = _factor(_centred(_whole(batch.column("embedding"), len(sums), scale, shift), model.n, _narrow(sums)), factor)
        if len(factor):
            yield _rows_of(part, factor)

    return run


def _narrow(sums: np.ndarray) -> np.ndarray:
    return sums.astype(np.int64) if all(abs(s) < 1 << 62 for s in sums) else sums


def _merge(table: pa.Table) -> pa.Table:
    """One factor of several, in the order of their parts, so that a retry gives the same digits."""
    table = table.sort_by([("part", "ascending"), ("line", "ascending")])
    rows = np.array(table.column("entries").to_pylist(), np.float64)
    return pa.Table.from_batches([_rows_of(table.column("part")[0].as_py() // FAN_IN, _factor(rows, np.zeros((0, rows.shape[1]))))])


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of a square matrix by falling size, and the right singular vectors as columns.

    One-sided: in each round disjoint pairs of columns are rotated until all are orthogonal; rotations accumulate in v.
    """
    d = r.shape[1]
    u, v = r.astype(np.float64).copy(), np.eye(d)
    even = d + d % 2
    for _ in range(SWEEPS):
        turned = False
        ring = list(range(even))
        for _ in range(even - 1):
            pairs = [(a, b) if a < b else (b, a) for a, b in zip(ring[: even // 2], reversed(ring[even // 2 :])) if max(a, b) < d]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            if not pairs:
                continue
            p, q = np.array(pairs).T
            left, right = u[:, p], u[:, q]
            alpha, beta, gamma = (left**2).sum(axis=0), (right**2).sum(axis=0), (left * right).sum(axis=0)
            turn = np.abs(gamma) > PRECISION * np.sqrt(alpha * beta)
            if not turn.any():
                continue
            turned = True
            p, q, alpha, beta, gamma = p[turn], q[turn], alpha[turn], beta[turn], gamma[turn]
            zeta = (beta - alpha) / (2 * gamma)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            for m in (u, v):
                left, right = m[:, p].copy(), m[:, q].copy()
                m[:, p], m[:, q] = c * left - s * right, s * left + c * right
        if not turned:
            break
    size = np.sqrt((u**2).sum(axis=0))
    order = np.argsort(-size, kind="stable")
    return size[order], v[:, order] / np.sqrt((v[:, order] ** 2).sum(axis=0))


def fit(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT, components: int = COMPONENTS) -> Whitening | None:
    """The model of all usable rows, or None if there are none."""
    bounded_batches(vectors.sparkSession)
    rows = usable(vectors)
    found = rows.select("embedding").mapInArrow(_sums(scale), "dimension int, total string").groupBy("dimension").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    totals = {r["dimension"]: int(r["total"]) for r in found}
    n, d = totals.pop(-1, 0), len(totals)
    if n == 0:
        return None
    model = Whitening(n, [totals[i] + n * shift for i in range(d)], np.zeros((d, 0)), np.zeros(0))
    factors = rows.select("embedding", F.spark_partition_id().alias("part")).mapInArrow(_blocks(model, scale, shift), "part int, line int, entries array<double>")
    # A tree of merges: the number of scan tasks alone sets its depth.
    left = rows.rdd.getNumPartitions()
    while left > 1:
        factors = factors.groupBy((F.col("part") / FAN_IN).cast("int").alias("parent")).applyInArrow(_merge, "part int, line int, entries array<double>")
        left = -(-left // FAN_IN)
    lines = {r["line"]: r["entries"] for r in factors.collect()}
    r = np.array([lines[i] for i in range(len(lines))]).reshape(len(lines), d)
    size, model.components = jacobi(r if len(r) else np.zeros((d, d)))
    model.deviations = size / np.sqrt(n)
    model.identity_error = _identity_error(rows, model, scale, shift, components)
    return model


def _projected(model: Whitening, x: np.ndarray, components: int) -> np.ndarray:
    """Whitened coordinates in the components that vary; the others are NaN."""
    live = np.flatnonzero(model.live()[:components])
    out = np.full((len(x), min(components, len(model.sums))), np.nan)
    out[:, live] = _centred(x, model.n, _narrow(np.array(model.sums, object))) @ (model.components[:, live] / model.deviations[live])
    return out


def _moments(model: Whitening, components: int, scale: int, shift: int):
    """Sums of the whitened coordinates and of their products, of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = min(components, len(model.sums))
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = _projected(model, _whole(batch.column("embedding"), len(model.sums), scale, shift), components)
            first, second = first + w.sum(axis=0), second + w.T @ w
        yield pa.record_batch([pa.array(range(k + k * k), pa.int32()), pa.array(np.concatenate([first, second.ravel()]))], names=["entry", "value"])

    return run


def _identity_error(rows: DataFrame, model: Whitening, scale: int, shift: int, components: int) -> float | None:
    """Largest entry of the whitened rows' covariance less the identity, measured over all rows."""
    live = model.live()[:components]
    k = len(live)
    if not live.any():
        return None
    sums = rows.select("embedding").mapInArrow(_moments(model, components, scale, shift), "entry int, value double").groupBy("entry").agg(F.sum("value").alias("value")).collect()
    flat = np.zeros(k + k * k)
    for r in sums:
        flat[r["entry"]] = r["value"]
    mean, second = flat[:k][live] / model.n, flat[k:].reshape(k, k)[np.ix_(live, live)] / model.n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(int(live.sum()))).max())


def transform(vectors: DataFrame, model: Whitening, scale: int = SCALE, shift: int = SHIFT, components: int = COMPONENTS) -> DataFrame:
    """vec_id, whitened (array<double>, null where a component does not vary) and deviation of each usable row."""
    sums = np.array(model.sums, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _whole(batch.column("embedding"), len(sums), scale, shift)
            w = _projected(model, x, components)
            k = w.shape[1]
            flat = pa.array(w.ravel(), from_pandas=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), flat)
            yield pa.record_batch([batch.column("vec_id"), lists, pa.array(_deviation(x, model.n, sums), pa.int64())], names=["vec_id", "whitened", "deviation"])

    return usable(vectors).mapInArrow(run, "vec_id long, whitened array<double>, deviation long")


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """Sum over dimensions of (n * x - sum) ** 2, exact."""
    if n * int(np.abs(x).max(initial=0)) < 1 << 62 and all(abs(s) < 1 << 62 for s in sums):
        off = n * x - sums.astype(np.int64)
        if (np.abs(off).max(initial=0).astype(float) ** 2) * max(x.shape[1], 1) < 2.0**62:
            return (off**2).sum(axis=1).tolist()
    return [int(v) for v in ((x.astype(object) * n - sums) ** 2).sum(axis=1)]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row for each usable row and component: the columns of the query contract."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(vectors, components=components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    shares = F.array(*[F.lit(e).cast("double") for e in model.explained()[:components]])
    rows = transform(vectors, model, components=components).select("*", F.posexplode("whitened").alias("at", "value"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("value").alias("whitened"), F.get(shares, F.col("at")).alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"))
