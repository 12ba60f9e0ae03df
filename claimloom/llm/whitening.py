"""Whitening of embeddings on their leading components, found by slicing the spectrum of their covariance.

The fit list is each distinct scaled vector once. Spark counts it, sums it and multiplies it, all exactly, in partial
sums per task; the driver gets one matrix of the vectors' dimension. There each leading eigenvalue is isolated by
inertia: the pivots of an LDL^T factorization of the covariance minus a shift tell how many eigenvalues lie
above the shift. Inside its interval Rayleigh quotient iteration converges (cubically), and the counts just below and above
the result certify its number. Eigenvalues that no shift can separate form a cluster, whose vectors are
made orthogonal in turn.

Defined results: rows that cannot be used (see ``vectors``) are left out; repeated rows are each returned and count once
in the fit; entries beyond +-2^40 after scaling are cut to that. A component without variance (fewer
distinct vectors than components, a constant dimension) has whitened null and does not enter identity_error; there are never
more components than dimensions. deviation is null beyond a long. An empty table gives no rows. Further columns, of any
name, stay in the struct ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.llm.common import checkpointed
from claimloom.llm.vectors import dimension, exact_products, numeric_vector, pack_ints, scaled, unpack_ints, usable_rows

#: Below this share of the trace an eigenvalue counts as no variance.
FLAT = 1e-13
#: Rows multiplied at once.
CHUNK = 8192


def eigenvalues_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix exceed ``shift``: the positive pivots of LDL^T of matrix - shift.

    Pivots are single or, where the diagonal is too small to divide by, two by two with one eigenvalue of either sign
    (Bunch and Kaufman's choice), which keeps the elimination stable for indefinite matrices.
    """
    rest = matrix - shift * np.eye(len(matrix))
    enough = (1 + 17**0.5) / 8
    above = 0
    while len(rest):
        size = len(rest)
        below = np.abs(rest[1:, 0])
        largest = below.max() if size > 1 else 0.0
        pair = False
        if abs(rest[0, 0]) < enough * largest:
            r = 1 + int(below.argmax())
            row = np.abs(rest[r])
            row[r] = 0.0
            across = row.max()
            if abs(rest[0, 0]) * across < enough * largest * largest:
                pair = abs(rest[r, r]) < enough * across
                swap = np.arange(size)
                to = 1 if pair else 0
                swap[[to, r]] = swap[[r, to]]
                rest = rest[np.ix_(swap, swap)]
        if pair:
            above += 1
            block, side = rest[:2, :2], rest[2:, :2]
            rest = rest[2:, 2:] - side @ np.linalg.solve(block, side.T)
        else:
            pivot = rest[0, 0]
            above += pivot > 0
            side = rest[1:, 0]
            rest = rest[1:, 1:] - (np.outer(side, side / pivot) if pivot else 0.0)
        rest = (rest + rest.T) / 2
    return int(above)


def _iterate(matrix: np.ndarray, start: float, against: np.ndarray) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration from a shift, orthogonal to the columns of ``against``."""
    size = len(matrix)
    clear = lambda x: x - against @ (against.T @ x)
    vector = clear(np.cos(1.0 + np.arange(size) ** 1.5))
    vector /= np.linalg.norm(vector)
    scale = np.abs(matrix).max()
    shift, eye = start, np.eye(size)
    for turn in range(60):
        try:
            ahead = np.linalg.solve(matrix - shift * eye, vector)
        except np.linalg.LinAlgError:
            ahead = np.linalg.solve(matrix - (shift + 4e-16 * scale) * eye, vector)
        ahead = clear(clear(ahead))
        norm = np.linalg.norm(ahead)
        if not np.isfinite(norm) or norm == 0:
            break
        ahead /= norm
        moved = min(np.linalg.norm(ahead - vector), np.linalg.norm(ahead + vector))
        vector = ahead
        if turn >= 2:  # two steps at the interval's middle turn the vector towards its eigenvector first
            shift = float(vector @ matrix @ vector)
        if turn >= 3 and moved < 1e-15 * size**0.5:
            break
    return float(vector @ matrix @ vector), vector


def leading_components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest eigenvalues, falling, and their unit eigenvectors as columns."""
    size = len(matrix)
    k = min(k, size)
    reach = float(np.abs(matrix).sum(axis=1).max())
    if reach == 0:
        return np.zeros(k), np.eye(size)[:, :k]
    least = 1e-14 * reach
    known = {reach * (1 + 1e-9) + least: 0, -reach * (1 + 1e-9) - least: size}

    def count(shift: float) -> int:
        if shift not in known:
            known[shift] = eigenvalues_above(matrix, shift)
        return known[shift]

    values, vectors = np.zeros(0), np.zeros((size, 0))
    while len(values) < k:
        number = len(values) + 1
        while True:
            low = max(s for s, c in known.items() if c >= number)
            high = min(s for s, c in known.items() if c < number)
            inside = known[low] - known[high]
            if inside == 1:
                value, vector = _iterate(matrix, (low + high) / 2, vectors)
                margin = max(least, 1e-12 * abs(value))
                if low - margin <= value <= high + margin and count(value - margin) >= number > count(value + margin):
                    break
            if high - low <= 2 * least or (low + high) / 2 in (low, high):
                value, vector = _iterate(matrix, (low + high) / 2, vectors)
                break
            count((low + high) / 2)
        values = np.append(values, value)
        vectors = np.column_stack([vectors, vector])
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: counts and sums are exact, ``basis`` has one column for each component."""

    dimensions: int
    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    basis: np.ndarray
    trace: float
    identity_error: float

    @property
    def project(self) -> np.ndarray:
        """Columns that take a centred vector to its whitened components; a flat component gives NaN."""
        flat = self.values <= FLAT * self.trace
        return np.where(flat, np.nan, self.basis / np.sqrt(np.where(flat, 1.0, self.values)))

    def whitened(self, x: np.ndarray) -> np.ndarray:
        mean = np.array([s / self.n for s in self.sums])
        return (x - mean) @ self.project

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The squared length of n * x - S, exact; None beyond a long."""
        sums = np.array([s % (1 << 64) for s in self.sums], np.uint64)
        rough = ((float(self.n) * x - np.array(self.sums, np.float64)) ** 2).sum(axis=1)
        off = (np.uint64(self.n) * x.astype(np.uint64) - sums).astype(np.int64)  # right wherever the result fits
        exact = (off * off).sum(axis=1)
        return [int(e) if r < 9.2e18 else self._exactly(row) for e, r, row in zip(exact, rough, x, strict=True)]

    def _exactly(self, row: np.ndarray) -> int | None:
        found = sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums, strict=True))
        return found if found < 1 << 63 else None


def _summed(fit: DataFrame, d: int, partial, width: int) -> dict[tuple[int, int], int]:
    """The exact sums over the fit list of ``partial(x)``, a matrix with ``width`` rows for each chunk of vectors."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros((width, d), object), False
        for batch in batches:
            packed = batch.column(0).to_pylist()
            for at in range(0, len(packed), CHUNK):
                total = total + partial(unpack_ints(packed[at:at + CHUNK], d)).astype(object)
                any_rows = True
        if any_rows:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.ravel()), pa.array(j.ravel()), pa.array([str(v) for v in total.ravel()])], ["i", "j", "v"]
            )

    parts = fit.mapInArrow(sums, "i long, j long, v string")
    found = parts.groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    return {(r["i"], r["j"]): int(r["v"]) for r in found}


def _whole(x: np.ndarray) -> np.ndarray:
    return np.vstack([np.full((1, x.shape[1]), len(x)), x.sum(axis=0, keepdims=True)])


def fit_whitening(df: DataFrame, vector: str = "embedding", components: int = 4) -> Whitening | None:
    """Fit on each distinct scaled vector of ``df`` once; None where no row can be used."""
    d = dimension(df, vector)
    if d is None:
        return None

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, rows = usable_rows(batch.column(0), d)
            yield pa.RecordBatch.from_arrays([pa.array(pack_ints(scaled(rows)), pa.binary())], ["x"])

    fit = checkpointed(df.select(numeric_vector(df, vector).alias("x")).mapInArrow(codes, "x binary").distinct())
    first = _summed(fit, d, _whole, 2)
    if not first:
        return None
    n, sums = first[0, 0], tuple(first[1, j] for j in range(d))
    near = np.array([round(s / n) for s in sums], np.int64)

    def products(x: np.ndarray) -> np.ndarray:
        centred = x - near
        return exact_products(centred.T, centred)

    # Centred on whole numbers next to the mean, so that products stay exact; what is left of the mean is taken off in integers.
    gram = _summed(fit, d, products, d)
    left = [s - n * int(m) for s, m in zip(sums, near, strict=True)]
    covariance = np.array([[(n * gram[i, j] - left[i] * left[j]) / (n * n) for j in range(d)] for i in range(d)])
    trace = sum(n * gram[i, i] - left[i] * left[i] for i in range(d)) / (n * n)
    values, basis = leading_components(covariance, components)
    model = Whitening(d, n, sums, values, basis, trace, 0.0)
    return Whitening(d, n, sums, values, basis, trace, _identity_error(fit, model))


def _identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, measured over the whole list."""
    live = np.flatnonzero(model.values > FLAT * model.trace)
    if not len(live):
        return 0.0
    d, k = model.dimensions, len(live)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = model.whitened(unpack_ints(batch.column(0).to_pylist(), d))[:, live]
            first += w.sum(axis=0)
            second += w.T @ w
        rows = np.vstack([first[None], second])
        i, j = np.indices(rows.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(rows.ravel())], ["i", "j", "v"])

    found = fit.mapInArrow(moments, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((k + 1, k))
    for r in found:
        total[r["i"], r["j"]] = r["v"] / model.n
    return float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(k)).max())


RESULT = "deviation long, whitened array<double>"


def whiten(df: DataFrame, model: Whitening | None, vector: str = "embedding") -> DataFrame:
    """row (the input), deviation and whitened (an entry for each component) of every row that can be used."""
    kind = T.StructType([T.StructField("row", df.schema, False)] + T.StructType.fromDDL(RESULT).fields)
    held = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), numeric_vector(df, vector).alias("v"))
    if model is None:
        return df.sparkSession.createDataFrame([], kind)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = usable_rows(batch.column(1), model.dimensions)
            x = scaled(rows)
            made = model.whitened(x)
            flat = pa.array(made.ravel(), pa.float64(), mask=np.isnan(made).ravel())
            offsets = np.arange(0, made.size + 1, made.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array(model.deviation(x), pa.int64()), pa.ListArray.from_arrays(offsets, flat)],
                ["row", "deviation", "whitened"],
            )

    return held.mapInArrow(apply, kind)
