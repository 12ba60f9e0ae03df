"""Vector columns as numpy matrices inside tasks, shared by the embedding operators.

Which rows can be used: the vector is not null, has the table's commonest length (of equally common lengths the
greatest; empty vectors never) and neither null nor non-finite entries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_vector(df: DataFrame, name: str):
    """The vector column as an array of floats or doubles, whichever it has; other numbers become doubles."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
        return F.col(f"`{name}`")
    return F.col(f"`{name}`").cast("array<double>")


def dimension(df: DataFrame, name: str) -> int | None:
    """The commonest length of the vectors, None without any; one pass over that column alone."""
    sizes = df.select(F.size(f"`{name}`").alias("d")).where("d > 0").groupBy("d").count()
    first = sizes.orderBy(F.desc("count"), F.desc("d")).head()
    return first["d"] if first else None


def usable_rows(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the rows that can be used, and their vectors as a matrix of the column's own float type."""
    right = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), d), False))
    at = np.flatnonzero(right)
    entries = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
    rows = entries.reshape(len(at), d)
    finite = np.isfinite(rows).all(axis=1) if len(at) else np.zeros(0, bool)
    return at[finite], rows[finite]


#: Scaled entries lie within +-2^40; greater ones are cut to that, so that sums of their products stay exact.
LARGEST = 1 << 40


def scaled(rows: np.ndarray) -> np.ndarray:
    """floor(256 * c) of each entry c, as long."""
    return np.clip(np.floor(256.0 * rows.astype(np.float64)), -LARGEST, LARGEST).astype(np.int64)


def pack_ints(rows: np.ndarray) -> list[bytes]:
    """Each row as bytes of the narrowest of four integer widths that holds it, so equal rows have equal bytes."""
    out: list[bytes] = [b""] * len(rows)
    if not len(rows):
        return out
    most = np.maximum(rows.max(axis=1), -(rows.min(axis=1) + 1))
    width = np.select([most < 1 << 7, most < 1 << 15, most < 1 << 31], [1, 2, 4], 8)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        data = rows[at].astype(f"<i{w}").tobytes()
        step = w * rows.shape[1]
        for k, i in enumerate(at):
            out[i] = data[k * step:(k + 1) * step]
    return out


def unpack_ints(packed: list[bytes], d: int) -> np.ndarray:
    """The matrix of rows written by ``pack_ints``."""
    rows = np.empty((len(packed), d), np.int64)
    lengths = np.fromiter(map(len, packed), np.int64, len(packed))
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        data = b"".join(packed[i] for i in at)
        rows[at] = np.frombuffer(data, f"<i{length // d}").reshape(len(at), d)
    return rows


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of integer matrices, exact: in floats where every sum stays below 2^53, else in longs or Python's integers."""
    if not a.size or not b.size:
        return np.zeros((a.shape[0], b.shape[1]), np.int64)
    bound = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    if bound < 1 << 63:
        return a @ b
    return a.astype(object) @ b.astype(object)


def each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of heavy batches as dictionaries, a few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 8):
            yield from batch.slice(at, 8).to_pylist()
