"""Pairs of rows under a common key by what their sets share, compared a block against a block.

Where nearly all rows of a key are near enough to be compared, an equi-join on their tokens meets every pair once for each
token they share. Here both sides of a key are dealt over blocks, and each pair of blocks is one group: a task holds two blocks,
whatever the key's size, compares them tile by tile, and puts out only the pairs that are asked for. The comparisons still grow
with the square of a key. A row is sent once for each block of the other side; blocks grow with the root of the key up to
``MOST_ROWS``, so that small keys make many tasks and large ones few copies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a tile, and of the smallest and the largest blocks.
BLOCK, MOST_ROWS = 1024, 8192
#: Values that meet in more pairs than this are counted by a matrix product, so many at a time.
FREQUENT, COLUMNS = 4096, 4096


def overlaps(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], n_left: int, n_right: int) -> np.ndarray:
    """How many values each row of one side shares with each of the other; a side is (row, value) of its entries."""
    values, at = np.unique(np.concatenate([left[1], right[1]]), return_inverse=True)
    a, b = at[: len(left[1])], at[len(left[1]) :]
    meetings = np.bincount(a, minlength=len(values)) * np.bincount(b, minlength=len(values))
    frequent = np.flatnonzero(meetings > FREQUENT)
    column = np.full(len(values), -1)
    column[frequent] = np.arange(len(frequent))
    # values of few rows: their pairs one by one
    few_a, few_b = np.flatnonzero(column[a] < 0), np.flatnonzero(column[b] < 0)
    few_b = few_b[np.argsort(b[few_b], kind="stable")]
    start, end = (np.searchsorted(b[few_b], a[few_a], side) for side in ("left", "right"))
    n = end - start
    x = np.repeat(left[0][few_a], n)
    y = right[0][few_b[np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())]]
    shared = np.bincount(x * n_right + y, minlength=n_left * n_right).reshape(n_left, n_right).astype(np.float32)
    for first in range(0, len(frequent), COLUMNS):
        sides = []
        for (rows, _), of, size in ((left, column[a], n_left), (right, column[b], n_right)):
            inside = (of >= first) & (of < first + COLUMNS)
            sides.append(np.zeros((size, min(COLUMNS, len(frequent) - first)), np.float32))
            sides[-1][rows[inside], of[inside] - first] = 1
        shared += sides[0] @ sides[1].T
    return shared


def entries(column: pa.ChunkedArray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """(row, value) of a column of arrays of longs, and the arrays' sizes."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return (np.repeat(np.arange(len(lists)), sizes), lists.flatten().to_numpy(zero_copy_only=False)), sizes


def similarities(left: pa.ChunkedArray, right: pa.ChunkedArray) -> np.ndarray:
    """Jaccard similarities of two columns of sets (arrays of longs without repeated values); zero if either is empty."""
    (a, n_a), (b, n_b) = entries(left), entries(right)
    both = overlaps(a, b, len(n_a), len(n_b)).astype(np.float64)
    every = n_a[:, None] + n_b[None, :] - both
    return np.divide(both, every, out=np.zeros_like(both), where=every > 0)


def apart(left: pa.ChunkedArray, right: pa.ChunkedArray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the pairs of rows x and y share no value of two columns of arrays of longs."""
    (a, n_a), (b, n_b) = entries(left), entries(right)
    return overlaps(a, b, len(n_a), len(n_b))[x, y] == 0


def best_places(of: np.ndarray, low: np.ndarray, high: np.ndarray, sure: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Which rows can be among the k best (by score, then order) of their group ``of``.

    A row's score lies between ``low`` and ``high``; only rows that are ``sure`` to count drive others out.
    """
    rows = np.flatnonzero(sure)
    rows = rows[np.lexsort((order[rows], -low[rows], of[rows]))]
    groups, first = np.unique(of[rows], return_index=True)
    last = first + k - 1
    full = np.diff(np.append(first, len(rows))) >= k
    score, place = np.full(of.max(initial=0) + 1, -np.inf), np.full(of.max(initial=0) + 1, np.inf)
    at = rows[last[full]]
    score[groups[full]], place[groups[full]] = low[at], order[at]
    return (high > score[of]) | ((high == score[of]) & (order <= place[of]))


def compared(left: DataFrame, right: DataFrame, sets: list[str], choose: Callable, added: str = "", same: bool = False, held: bool = False) -> DataFrame:
    """Pairs under a common key (left_id, right_id, a similarity named for each of ``sets``) that ``choose`` keeps.

    Both sides: key, id, the sets as arrays of longs, and columns of any name. ``choose`` takes the two sides' columns as tables and
    the matrices of similarities, and returns the chosen rows of either side, pair by pair, and the values of the columns ``added``.
    If both sides are the ``same`` rows, two blocks meet once and are chosen from both ways round, and a block that meets itself is sent once.
    With ``held``, ``choose`` also takes a dict that lasts while one tile of the left block meets those of the right. Pairs leave a task tile by tile.
    """
    kind = left.schema["id"].dataType.simpleString()
    schema = f"left_id {kind}, right_id {kind}, {', '.join(f'{c} double' for c in sets)}" + (f", {added}" if added else "")
    names = [c.split()[0] for c in added.split(", ") if c]

    def dealt(rows: DataFrame, other: DataFrame, side: str) -> DataFrame:
        def blocks(df):
            n = F.count("*")
            return F.ceil(n / F.greatest(F.lit(BLOCK), F.least(F.lit(MOST_ROWS), F.sqrt(n * BLOCK))))

        # keys of more than one block are few: one a BLOCK rows at most
        own = rows.groupBy("key").agg(blocks(rows).alias("_own")).where("_own > 1")
        others = other.groupBy("key").agg(blocks(other).alias("_others")).where("_others > 1")
        found = rows.join(F.broadcast(own), "key", "left").join(F.broadcast(others), "key", "left").fillna(1, ["_own", "_others"])
        found = found.withColumn("_number", F.pmod(F.xxhash64("id"), F.col("_own")).cast("int"))
        number, last = F.col("_number"), (F.col("_others") - 1).cast("int")
        partner = F.explode(F.sequence(F.lit(0), last) if not same else F.sequence(number, last) if side == "left" else F.sequence(F.lit(0), number))
        i, j = (number, partner) if side == "left" else (partner, number)
        return found.select(*[F.col(c).alias(c) for c in rows.columns], i.alias("_i"), j.alias("_j"))  # columns of their own: both sides may be one table

    def tiles(table):
        return [table.slice(first, BLOCK) for first in range(0, table.num_rows, BLOCK)]

    def compare(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, itself = pa.Table.from_batches(list(batches)), same and key[1].as_py() == key[2].as_py()
        one = table.filter(pc.invert(table.column("_right")))
        other = one if itself else table.filter(table.column("_right"))
        for a in tiles(one):
            kept = ({},) if held else ()
            for b in tiles(other):
                measures = [similarities(a.column(c), b.column(c)) for c in sets]
                for first, second, turned in ((a, b, False), (b, a, True))[: 1 + (same and not itself)]:
                    m = [x.T for x in measures] if turned else measures
                    x, y, values = choose(first, second, *m, *kept)
                    columns = [first.column("id").take(pa.array(x)), second.column("id").take(pa.array(y)), *[pa.array(v[x, y]) for v in m], *values]
                    yield from pa.table(dict(zip(made.names, columns, strict=True))).cast(made).combine_chunks().to_batches()

    arrow = {"string": pa.string(), "long": pa.int64(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64())}
    made = pa.schema([("left_id", arrow[kind]), ("right_id", arrow[kind]), *[(c, pa.float64()) for c in sets], *[(c, arrow[a.split()[1]]) for c, a in zip(names, added.split(", "), strict=False)]])
    one, other = dealt(left, right, "left"), dealt(right, left, "right")
    both = one.withColumn("_right", F.lit(False)).unionByName((other.where("_i <> _j") if same else other).withColumn("_right", F.lit(True)), allowMissingColumns=True)
    # by number: few bytes can be many comparisons, which merged partitions would put into one task
    n = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(n, "key", "_i", "_j").groupBy("key", "_i", "_j").applyInArrow(compare, schema)
