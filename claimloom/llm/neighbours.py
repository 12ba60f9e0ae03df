"""Approximate nearest neighbours by multiprobe p-stable hashing.

Nearness is the largest inner product. One further entry gives every vector the norm of the longest, so that
the nearest by inner product are the nearest by distance, for which p-stable hashes are made: a hash is
floor((a.v + b) / w) with normal a, a table's key is several of them. A query visits in each table not only its own bucket but
the buckets with perturbed hashes, in the order of the estimated probability that a neighbour lies there: per hash
that of the normal distribution around the query's projection whose width is the usual distance of a neighbour.

Vectors are searched once for each distinct value: a class carries its least ids, one more than are returned, as no list can hold others. A
first round visits the own buckets; its results bound what later visits must report. Inside a bucket scores are
matrix products in double precision, which are recomputed in one fixed order for what is reported.

How many buckets a query visits is fitted: for at most ``SAMPLE`` queries the true neighbours are found by brute force
over all rows, and the least number of visits a table is taken that finds ``target`` of them. Where no number does, and for queries that
found fewer than were asked for, all rows are searched. All rows are indexed, all stated queries asked.

Defined results: rows without key, zero vectors and rows that cannot be used (see ``vectors``) take no part; a repeated row counts
once; a key that stands for several vectors is searched and found with each; rows of the query's own key are never its neighbours. Ties go
to the smaller key. An empty table gives no rows. Columns other than key and vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import checkpointed
from claimloom.llm.vectors import dimension, each_row, numeric_vector, usable_rows

#: Vectors in a piece of a bucket, queries in a chunk.
PIECE, CHUNK = 1024, 512
#: Queries and vectors that parameters are fitted on.
SAMPLE, SPREAD_SAMPLE = 128, 4096
#: Vectors that a bucket holds on the whole; width of a hash in standard deviations of the projections; greatest shift of a hash.
FULL, WIDTH, REACH = 2048, 2.0, 2
#: Visits a table that can be planned.
MOST = 4096
#: Results that a task holds before it ranks them.
HELD = 400_000


def _erf(z: np.ndarray) -> np.ndarray:
    """The error function to 1.5e-7 (a rational approximation, enough to order visits)."""
    t = 1 / (1 + 0.3275911 * np.abs(z))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(z) * (1 - poly * np.exp(-z * z))


@dataclass(frozen=True)
class Table:
    """One hash table; without hashes it has a single bucket, which is exact search."""

    number: int
    directions: np.ndarray  # a column for each hash
    offsets: np.ndarray
    widths: np.ndarray
    spread: np.ndarray  # of a neighbour's projection around the query's, in widths

    @property
    def shifts(self) -> int:
        return (2 * REACH + 1) ** len(self.widths)

    def projections(self, points: np.ndarray) -> np.ndarray:
        return (points @ self.directions + self.offsets) / self.widths

    def hashes(self, points: np.ndarray) -> np.ndarray:
        return np.floor(self.projections(points)).astype(np.int64)

    def probes(self, points: np.ndarray, most: int) -> np.ndarray:
        """Perturbations (row, visit, hash) in falling order of their estimated success; the own bucket is usually the first.

        The estimate is a product over the hashes, so the best of some hashes hold the beginnings of the best of all:
        after each hash only ``most`` beginnings are kept.
        """
        found = np.zeros((len(points), 1, 0), np.int8)
        score = np.zeros((len(points), 1))
        at = self.projections(points)
        inside = at - np.floor(at)
        steps = np.arange(-REACH, REACH + 1)
        for j in range(len(self.widths)):
            edges = (np.arange(-REACH, REACH + 2)[None] - inside[:, j:j + 1]) / (self.spread[j] * 2**0.5)
            chance = np.log(np.maximum(np.diff(_erf(edges), axis=1) / 2, 1e-9))
            both = (score[:, :, None] + chance[:, None, :]).reshape(len(points), -1)
            keep = np.argsort(-both, axis=1, kind="stable")[:, :most]
            score = np.take_along_axis(both, keep, 1)
            before = np.take_along_axis(found, (keep // len(steps))[:, :, None], 1)
            found = np.concatenate([before, steps[keep % len(steps)][:, :, None].astype(np.int8)], axis=2)
        return found


@dataclass(frozen=True)
class Index:
    """The fitted tables and the number of visits in each."""

    dimensions: int
    longest: float
    tables: tuple[Table, ...]
    visits: int

    def points(self, rows: np.ndarray) -> np.ndarray:
        """Vectors with the entry that makes them all as long as the longest."""
        rows = rows.astype(np.float64)
        return np.column_stack([rows, np.sqrt(np.maximum(self.longest**2 - (rows * rows).sum(axis=1), 0.0))])

    def asked(self, rows: np.ndarray) -> np.ndarray:
        """Queries at the longest vector's length, which changes no order."""
        rows = rows.astype(np.float64)
        norms = np.linalg.norm(rows, axis=1, keepdims=True)
        return np.column_stack([rows * (self.longest / np.where(norms > 0, norms, 1.0)), np.zeros(len(rows))])


def _exact_table(d: int) -> Table:
    none = np.zeros(0)
    return Table(-1, np.zeros((d + 1, 0)), none, none, none)


def _read(df: DataFrame, key: str, vector: str, d: int) -> DataFrame:
    """id and vector (bytes of its float type) of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = usable_rows(batch.column(1), d)
            rows = rows + rows.dtype.type(0)  # no negative zeros
            live = (rows != 0).any(axis=1)
            packed = [r.tobytes() for r in rows[live]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[live])), pa.array(packed, pa.binary())], ["id", "v"])

    held = df.select(F.col(f"`{key}`").cast("long").alias("id"), numeric_vector(df, vector).alias("v")).where("id is not null")
    return held.mapInArrow(run, "id long, v binary")


def _matrix(packed: list[bytes], d: int) -> np.ndarray:
    kind = "<f4" if packed and len(packed[0]) == 4 * d else "<f8"
    return np.frombuffer(b"".join(packed), kind).reshape(len(packed), d).astype(np.float64)


RESULT = "q long, cid long, score double, ids array<long>"


class _Best:
    """The best classes of each query among what a task has found so far."""

    def __init__(self, k: int) -> None:
        self.k, self.parts, self.size = k, [], 0

    def add(self, q: np.ndarray, cid: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.parts.append((q, cid, score, ids))
        self.size += len(q)

    def ranked(self) -> tuple[np.ndarray, ...]:
        q, cid, score, ids = (np.concatenate([p[i] for p in self.parts]) for i in range(4))
        order = np.lexsort((cid, -score, q))
        q, cid, score, ids = q[order], cid[order], score[order], ids[order]
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (cid[1:] != cid[:-1])
        q, cid, score, ids = q[new], cid[new], score[new], ids[new]
        starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        top = place < self.k
        return q[top], cid[top], score[top], ids[top]

    def shrink(self) -> bool:
        """Rank what is held; whether there is room again."""
        self.parts = [self.ranked()]
        self.size = len(self.parts[0][0])
        return self.size < HELD // 2

    def batches(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        q, cid, score, ids = self.ranked()
        self.parts, self.size = [], 0
        for at in range(0, len(q), 50_000):
            cut = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(q[cut]), pa.array(cid[cut]), pa.array(score[cut]), pa.array(list(ids[cut]), pa.list_(pa.int64()))],
                ["q", "cid", "score", "ids"],
            )


def _compare(best: _Best, names: np.ndarray, queries: np.ndarray, least: np.ndarray, cids: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
    """Add each query's best rows that reach its bound; scores of what is added are summed in one fixed order."""
    scores = queries @ rows.T
    slack = 1e-12 * (np.abs(scores).max() + 1e-300)
    if rows.shape[0] > best.k:
        kth = np.partition(scores, scores.shape[1] - best.k, axis=1)[:, -best.k]
        least = np.maximum(least, kth)
    who, what = np.nonzero(scores >= (least - slack)[:, None])
    exact = np.einsum("ij,ij->i", queries[who], rows[what])
    best.add(names[who], cids[what], exact, ids[what])


def _objects(lists: list) -> np.ndarray:
    out = np.empty(len(lists), object)
    out[:] = lists
    return out


def near_neighbours(df: DataFrame, query, key: str = "vec_id", vector: str = "embedding", k: int = 20, tables: int = 4,
                    target: float = 0.95, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row whose key satisfies ``query`` (a function of the column)."""
    spark = df.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    d = dimension(df, vector)
    if d is None:
        return spark.createDataFrame([], result)
    rows = _read(df, key, vector, d)
    order = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    least = rows.withColumn("n", order).where(F.col("n") <= k + 1)
    classes = least.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")).withColumn("cid", F.col("ids")[0])
    classes = checkpointed(classes)
    asked = rows.where(query(F.col("id")))
    queries = checkpointed(asked.groupBy("v").agg(F.min("id").alias("q")))
    index = _fit(classes, queries, d, k, tables, target, seed)
    if index is None:
        return spark.createDataFrame([], result)
    unbound = queries.withColumn("least", F.lit(float("-inf")))
    home = checkpointed(_search(classes, unbound, index, 0, 1, k + 1))
    found = home
    if index.visits > 1:
        ranked = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cid"))
        once = home.dropDuplicates(["q", "cid"]).withColumn("n", ranked).where(F.col("n") == k + 1)
        bound = queries.join(once.select("q", F.col("score").alias("least")), "q", "left").fillna(float("-inf"), ["least"])
        found = home.unionByName(_search(classes, bound, index, 1, index.visits, k + 1))
    best = checkpointed(_best_classes(found, k + 1))
    total = classes.agg(F.sum(F.size("ids"))).head()[0]
    short = queries.join(best.groupBy("q").agg(F.sum(F.size("ids")).alias("n")), "q", "left").where(F.coalesce("n", F.lit(0)) < min(k + 1, total))
    short = checkpointed(short.select("v", "q", F.lit(float("-inf")).alias("least")))
    if short.head() is not None:
        exact = Index(d, index.longest, (_exact_table(d),), 1)
        again = _best_classes(_search(classes, short, exact, 0, 1, k + 1), k + 1)
        best = best.join(short.select("q"), "q", "left_anti").unionByName(again)
    members = asked.distinct().join(queries, "v").select(F.col("id").alias("query_id"), "v", "q")
    listed = members.join(best, "q").select("query_id", "v", "score", F.explode("ids").alias("vec_id")).where("vec_id != query_id")
    last = Window.partitionBy("query_id", "v").orderBy(F.desc("score"), "vec_id")
    return listed.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best_classes(found: DataFrame, k: int) -> DataFrame:
    ranked = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cid"))
    return found.dropDuplicates(["q", "cid"]).withColumn("n", ranked).where(F.col("n") <= k).drop("n")


def _fit(classes: DataFrame, queries: DataFrame, d: int, k: int, tables: int, target: float, seed: int) -> Index | None:
    """Tables whose widths follow the projections of a bounded sample, and visits that find ``target`` of the sampled neighbours."""

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, most = 0, 0.0
        for batch in batches:
            x = _matrix(batch.column(0).to_pylist(), d)
            if len(x):
                n, most = n + len(x), max(most, float((x * x).sum(axis=1).max()))
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([most])], ["n", "most"])

    seen = classes.select("v").mapInArrow(norms, "n long, most double").agg(F.sum("n").alias("n"), F.max("most").alias("most")).head()
    chance = F.xxhash64("v", F.lit(seed))
    asked = _matrix([bytes(r["v"]) for r in queries.orderBy(chance, "q").limit(SAMPLE).collect()], d)
    if not seen["n"] or not len(asked):
        return None
    sample = _matrix([bytes(r["v"]) for r in classes.orderBy(chance, "cid").limit(SPREAD_SAMPLE).select("v").collect()], d)
    m = max(1, round(float(np.log2(max(seen["n"] / FULL, 1.0))) / 1.25))
    bare = Index(d, float(seen["most"]) ** 0.5, (), 1)
    points, at = bare.points(sample), bare.asked(asked)
    near = _true_neighbours(classes, asked, d, k + 1)
    if not near:
        return None
    who = np.array([i for i, _ in near])
    there = bare.points(_matrix([v for _, v in near], d))
    distance = float(np.sqrt(np.median(((there - at[who]) ** 2).sum(axis=1)))) or 1.0
    made = []
    for number in range(tables):
        rng = np.random.default_rng([seed, number])
        directions = rng.normal(size=(d + 1, m))
        spread = (points @ directions).std(axis=0)
        norms_of = np.linalg.norm(directions, axis=0)
        widths = WIDTH * np.where(spread > 1e-9 * norms_of * bare.longest, spread, norms_of * bare.longest)
        # A neighbour's offset spreads over all directions alike.
        made.append(Table(number, directions, rng.uniform(0, 1, m) * widths, widths, distance * norms_of / (d + 1) ** 0.5 / widths))
    ranks = np.min([_ranks(t, at, there, who) for t in made], axis=0)
    visits = int(np.sort(ranks)[min(len(ranks) - 1, int(np.ceil(target * len(ranks))) - 1)]) + 1
    if visits > MOST:
        return Index(d, bare.longest, (_exact_table(d),), 1)
    return Index(d, bare.longest, tuple(made), visits)


def _ranks(table: Table, asked: np.ndarray, there: np.ndarray, who: np.ndarray) -> np.ndarray:
    """The place of each neighbour's bucket among its query's visits; MOST where it has none."""
    digits = (2 * REACH + 1) ** np.arange(len(table.widths)).astype(object)
    shift = table.hashes(there) - table.hashes(asked)[who]
    near = (np.abs(shift) <= REACH).all(axis=1)
    found = np.full(len(who), MOST)
    for i in np.unique(who):
        probes = table.probes(asked[i:i + 1], MOST)[0].astype(object) + REACH
        places = {code: n for n, code in enumerate((probes * digits).sum(axis=1).tolist())}
        for j in np.flatnonzero((who == i) & near):
            found[j] = places.get(int(((shift[j].astype(object) + REACH) * digits).sum()), MOST)
    return found


def _true_neighbours(classes: DataFrame, asked: np.ndarray, d: int, k: int) -> list[tuple[int, bytes]]:
    """The k nearest classes of each sampled query, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        for batch in batches:
            packed = batch.column(1).to_pylist()
            for at in range(0, len(packed), PIECE):
                part = packed[at:at + PIECE]
                cids = batch.column(0).slice(at, PIECE).to_numpy()
                _compare(best, np.arange(len(asked)), asked, np.full(len(asked), -np.inf), cids, _objects(part), _matrix(part, d))
            if best.size:
                best.shrink()
        if best.size:
            q, cid, score, packed = best.ranked()
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(cid), pa.array(score), pa.array(list(packed), pa.binary())], ["q", "cid", "score", "v"])

    found = classes.select("cid", "v").mapInArrow(run, "q long, cid long, score double, v binary")
    ranked = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cid"))
    best = found.withColumn("n", ranked).where(F.col("n") <= k)
    return [(r["q"], bytes(r["v"])) for r in best.select("q", "v").collect()]


def _search(classes: DataFrame, queries: DataFrame, index: Index, first: int, last: int, k: int) -> DataFrame:
    """RESULT rows from the buckets that ``queries`` (q, v, least) visit from place ``first`` up to ``last`` in every table."""
    d = index.dimensions

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = index.points(_matrix(batch.column(2).to_pylist(), d))
            for table in index.tables:
                keys = [h.tobytes() for h in table.hashes(points).astype("<i4")]
                yield pa.RecordBatch.from_arrays([pa.array([table.number] * len(keys), pa.int32()), pa.array(keys, pa.binary()), *batch.columns],
                                                 ["tab", "bucket", "cid", "ids", "v"])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                names = batch.column(0).slice(at, CHUNK).to_numpy()
                packed = batch.column(1).slice(at, CHUNK).to_pylist()
                least = batch.column(2).slice(at, CHUNK).to_numpy()
                points = index.asked(_matrix(packed, d))
                for table in index.tables:
                    shifts = table.probes(points, last)[:, first:last]
                    keys = (table.hashes(points)[:, None] + shifts).astype("<i4")
                    who = np.repeat(np.arange(len(names)), keys.shape[1])
                    meet: dict[bytes, list[int]] = {}
                    for i, h in zip(who.tolist(), keys.reshape(len(who), -1), strict=True):
                        meet.setdefault(h.tobytes(), []).append(i)
                    for some in _cut(list(meet.items()), 256):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([table.number] * len(some), pa.int32()), pa.array([b for b, _ in some], pa.binary()),
                             pa.array([names[i] for _, i in some], pa.list_(pa.int64())), pa.array([least[i] for _, i in some], pa.list_(pa.float64())),
                             pa.array([[packed[j] for j in i] for _, i in some], pa.list_(pa.binary()))],
                            ["tab", "bucket", "qs", "least", "asked"],
                        )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        for r in each_row(batches):
            _compare(best, np.array(r["qs"]), _matrix(r["asked"], d), np.array(r["least"]), np.array(r["cids"]), _objects(r["ids"]), _matrix(r["rows"], d))
            if best.size > HELD and not best.shrink():
                yield from best.batches()
        yield from best.batches()

    held = classes.select("cid", "ids", "v").mapInArrow(bucketed, "tab int, bucket binary, cid long, ids array<long>, v binary")
    # A bucket is cut into pieces of about PIECE vectors, as many as its count asks for; none meets a task as a whole.
    counts = held.groupBy("tab", "bucket").agg(F.ceil(F.count("*") / PIECE).alias("pieces"))
    dealt = held.join(counts, ["tab", "bucket"]).withColumn("piece", F.pmod(F.xxhash64("cid"), F.col("pieces")))
    shelves = dealt.groupBy("tab", "bucket", "piece").agg(F.collect_list(F.struct("cid", "ids", "v")).alias("s")).select(
        "tab", "bucket", F.col("s.cid").alias("cids"), F.col("s.ids").alias("ids"), F.col("s.v").alias("rows"))
    going = queries.select("q", "v", "least").mapInArrow(visits, "tab int, bucket binary, qs array<long>, least array<double>, asked array<binary>")
    return shelves.join(going, ["tab", "bucket"]).mapInArrow(compare, RESULT)


def _cut(items: list, size: int) -> Iterator[list]:
    return (items[at:at + size] for at in range(0, len(items), size))
