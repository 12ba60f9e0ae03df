"""Hard negatives by Hilbert-ordered blocks and zone maps.

Rows are put in the order of a Hilbert curve through all dimensions (the most variable first) and written as Parquet, one row
for each block of at most ``BLOCK`` vectors, with the least and greatest entry of every dimension: its zone map. Interval
arithmetic on a zone map bounds the inner products of an anchor with all of the block's vectors from both sides. Anchors
travel in groups, also in the curve's order; per anchor the bounds choose the blocks to read:

1. two blocks of greatest upper bound that hold the anchor's label, whose rows give a first fifth-best score;
2. all blocks of the label whose upper bound reaches that score: these hold the anchor's positives;
3. for each positive the blocks with another label whose interval meets the positive's window: these hold its negatives.

The search is exact: a block is left out only where its bounds prove that it holds nothing asked for. On vectors without
any structure (uniform on a sphere) the bounds prove little and nearly all blocks are read, in matrix products.

Defined results: rows without key or label, or that cannot be used (see ``vectors``), take no part; a
key that repeats stands for a row each time, an anchor never meets rows of its own key, and repeated anchor rows return
their rows each; entries beyond +-2^40 after scaling are cut to that. A positive without rows in its window, and an
anchor without positives, return nothing; so does an empty table. Columns other than key, label and vector are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import checkpointed, remove_folder, shared_folder
from claimloom.llm.vectors import dimension, each_row, exact_products, numeric_vector, pack_ints, scaled, unpack_ints, usable_rows

#: Vectors in a block, anchors in a group, zone maps in a page.
BLOCK, GROUP, PAGE = 1024, 256, 512
#: Levels of the curve in each dimension, as bits.
BITS = 8
#: Blocks read per anchor for a first bound.
FIRST = 2


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """The place of each row of ``cells`` (integers below 2^bits) on the Hilbert curve, as bytes that sort in its order.

    Skilling's transform: undo the excess rotations and reflections level by level, then Gray-decode and interleave the bits.
    """
    x = cells.T.astype(np.int64).copy()
    d = len(x)
    if not cells.size:
        return []
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(d):
            up = (x[i] & bit) != 0
            change = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, change)
            x[i] ^= change
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[d - 1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn
    planes = (x[None] >> np.arange(bits - 1, -1, -1)[:, None, None]) & 1
    packed = np.packbits(planes.reshape(bits * d, -1).astype(np.uint8), axis=0)
    return [row.tobytes() for row in np.ascontiguousarray(packed.T)]


def _bytes_of(matrix: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in np.ascontiguousarray(matrix.astype("<i8"))]


def _rows(df: DataFrame, key: str, label: str, vector: str, d: int) -> DataFrame:
    """id, label and packed vector of the rows that take part."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = usable_rows(batch.column(2), d)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(pack_ints(scaled(rows)), pa.binary())],
                ["id", "label", "x"],
            )

    named = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"),
                      numeric_vector(df, vector).alias("v"))
    return named.where("id is not null and label is not null").mapInArrow(read, "id long, label long, x binary")


def _spread(rows: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Least and greatest entry of each dimension, and the dimensions by falling variance; from sums per task."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for batch in batches:
            x = unpack_ints(batch.column(0).to_pylist(), d).astype(np.float64)
            if len(x):
                found = [np.stack([x.min(0), x.max(0), x.sum(0), (x * x).sum(0), np.full(d, len(x))])] + found
                low, high = np.min([f[0] for f in found], 0), np.max([f[1] for f in found], 0)
                found = [np.vstack([low[None], high[None], np.sum([f[2:] for f in found], 0)])]
        if found:
            names = ["low", "high", "s", "ss", "n"]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), *map(pa.array, found[0])], ["i", *names])

    parts = rows.select("x").mapInArrow(moments, "i long, low double, high double, s double, ss double, n double")
    total = parts.groupBy("i").agg(F.min("low"), F.max("high"), F.sum("s"), F.sum("ss"), F.sum("n")).orderBy("i").collect()
    if not total:
        return None
    low, high, s, ss, n = np.array([list(r)[1:] for r in total]).T
    return low.astype(np.int64), high.astype(np.int64), np.argsort(-(ss / n - (s / n) ** 2), kind="stable")


BLOCK_SCHEMA = "block long, ids binary, labels binary, x array<binary>, low binary, high binary, kinds array<long>"


def _blocks(rows: DataFrame, d: int, spread, size: int) -> DataFrame:
    """Rows in the curve's order, ``size`` of them to a block; equal places are ordered by id and may be cut."""
    low, high, order = spread

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.maximum(high - low, 1).astype(np.float64)
        for batch in batches:
            x = unpack_ints(batch.column(2).to_pylist(), d)
            cells = np.minimum((x - low) / width * (1 << BITS), (1 << BITS) - 1).astype(np.int64)
            keys = hilbert_keys(cells[:, order], BITS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], ["id", "label", "x", "place"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting = TaskContext.get().partitionId() << 32, None

        def block(part: pa.Table) -> pa.RecordBatch:
            ids = part.column("id").to_numpy().astype("<i8")
            labels = part.column("label").to_numpy().astype("<i8")
            x = unpack_ints(part.column("x").to_pylist(), d)
            by_id = np.argsort(ids, kind="stable")
            ids, labels, x = ids[by_id], labels[by_id], x[by_id]
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([ids.tobytes()], pa.binary()), pa.array([labels.tobytes()], pa.binary()),
                 pa.array([pack_ints(x)], pa.list_(pa.binary())), pa.array(_bytes_of(x.min(0)[None]), pa.binary()),
                 pa.array(_bytes_of(x.max(0)[None]), pa.binary()), pa.array([np.unique(labels).tolist()], pa.list_(pa.int64()))],
                ["block", "ids", "labels", "x", "low", "high", "kinds"],
            )

        for batch in batches:
            new = pa.Table.from_batches([batch])
            waiting = new if waiting is None else pa.concat_tables([waiting, new])
            while len(waiting) >= size:
                yield block(waiting.slice(0, size))
                number += 1
                waiting = waiting.slice(size)
        if waiting is not None and len(waiting):
            yield block(waiting)

    placed = rows.mapInArrow(place, "id long, label long, x binary, place binary")
    ranged = placed.repartitionByRange("place", "id").sortWithinPartitions("place", "id").select("id", "label", "x")
    return ranged.mapInArrow(cut, BLOCK_SCHEMA)


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor and zone the least and greatest inner product that the zone allows."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return exact_products(up, low.T) + exact_products(down, high.T), exact_products(up, high.T) + exact_products(down, low.T)


def _longs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8")


def _zone_pages(blocks: DataFrame) -> DataFrame:
    """part, page, zones: the blocks' zone maps in pages; reads the maps' columns alone."""
    zones = blocks.select("block", "low", "high", "kinds", F.shiftright("block", 32).alias("part"))
    paged = zones.withColumn("page", F.floor((F.row_number().over(Window.partitionBy("part").orderBy("block")) - 1) / PAGE))
    return checkpointed(paged.groupBy("part", "page").agg(F.sort_array(F.collect_list(F.struct("block", "low", "high", "kinds"))).alias("zones")))


def _meet(groups: DataFrame, pages: DataFrame, d: int, choose, schema: str) -> DataFrame:
    """``choose(group, low bounds, high bounds, zones)`` for each group of anchors and page of zone maps.

    The stated anchors meet all zone maps, in groups and pages: an equi-join on the page's number.
    """
    listed = pages.agg(F.collect_list(F.struct("part", "page")).alias("pages"))  # one row, an entry for up to 500,000 vectors
    wanted = groups.join(F.broadcast(listed)).withColumn("at", F.explode("pages")).select(
        F.col("at.part").alias("part"), F.col("at.page").alias("page"), *groups.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in each_row(batches):
            low = np.array([_longs(z["low"]) for z in r["zones"]])
            high = np.array([_longs(z["high"]) for z in r["zones"]])
            found = choose(r, *bounds(unpack_ints(r["x"], d), low, high), r["zones"])
            if found is not None:
                yield found

    return wanted.join(pages, ["part", "page"]).mapInArrow(run, schema)


def _read(needs: DataFrame, groups: DataFrame, blocks: DataFrame, d: int, search, schema: str) -> DataFrame:
    """``search(group, positions, scores, block)`` for each group and block that ``needs`` names (grp, block, members)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in each_row(batches):
            members = np.asarray(r["members"])
            x, y = unpack_ints([r["x"][m] for m in members], d), unpack_ints(r["block_x"], d)
            found = search(r, members, exact_products(x, y.T), _longs(r["block_ids"]), _longs(r["block_labels"]))
            if found is not None:
                yield found

    held = blocks.select("block", F.col("ids").alias("block_ids"), F.col("labels").alias("block_labels"), F.col("x").alias("block_x"))
    # A fixed number of partitions: few bytes stand for many products here, so that partitions must not be merged by size.
    parts = int(needs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return needs.join(groups, "grp").join(held, "block").repartition(parts, "block", "grp").mapInArrow(run, schema)


def _batch(schema: str, columns: list) -> pa.RecordBatch | None:
    names = [part.split()[0] for part in schema.split(", ")]
    if not len(columns[0]):
        return None
    return pa.RecordBatch.from_arrays([pa.array(c) if not isinstance(c, pa.Array) else c for c in columns], names)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k greatest scores, ties to the smaller id; ids rise."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def hard_negatives(df: DataFrame, anchor, key: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = 5,
                   negatives: int = 3, window: tuple[int, int] = (50, 95)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` is a function from the key column (long) to whether a row is an anchor. For each of an anchor's first ``positives``
    rows of its label the first ``negatives`` rows of other labels whose score lies within ``window`` per cent of
    the positive's. Scores are inner products of floor(256 * entry); greater first, ties to the smaller key.
    """
    spark = df.sparkSession
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    d = dimension(df, vector)
    rows = _rows(df, key, label, vector, d) if d else None
    spread = _spread(rows, d) if d else None
    if spread is None:
        return spark.createDataFrame([], result)
    folder = f"{shared_folder(spark)}/hard-negatives-{uuid.uuid4().hex}"
    try:
        return _mined(spark, rows, anchor, d, spread, folder, positives, negatives, window)
    finally:
        remove_folder(spark, folder)


def _mined(spark, rows: DataFrame, anchor, d: int, spread, folder: str, positives: int, negatives: int, window) -> DataFrame:
    _blocks(rows, d, spread, BLOCK).write.parquet(f"{folder}/blocks")
    _blocks(rows.where(anchor(F.col("id"))), d, spread, GROUP).write.parquet(f"{folder}/anchors")
    blocks = spark.read.parquet(f"{folder}/blocks")
    groups = spark.read.parquet(f"{folder}/anchors").select(F.col("block").alias("grp"), "ids", "labels", "x")
    pages = _zone_pages(blocks)
    need = "grp long, block long, members array<int>"

    def has(labels: np.ndarray, zones: list[dict], other: bool) -> np.ndarray:
        """Whether a zone's block has the anchor's label, or (other) a label besides."""
        kinds = [np.asarray(z["kinds"]) for z in zones]
        own = np.array([np.isin(labels, k) for k in kinds]).T
        return (np.array([len(k) for k in kinds])[None] > own) if other else own

    def first(r, low, high, zones):
        own = has(_longs(r["labels"]), zones, False)
        rank = np.where(own, high, np.iinfo(np.int64).min)
        at = np.argsort(-rank.astype(np.float64), axis=1, kind="stable")[:, :FIRST]
        who = np.repeat(np.arange(len(rank)), at.shape[1])
        at = at.ravel()
        keep = own[who, at]
        who, at = who[keep], at[keep]
        names = np.array([z["block"] for z in zones])
        return _batch(seed, [np.full(len(who), r["grp"]), who.astype(np.int32), names[at], high[who, at].astype(np.int64)])

    seed = "grp long, member int, block long, bound long"
    order = Window.partitionBy("grp", "member").orderBy(F.desc("bound"), "block")
    seeds = _meet(groups, pages, d, first, seed).withColumn("n", F.row_number().over(order)).where(F.col("n") <= FIRST)
    needs = seeds.groupBy("grp", "block").agg(F.sort_array(F.collect_list("member")).alias("members"))

    hit = "grp long, member int, id long, score long"

    def same(r, members, scores, ids, labels):
        """The best rows of the anchor's label in a block, down to the anchor's bound where it has one."""
        own_ids, own_labels = _longs(r["ids"]), _longs(r["labels"])
        out: list[list] = [[], [], []]
        for m, s in zip(members, scores, strict=True):
            ok = (labels == own_labels[m]) & (ids != own_ids[m])
            if r.get("least") is not None and r["least"][m] is not None:
                ok &= s >= r["least"][m]
            at = np.flatnonzero(ok)
            at = at[_best(s[at], ids[at], positives)]
            out[0].append(np.full(len(at), m, np.int32))
            out[1].append(ids[at])
            out[2].append(s[at].astype(np.int64))
        who, found, score = (np.concatenate(c) for c in out)
        return _batch(hit, [np.full(len(who), r["grp"]), who, found, score])

    def ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
        best = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def per_group(found: DataFrame, name: str, value) -> DataFrame:
        """``groups`` with a map from member to ``value`` in a column ``name``."""
        maps = found.groupBy("grp").agg(F.map_from_entries(F.collect_list(F.struct("member", value))).alias("m"))
        places = F.transform(F.sequence(F.lit(0), F.size("x") - 1), lambda k: F.try_element_at("m", k))
        return groups.join(maps, "grp", "left").withColumn(name, places).drop("m")

    tops = ranked(_read(needs, groups, blocks, d, same, hit), ["grp", "member"], positives)
    fifth = tops.where(F.col("rank") == positives).select("grp", "member", "score")
    bounded = checkpointed(per_group(fifth, "least", F.col("score")))

    def reach(r, low, high, zones):
        """Blocks of the anchor's label whose upper bound reaches what the anchor has."""
        least = np.array([-np.inf if v is None else float(v) for v in r["least"]])
        return members_of(r, has(_longs(r["labels"]), zones, False) & (high.astype(np.float64) * (1 + 1e-12) + 1 >= least[:, None]), zones)

    def members_of(r, wanted: np.ndarray, zones):
        at = np.flatnonzero(wanted.any(axis=0))
        lists = [np.flatnonzero(wanted[:, k]).astype(np.int32) for k in at]
        names = np.array([zones[k]["block"] for k in at], np.int64)
        return _batch(need, [np.full(len(at), r["grp"]), names, pa.array(lists, pa.list_(pa.int32()))])

    found = _read(_meet(bounded, pages, d, reach, need), bounded, blocks, d, same, hit)
    near = checkpointed(ranked(found, ["grp", "member"], positives))
    listed = near.groupBy("grp", "member").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("near"))
    asking = checkpointed(per_group(listed, "near", F.col("near")))
    floor, ceiling = window

    def edges(r, m) -> list[tuple[int, int, int, int]]:
        """Rank, score, least and greatest admitted score of each positive of a member."""
        near = r["near"][m] or []
        return [(p["rank"], p["score"], -(-floor * p["score"] // 100), ceiling * p["score"] // 100) for p in near]

    def windows(r, low, high, zones):
        """Blocks with another label whose interval meets a window of the anchor."""
        wanted = np.zeros(low.shape, bool)
        for m in range(len(low)):
            for _, _, least, most in edges(r, m):
                if least <= most:
                    wanted[m] |= (high[m] >= least) & (low[m] <= most)
        return members_of(r, wanted & has(_longs(r["labels"]), zones, True), zones)

    miss = "grp long, member int, slot int, id long, score long"

    def other(r, members, scores, ids, labels):
        own_ids, own_labels = _longs(r["ids"]), _longs(r["labels"])
        out: list[list] = [[], [], [], []]
        for m, s in zip(members, scores, strict=True):
            spans = edges(r, m)
            at = np.flatnonzero((labels != own_labels[m]) & (ids != own_ids[m]) & (s >= min(e[2] for e in spans)))
            at = at[np.lexsort((ids[at], -s[at]))]
            falling = -s[at]
            for slot, _, least, most in spans:
                a = np.searchsorted(falling, -most, "left")
                hits = at[a:a + negatives]
                hits = hits[s[hits] >= least] if least <= most else hits[:0]
                out[0].append(np.full(len(hits), m, np.int32))
                out[1].append(np.full(len(hits), slot, np.int32))
                out[2].append(ids[hits])
                out[3].append(s[hits].astype(np.int64))
        who, slot, found, score = (np.concatenate(c) for c in out)
        return _batch(miss, [np.full(len(who), r["grp"]), who, slot, found, score])

    far = ranked(_read(_meet(asking, pages, d, windows, need), asking, blocks, d, other, miss), ["grp", "member", "slot"], negatives)
    anchor_ids = spark.read.parquet(f"{folder}/anchors").mapInArrow(
        lambda batches: (pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(i), g)), pa.array(np.arange(len(i), dtype=np.int32)), pa.array(i)], ["grp", "member", "anchor_id"])
            for b in batches for g, i in zip(b.column(0).to_pylist(), map(_longs, b.column(1).to_pylist()), strict=True)),
        "grp long, member int, anchor_id long")
    positive = near.select("grp", "member", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return checkpointed(
        far.withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score")
        .join(positive, ["grp", "member", "slot"]).join(anchor_ids, ["grp", "member"])
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
