"""Near copies by exact Jaccard similarity of word shingles, found by prefix filtering.

Texts link if the sets of their five-word shingles have a Jaccard similarity of at least
4/5, and groups are the connected components of the links. A fingerprint cannot decide this: at
that similarity SimHashes differ in about ten bits of 64, too many for pigeonhole blocks.

Similar sets share at least four fifths of either one. So under any order of the shingles that
is the same for all texts, they share one among the first ``n - ceil(4n/5) + 1`` of each.
Texts meet at these shingles, and the exact overlap decides. Shingles that one text alone has come first: blocks of
texts tell each other by short fingerprints which are found elsewhere (``blocks``). So a text with a fifth of
its own meets no other, whatever passages it shares. Of the rest, shingles in many texts come last.
The order decides about work only, never about results.

Candidates are compared in two steps. A sketch of each set, its shingles counted in about as many slots as there are
shingles, tells most pairs apart: the counts of similar sets differ by no more than the sets do, at most a
ninth of both sizes. Only for the rest are the sets made again from the texts and intersected.

Equal sets count once. At a shingle where more than ``PAIR_LIMIT`` sets meet, all are first compared
with the one whose shingles are most widely shared (for copies of one text, nearest to the original), and
then only pairs that are not yet in one group are compared. Such pairs grow with the square of
their number where many texts share their rarest shingles without being near copies.

Defined results: upper and lower case of ASCII are equal; a text without words (or null) has
an empty set, and all those are one group; fewer words than a shingle form one shingle; of a
group the row with the least key stays (null last), of equal rows one; columns of any name pass through; an empty
table gives an empty result; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm import blocks as B
from claimloom.llm.common import checkpointed, forget
from claimloom.llm.components import connected_components

SEED = 42
PAIR_LIMIT = 32
BLOCK_BYTES, PER_BUCKET, PRINT_BYTES = 2 << 20, 1 << 20, 3
#: Shingles are counted in so many slots; rows to be looked at again are told apart by as many.
SLOTS = 1 << 18
#: Slots whose counts are packed in one row.
PART = 1 << 14


def shingle_set(body: bytes, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    words = body.lower().split()
    if not words:
        return np.empty(0, np.int64)
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    n = max(1, len(words) - shingle + 1)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n).view(np.int64))


def sketch(shingles: np.ndarray) -> bytes:
    """Counts of the shingles by their low bits; empty where one does not fit a byte."""
    size = 1 << max(4, (len(shingles) // 2).bit_length())
    counts = np.bincount(shingles & (size - 1), minlength=size)
    return b"" if counts.max() > 255 else counts.astype(np.uint8).tobytes()


def may_be_similar(a: bytes, b: bytes, size_a: int, size_b: int) -> bool:
    """Whether sets of these sketches and sizes can have a similarity of 4/5."""
    if not a or not b:
        return True
    width = min(len(a), len(b))
    one, two = (np.frombuffer(x, np.uint8).reshape(-1, width).sum(axis=0, dtype=np.int64) for x in (a, b))
    return 9 * int(np.abs(one - two).sum()) <= size_a + size_b


def _body(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def _levels(docs: DataFrame, text: str, shingle: int) -> np.ndarray:
    """How full each slot is, as a power of two; zero up to twice the mean."""

    def count(batches):
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            sets = [shingle_set(bytes(body), shingle) for body in batch["body"]]
            if sets:
                counts += np.bincount(np.concatenate(sets) % SLOTS, minlength=SLOTS)
        slots = np.flatnonzero(counts)
        yield pd.DataFrame({"slot": slots, "n": counts[slots]})

    def packed(key, table):
        counts = np.zeros(PART, np.int64)
        counts[table.column("slot").to_numpy() % PART] = table.column("n").to_numpy()
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "counts": pa.array([counts.tobytes()])})

    sums = docs.select(_body(text).alias("body")).mapInPandas(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    # a few rows of packed counts come to the driver, whatever the table
    parts = sums.groupBy(F.floor(F.col("slot") / PART).alias("part")).applyInArrow(packed, "part long, counts binary").collect()
    n = np.zeros(SLOTS, np.int64)
    for part in parts:
        n[part["part"] * PART : (part["part"] + 1) * PART] = np.frombuffer(part["counts"], np.int64)
    level = np.zeros(SLOTS, np.uint8)
    full = n > 2 * n[n > 0].mean() if n.any() else np.zeros(SLOTS, bool)
    level[full] = np.ceil(np.log2(n[full]))
    return level


def _first_shingles(docs: DataFrame, key: str, text: str, shingle: int, level: np.ndarray) -> DataFrame:
    """Each row (key, version, copies) with its set as a digest (node), a size and a sketch, and those of its first shingles that
    other texts have too (tokens, at their places in the order)."""
    once, _ = B.parted(docs, key, text)
    total, n_blocks = B.block_count(once, text, BLOCK_BYTES)
    bits = B.bucket_bits(once, total / 6, PER_BUCKET)
    place = F.shiftrightunsigned(F.xxhash64(key, text), 1)
    rows = once.select(
        B.block_of(place, n_blocks).alias("block"), F.col(key).alias("key"), F.xxhash64(text).alias("version"), "copies", _body(text).alias("body")
    )

    def sets_of(table: pa.Table) -> list[np.ndarray]:
        return [shingle_set(bytes(x), shingle) for x in table.column("body").to_pylist()]

    def prints(key, table):
        return B.prints_table(key[0].as_py(), np.concatenate(sets_of(table)).view(np.uint64), bits, PRINT_BYTES)

    def first(key, table, answers):
        sets = sets_of(table)
        every = np.concatenate(sets) if sets else np.empty(0, np.int64)
        _, at, count = np.unique(every, return_inverse=True, return_counts=True)
        shared = (count[at.ravel()] > 1) | B.flagged(every.view(np.uint64), answers, bits, PRINT_BYTES)
        out: dict[str, list] = {c: [] for c in ("node", "n", "sketch", "at", "tokens")}
        base = 0
        for s in sets:
            own = shared[base : base + len(s)]
            base += len(s)
            order = np.lexsort((s, level[s % SLOTS], own))[: len(s) - -(-4 * len(s) // 5) + 1]
            met = np.flatnonzero(own[order])
            out["node"].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            out["n"].append(len(s))
            out["sketch"].append(sketch(s) if len(met) else b"")
            out["at"].append(met)
            out["tokens"].append(s[order[met]])
        kept = [table.column(c) for c in ("key", "version", "copies")]
        types = [("node", pa.binary()), ("n", pa.int32()), ("sketch", pa.binary()), ("at", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int64()))]
        return pa.table([*kept, *[pa.array(out[c], t) for c, t in types]], ["key", "version", "copies", *out])

    kind = once.schema[key].dataType.simpleString()
    schema = f"key {kind}, version long, copies long, node binary, n int, sketch binary, at array<int>, tokens array<long>"
    often = B.seen_elsewhere(rows.groupBy("block").applyInArrow(prints, B.FINGERPRINTS), PRINT_BYTES)
    return rows.groupBy("block").cogroup(often.groupBy("block")).applyInArrow(first, schema)


def _slot(key: str, version: str) -> Column:
    return F.pmod(F.xxhash64(key, version), F.lit(SLOTS))


def _in_slots(rows: DataFrame, slot: Column) -> Column:
    """Whether a slot is one of the rows' (_key, _of). There are ``SLOTS`` slots, so all of them are a few KB."""
    value = _slot("_key", "_of") + 1
    maps = rows.groupBy(F.bitmap_bucket_number(value).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("bits")).collect()
    packed = np.zeros(SLOTS // 8, np.uint8)
    for part in maps:  # 32,768 slots each
        packed[(part["part"] - 1) * 4096 : part["part"] * 4096] = np.frombuffer(part["bits"], np.uint8)

    @F.pandas_udf("boolean")
    def among(slots: pd.Series) -> pd.Series:
        at = slots.to_numpy(np.int64)
        return pd.Series((packed[at >> 3] >> (at & 7)) & 1 == 1)

    # evaluated where it is written: pushed below a join it could not run
    return among.asNondeterministic()(slot)


def _may_meet() -> Column:
    """Whether the sets a and b can be similar if the shingle at hand is their first common one."""
    left = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at"))
    return 9 * left >= 4 * (F.col("a.n") + F.col("b.n"))


class _Texts:
    """Rows (key, version, body) with their text, from which the sets of a few are made again when they are needed."""

    def __init__(self, named: DataFrame, rows: DataFrame, firsts: DataFrame, shingle: int):
        self.named, self.rows, self.firsts, self.shingle = named, rows, firsts, shingle

    def sets(self, nodes: DataFrame) -> DataFrame:
        shingle = self.shingle

        @F.pandas_udf("array<long>")
        def of(bodies: pd.Series) -> pd.Series:
            return pd.Series([shingle_set(bytes(x), shingle) for x in bodies])

        wanted = checkpointed(nodes.join(self.firsts.hint("merge"), "node").select("node", F.col("first.id").alias("_key"), F.col("first.version").alias("_of")))
        rows = self.named.where(_in_slots(wanted, _slot("key", "version")))
        rows = rows.select("key", "version", of(_body("body")).alias("shingles"))
        same = rows["key"].eqNullSafe(wanted["_key"]) & (rows["version"] == wanted["_of"])
        found = checkpointed(rows.join(wanted.hint("merge"), same).select("node", "shingles"))
        forget(found.sparkSession)
        return found

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The (a, b) pairs whose sets have a similarity of at least 4/5."""

        @F.pandas_udf("boolean")
        def near(a: pd.Series, b: pd.Series, size_a: pd.Series, size_b: pd.Series) -> pd.Series:
            return pd.Series([may_be_similar(*x) for x in zip(a, b, size_a, size_b, strict=True)], dtype=bool)

        pairs = checkpointed(pairs.distinct())
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        known = self.rows.where(F.size("tokens") > 0).select("node", "n", "sketch").join(nodes.hint("merge"), "node", "left_semi").groupBy("node").agg(
            F.first("n").alias("n"), F.first("sketch").alias("sketch")
        )
        known, rows = checkpointed(known), pairs
        for side in ("a", "b"):
            rows = rows.join(known.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}")).hint("merge"), side)
        pairs = checkpointed(rows.where(near("sa", "sb", "na", "nb")).select("a", "b"))
        forget(pairs.sparkSession)
        if pairs.isEmpty():
            return pairs
        sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        rows = pairs
        for side in ("a", "b"):
            rows = rows.join(sets.select(F.col("node").alias(side), F.col("shingles").alias(f"s{side}")).hint("merge"), side)
        # |A and B| / |A or B| >= 4/5 in whole numbers
        enough = 9 * F.size(F.array_intersect("sa", "sb")) >= 4 * (F.size("sa") + F.size("sb"))
        return rows.where(enough).select("a", "b").distinct()


def similar_links(prefixes: DataFrame, texts: _Texts, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """(a, b) edges between sets (node, n, first: at and tokens) that keep the components of all links."""
    tokens = prefixes.select("node", "n", F.inline(F.arrays_zip(F.col("first.at").alias("at"), F.col("first.tokens").alias("token"))))
    met = F.count("*").over(Window.partitionBy("token"))
    meeting = checkpointed(tokens.withColumn("met", met).where("met > 1"))
    small, large = meeting.where(F.col("met") <= pair_limit), meeting.where(F.col("met") > pair_limit)
    both = [F.col("a.node").alias("a"), F.col("b.node").alias("b")]
    pairs = small.alias("a").join(small.alias("b").hint("merge"), "token").where((F.col("a.node") < F.col("b.node")) & _may_meet()).select(*both)
    shared = large.groupBy("node").agg((F.sum("met") / F.first("n")).alias("shared"))
    hub = F.max(F.struct("shared", "node", "n", "at")).alias("h")
    hubs = large.join(shared.hint("merge"), "node").groupBy("token").agg(hub).select("token", "h.node", "h.n", "h.at")
    to_hub = large.alias("a").join(hubs.alias("b").hint("merge"), "token").where((F.col("a.node") != F.col("b.node")) & _may_meet())
    to_hub = to_hub.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b"))
    links = checkpointed(texts.verified(pairs.union(to_hub)))
    if large.isEmpty():
        return links
    groups = connected_components(links, "a", "b")
    named = large.join(groups.hint("merge"), "node", "left").withColumn("of", F.coalesce("component", "node"))
    mixed = named.groupBy("token").agg((F.min("of") != F.max("of")).alias("mixed")).where("mixed").select("token")
    open_ = checkpointed(named.join(mixed.hint("merge"), "token"))
    rest = open_.alias("a").join(open_.alias("b").hint("merge"), "token").where(
        (F.col("a.node") < F.col("b.node")) & (F.col("a.of") != F.col("b.of")) & _may_meet()
    ).select(*both)
    return links.union(texts.verified(rest))


def keep_one_of_similar(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """The rows of ``docs`` that come first, by key, in their group; of equal rows one."""
    level = _levels(docs, text, shingle)
    named = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("key"), F.xxhash64(text).alias("version"), F.col(text).alias("body"))
    rows = checkpointed(_first_shingles(docs, key, text, shingle, level))
    forget(rows.sparkSession)
    place = F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("id"), "version")
    firsts = rows.groupBy("node").agg(F.min(place).alias("first"))
    # equal sets have equal first shingles, so any row's will do
    prefixes = rows.where(F.size("tokens") > 0).groupBy("node").agg(F.first("n").alias("n"), F.first(F.struct("at", "tokens")).alias("first"))
    groups = connected_components(similar_links(prefixes, _Texts(named, rows, firsts, shingle), pair_limit), "a", "b")
    grouped = firsts.join(groups.hint("merge"), "node", "left").select(F.coalesce("component", "node").alias("of"), "first")
    heads = grouped.groupBy("of").agg(F.min("first").alias("head")).select(F.col("head.id").alias("_key"), F.col("head.version").alias("_of"))
    heads = checkpointed(heads)
    forget(heads.sparkSession)
    # rows that are dropped, or there more than once: only rows in their slots are moved
    found = rows.join(heads.hint("merge"), rows["key"].eqNullSafe(heads["_key"]) & (rows["version"] == heads["_of"]), "left")
    doubted = found.where("_of is null or copies > 1").select(F.col("key").alias("_key"), F.col("version").alias("_of"))
    all_ = named.select("row", "key", "version", _in_slots(doubted, _slot("key", "version")).alias("doubtful"))
    doubtful = all_.where("doubtful").groupBy("key", "version").agg(F.first("row").alias("row"))
    kept = doubtful.join(heads.hint("merge"), doubtful["key"].eqNullSafe(heads["_key"]) & (doubtful["version"] == heads["_of"]), "left_semi")
    return all_.where("not doubtful").select("row.*").union(kept.select("row.*"))
