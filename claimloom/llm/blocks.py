"""Documents dealt into blocks of bounded bytes, for operators that compare windows.

A block is a group of whole documents, chosen by a hash of the row, of a few MB of
text. Inside one task a block is a byte buffer that numpy works on. What blocks have to
tell each other about windows travels as packed arrays under a hash bucket:

1. every block sends short fingerprints of its windows to buckets; each bucket answers with one
   bit per fingerprint, set if another block has it too (``seen_elsewhere``);
2. only windows with that bit are sent in full; the bucket decides which of them occur
   earlier elsewhere and answers with the intervals to remove.

The exchange that deals the text out is one plan node used three times, so Spark shuffles
the text once. Numbers of blocks and buckets follow the bytes of the table; sizes of
groups do not. Within a block only the first occurrence of a window is ever sent, so a
passage found in a third of all documents leaves each block once. What many blocks send to one
bucket is compared in ranges of ``FAN_IN`` blocks first, as often as there are more ranges than that
(``narrowed``): only the first occurrence in a range goes on, so no bucket meets a window more than FAN_IN
times. Rows equal in key and text, which no hash of the row can part, are counted beforehand and enter once.
Larger tables want larger blocks (``block_bytes``), as far as a task's memory goes: every block sends
every bucket a row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import checkpointed

#: Blocks whose windows meet in one group of a bucket.
FAN_IN = 4096
#: Distinct repeated rows that are looked up by broadcast (24 bytes each); more are joined.
MAX_BROADCAST = 100_000
#: Copies of one row that one step writes out.
COPIES = 10_000
#: Stands for a null document id: it sorts before every other.
NULL_ID = -(2**63)
ODD = 0x9E3779B97F4A7C15
U64 = np.uint64
FINGERPRINTS = "bucket int, block long, prints binary"
FLAGS = "block long, bucket int, flags binary"


def parted(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """(each row once, with its number of copies; those of them there several times, or None).

    Rows are counted by a 128-bit hash, map-side; the texts of those that repeat alone move, also combined map-side.
    """
    rows = docs.select(F.col(key), F.col(text))
    named = rows.withColumns({"_a": F.xxhash64(key, text), "_b": F.xxhash64(F.lit(1), text, key)})
    counts = named.groupBy("_a", "_b").agg(F.count("*").alias("n")).where("n > 1").select("_a", "_b")
    counts = checkpointed(counts)
    n = counts.count()
    if not n:
        return rows.withColumn("copies", F.lit(1).cast("long")), None
    many = F.broadcast(counts) if n <= MAX_BROADCAST else counts
    repeated = checkpointed(
        named.join(many, ["_a", "_b"], "left_semi").groupBy(key, text).agg(F.count("*").alias("copies"))
    )
    once = named.join(many, ["_a", "_b"], "left_anti").select(key, text, F.lit(1).cast("long").alias("copies"))
    return once.union(repeated), repeated.where("copies > 1")


def copied(rows: DataFrame, copies: str) -> DataFrame:
    """Each row as often as ``copies`` says, many copies in steps that several tasks share."""
    steps = F.explode(F.sequence(F.lit(0), F.floor((F.col(copies) - 1) / COPIES)))
    dealt = rows.withColumn("_step", steps).repartition(F.col("_step"), F.col(rows.columns[0]))
    size = F.least(F.lit(COPIES), F.col(copies) - F.col("_step") * COPIES)
    return dealt.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), size))).drop("_step", "_copy", copies)


def block_count(docs: DataFrame, text: str, block_bytes: int) -> tuple[int, int]:
    """The bytes of text in all, and the number of blocks to deal them into."""
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return total, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / block_bytes), 1)


def block_of(place: Column, n: int) -> Column:
    """The block of a row by its place, a hash of 63 bits: the n ranges of places."""
    return F.shiftright(F.shiftright(place, 32) * F.lit(n).cast("long"), 31)


def dealt(docs: DataFrame, key: str, text: str, block_bytes: int) -> tuple[DataFrame, int, int]:
    """(block, doc, place, body, copies) rows, the bytes of text in all and the number of blocks.

    Rows of one key are ordered by place, a hash of the row; blocks are its ranges, so the order does not depend
    on their number.
    """
    total, n = block_count(docs, text, block_bytes)
    place = F.shiftrightunsigned(F.xxhash64(key, text), 1)
    rows = docs.select(
        block_of(place, n).alias("block"),
        F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("doc"),
        place.alias("place"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"),
        "copies",
    )
    return rows, total, n


def narrowed(sent: DataFrame, n_blocks: int, fan_in: int, compared, schema: str) -> DataFrame:
    """What blocks sent, after comparing it by bucket and range of blocks until at most ``fan_in`` ranges are left."""
    reach = 1
    while n_blocks > reach * fan_in:
        reach *= fan_in
        ranges = F.floor(F.col("block") / reach)
        sent = sent.groupBy("bucket", ranges).applyInArrow(compared, schema)
    return sent


def bucket_bits(docs: DataFrame, items: float, per_bucket: int) -> int:
    """Bits for as many buckets as keep about ``per_bucket`` items in each."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, math.ceil(math.log2(max(least, items / per_bucket, 2))))


def block_rows(table: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """Ids and texts of a block, in an order that depends on nothing but the rows."""
    rows = ordered(table)
    return np.array([r[0] for r in rows], np.int64), [r[2] for r in rows]


def ordered(table: pa.Table) -> list[tuple]:
    """(doc, place, body, copies) of a block's rows, in order."""
    return sorted(zip(*[table.column(c).to_pylist() for c in ("doc", "place", "body", "copies")], strict=True))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def rolled(values: np.ndarray, width: int, base: int = ODD) -> np.ndarray:
    """Rabin-Karp hash, modulo 2**64, of every ``width`` consecutive values.

    Built from hashes of power-of-two spans, so it takes log2(width) vector passes.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, span, level = None, 0, 1, values
    while True:
        if width & span:
            part = level[done : done + n]
            out = part.copy() if out is None else out * U64(pow(base, span, 1 << 64)) + part
            done += span
        if done == width:
            return out
        level = level[:-span] * U64(pow(base, span, 1 << 64)) + level[span:]
        span *= 2


def packed_by_bucket(buckets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets present in a sorted array, and where each one's slice starts (plus the end)."""
    starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]]) if n else np.empty(0, np.int64)
    return buckets[starts], np.r_[starts, n]


def to_table(schema: pa.Schema, **columns) -> pa.Table:
    return pa.table({f.name: pa.array(columns[f.name], f.type) for f in schema}, schema=schema)


PRINTS_SCHEMA = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("prints", pa.binary())])
FLAGS_SCHEMA = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("flags", pa.binary())])


def short_prints(hashes: np.ndarray, bits: int, width: int) -> np.ndarray:
    """The distinct leading ``bits + 8 * width`` bits of hashes, sorted."""
    return np.unique(hashes >> U64(64 - bits - 8 * width))


def prints_table(block: int, hashes: np.ndarray, bits: int, width: int) -> pa.Table:
    """A block's distinct short fingerprints, ``width`` bytes each, by bucket."""
    prints = short_prints(hashes, bits, width)
    names, cuts = packed_by_bucket((prints >> U64(8 * width)).astype(np.int32), len(prints))
    low = prints.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return to_table(
        PRINTS_SCHEMA,
        bucket=names,
        block=np.full(len(names), block, np.int64),
        prints=[low[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)],
    )


def seen_elsewhere(prints: DataFrame, width: int) -> DataFrame:
    """For each block and bucket one bit per fingerprint: set if two blocks sent it."""

    def answer(key, table):
        parts = [np.frombuffer(x, np.uint8).reshape(-1, width) for x in table.column("prints").to_pylist()]
        wide = np.zeros((sum(map(len, parts)), 4), np.uint8)
        wide[:, :width] = np.concatenate(parts)
        values = wide.view("<u4").ravel()
        order = np.argsort(values, kind="stable")
        ranked = values[order]
        same = ranked[1:] == ranked[:-1]
        often = np.zeros(len(values), bool)
        often[order] = np.r_[same, False] | np.r_[False, same]
        cuts = np.cumsum([0, *map(len, parts)])
        flags = [often[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        some = [i for i, f in enumerate(flags) if f.any()]
        blocks = table.column("block").to_pylist()
        return to_table(
            FLAGS_SCHEMA,
            block=[blocks[i] for i in some],
            bucket=[key[0].as_py()] * len(some),
            flags=[np.packbits(flags[i]).tobytes() for i in some],
        )

    return prints.groupBy("bucket").applyInArrow(answer, FLAGS)


def flagged(hashes: np.ndarray, answers: pa.Table, bits: int, width: int) -> np.ndarray:
    """For each of a block's hashes: did another block send its fingerprint?"""
    prints, at = np.unique(hashes >> U64(64 - bits - 8 * width), return_inverse=True)
    names, cuts = packed_by_bucket((prints >> U64(8 * width)).astype(np.int32), len(prints))
    where = {b: (x, y) for b, x, y in zip(names.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)}
    often = np.zeros(len(prints), bool)
    for b, f in zip(answers.column("bucket").to_pylist(), answers.column("flags").to_pylist(), strict=True):
        x, y = where[b]
        often[x:y] = np.unpackbits(np.frombuffer(f, np.uint8), count=y - x).astype(bool)
    return often[at.ravel()]


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open intervals as maximal runs (touching ones join)."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.r_[True, s[1:] > e[:-1]])
    return s[new], e[np.r_[new[1:] - 1, len(e) - 1]]


def runs(positions: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Union of the windows [p, p + width) of sorted positions."""
    return merged(positions, positions + width)


def u32(values) -> bytes:
    return np.asarray(values).astype("<u4").tobytes()


def from_u32(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4").astype(np.int64)


def intervals_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All intervals that answers to one block hold, merged."""
    starts = [from_u32(x) for x in table.column("starts").to_pylist()]
    ends = [from_u32(x) for x in table.column("ends").to_pylist()]
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return merged(np.concatenate(starts), np.concatenate(ends))
