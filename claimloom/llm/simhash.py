"""Near-duplicate groups by SimHash fingerprints and pigeonhole blocks.

A text's fingerprint has 64 bits: bit i is set if more than half of the hashes (XXH64, seed
42) of its word shingles have it set. Texts link if their fingerprints differ in at most
``MAX_BITS`` = 2 bits, and groups are the connected components of the links.

Links are sought between distinct fingerprints, so copies cost nothing. The 64 bits are cut into
five blocks; two differing bits touch at most two, so linked fingerprints agree on at
least three of the five: each fingerprint takes part under the ten choices of three.
Within small candidate groups all pairs are verified by their Hamming distance. In a
large one (``pair_limit``) a fingerprint meets the others at midpoints instead: two
fingerprints differ in at most two bits exactly if they have a common string within
one bit of each. Every fingerprint sends itself and its 64 one-bit neighbours, and all that meet at
a string link to the least of them: the same components, with linear work, by plain
aggregation. Every link is verified by its Hamming distance.

Rows find their group by their fingerprint. Those of a fingerprint with more than ``HOT`` rows are dealt over ``SALTS``
keys, each with a copy of the fingerprint's line, so that many copies of a text are no hot key.

Defined results: a text without words (or null) has fingerprint zero and links like any
other; fewer words than a shingle form one shingle; null doc_id takes part and its group's
id is the smallest doc_id that is not null (null if none); equal rows are each given; texts of any length are read
whole; an empty table gives an empty result. ``keep_one_of_each`` passes columns of any name through.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import checkpointed
from claimloom.llm.components import connected_components

MAX_BITS = 2
BLOCKS = (13, 13, 13, 13, 12)
PAIR_LIMIT = 32
#: Rows of one fingerprint that may be one join key, and the keys that more of them share.
HOT, SALTS = 64, 64
SEED = 42
#: Shingles whose bits are counted at a time: bounds memory on very long texts.
CHUNK = 1 << 16


def _masks() -> list[int]:
    masks, low = [], 0
    for width in BLOCKS:
        masks.append(((1 << width) - 1) << low)
        low += width
    chosen = [sum(c) for c in combinations(masks, len(BLOCKS) - MAX_BITS)]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]  # as signed longs


def text_fingerprint(body: bytes, shingle: int) -> int:
    words = body.lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), ">u8", n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = hashes[at : at + CHUNK]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n).view(">i8")[0])


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """The fingerprint (long) of a string column."""

    @F.pandas_udf("long")
    def of(bodies: pd.Series) -> pd.Series:
        return pd.Series([text_fingerprint(bytes(x), shingle) for x in bodies], dtype="int64")

    return of(F.coalesce(text, F.lit("")).cast("binary"))


def fingerprint_hex(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def links(fingerprints: DataFrame, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """(a, b) edges between distinct fingerprints (column fp) that keep all links' components.

    Pairs of small candidate groups are verified one by one; members of large groups
    link to the least fingerprint that meets them at a midpoint.
    """
    masks = F.array(*[F.lit(m).cast("long") for m in _masks()])
    keyed = fingerprints.select("fp", F.posexplode(masks).alias("choice", "mask")).select(
        "fp", "choice", F.col("fp").bitwiseAND(F.col("mask")).alias("part")
    )
    sizes = keyed.groupBy("choice", "part").agg(F.count("*").alias("size")).where("size > 1")
    grouped = checkpointed(keyed.join(sizes, ["choice", "part"]))
    small = grouped.where(F.col("size") <= pair_limit)
    pairs = (
        small.select("choice", "part", F.col("fp").alias("a"))
        .join(small.select("choice", "part", F.col("fp").alias("b")), ["choice", "part"])
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS))
        .select("a", "b")
    )
    ones = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    flips = F.array(*[F.lit(x).cast("long") for x in (0, *ones)])
    meeting = grouped.where(F.col("size") > pair_limit).select("fp").distinct().select(
        "fp", F.explode(flips).alias("flip")
    ).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"))
    hubs = meeting.groupBy("middle").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1")
    met = meeting.join(hubs, "middle").where("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    return pairs.union(met.where(close)).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """Per row: key, _version (a hash of the text), fp, component_id, and whether it is the
    group's first row (``first``; equal rows share it)."""
    rows = checkpointed(
        docs.select(F.col(key), F.xxhash64(text).alias("_version"), fingerprint(F.col(text), shingle).alias("fp"))
    )
    place = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col("_version").alias("version"))
    distinct = checkpointed(rows.groupBy("fp").agg(F.min(place).alias("first"), F.count("*").alias("n")))
    groups = connected_components(links(distinct), "a", "b")
    linked = groups.join(distinct, groups["node"] == distinct["fp"]).select("node", "component", "first")
    heads = linked.groupBy("component").agg(F.min("first").alias("head"))
    heads = linked.join(heads, "component").select(F.col("node").alias("fp"), "head")
    every = distinct.join(heads, "fp", "left").select("fp", F.coalesce("head", "first").alias("head"), "n")
    found = _with_head(rows, checkpointed(every))
    return found.select(
        key, "_version", "fp", F.col("head.id").alias("component_id"), place.eqNullSafe(F.col("head")).alias("first")
    )


def _with_head(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """``rows`` (checkpointed, so that their numbers stay) with the head of their fingerprint (fp, head, n)."""
    hot = heads.where(F.col("n") > HOT).select("fp", "head", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    cold = dealt.join(hot.select("fp", "salt"), ["fp", "salt"], "left_anti").join(heads.where(F.col("n") <= HOT).select("fp", "head"), "fp")
    return dealt.join(hot, ["fp", "salt"]).select(*rows.columns, "head").union(cold.select(*rows.columns, "head"))


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """The rows of ``docs`` that come first, by key, in their group; of equal rows one."""
    first = (
        near_duplicates(docs, key, text, shingle)
        .where("first")
        .select(F.col(key).alias("_key"), F.col("_version").alias("_of"))
        .distinct()
    )
    once = docs.groupBy(F.col(key).alias("_own"), F.xxhash64(text).alias("_text")).agg(F.first(F.struct(*docs.columns)).alias("row"))
    kept = once.join(first, once["_own"].eqNullSafe(first["_key"]) & (once["_text"] == first["_of"]), "left_semi")
    return kept.select("row.*")
