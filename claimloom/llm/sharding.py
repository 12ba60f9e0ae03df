"""Extendible hashing: shards of bounded size by prefixes of a key's hash.

The directory starts with one bucket (zero prefix bits). Only buckets above the byte
limit split, on one more bit, until each fits. A bucket whose rows all share one hash
cannot be split and stays as it is (``oversized``): that is a single huge document, or
rows that repeat one key.

The directory is worked out on a histogram of hash prefixes a few bits deeper than the
data needs on average, so its size follows the number of shards and not of rows. The few
prefixes that are still too large there are split further on their full hashes. Rows
find their shard by an equi-join on the prefix; hashing spreads rows evenly, so no join
key is hot unless one key repeats.

Defined results: null text counts 0 bytes; null keys hash like an empty string; repeated
rows go to one shard; a text longer than the limit is a shard of its own; an empty table gives an empty result; other
columns pass through, of any name but shard, shard_depth and row_bytes, which are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import unused

HASH_BITS = 60
LIMIT = 16 << 20


def key_hash(key: Column) -> Column:
    """60 bits of the MD5 of the key's text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _leaves(histogram: DataFrame, bits: int, start: int, limit: int) -> DataFrame:
    """For each ``prefix`` of ``bits`` bits the least depth >= start at which its bucket is final.

    ``depth`` is null where no depth up to ``bits`` will do.
    """
    steps = F.explode(F.sequence(F.lit(start), F.lit(bits))).alias("depth")
    above = histogram.select("prefix", "bytes", "low", "high", steps).withColumn(
        "bucket", F.expr(f"shiftright(prefix, {bits} - depth)")
    )
    sizes = above.groupBy("depth", "bucket").agg(
        F.sum("bytes").alias("size"), F.min("low").alias("first"), F.max("high").alias("last")
    )
    final = (F.col("size") <= limit) | (F.col("first") == F.col("last"))
    return (
        above.select("prefix", "depth", "bucket")
        .join(sizes, ["depth", "bucket"])
        .groupBy("prefix")
        .agg(F.min(F.when(final, F.col("depth"))).alias("depth"))
    )


def shard_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, spare_bits: int = 4
) -> DataFrame:
    """``docs`` with shard (the prefix bits as a string), shard_depth and row_bytes."""
    rest = [c for c in docs.columns if c not in ("shard", "shard_depth", "row_bytes")]
    hash_, prefix_, coarse_, fine_, bytes_ = (unused(docs, c) for c in ("hash", "prefix", "coarse", "fine", "bytes"))
    hashed = docs.withColumns({hash_: key_hash(F.col(key)), bytes_: F.coalesce(F.octet_length(text), F.lit(0)).cast("long")})
    total = hashed.agg(F.sum(bytes_)).first()[0] or 0
    bits = min(HASH_BITS, max(1, math.ceil(math.log2(max(1.0, total / limit)))) + spare_bits)

    def histogram(rows: DataFrame, n: int) -> DataFrame:
        return rows.groupBy(F.shiftright("hash", HASH_BITS - n).alias("prefix")).agg(
            F.sum("bytes").alias("bytes"), F.min("hash").alias("low"), F.max("hash").alias("high")
        )

    measured = hashed.select(F.col(hash_).alias("hash"), F.col(bytes_).alias("bytes"))
    coarse = _leaves(histogram(measured, bits), bits, 0, limit)
    # prefixes too large at that depth: split on, each distinct hash being a row now
    large = coarse.where("depth is null").select("prefix")
    inside = measured.withColumn("prefix", F.shiftright("hash", HASH_BITS - bits)).join(large, "prefix", "left_semi")
    fine = _leaves(histogram(inside, HASH_BITS), HASH_BITS, bits + 1, limit)
    found = (
        hashed.withColumn(prefix_, F.shiftright(hash_, HASH_BITS - bits))
        .join(coarse.select(F.col("prefix").alias(prefix_), F.col("depth").alias(coarse_)), prefix_, "left")
        .join(fine.select(F.col("prefix").alias(hash_), F.col("depth").alias(fine_)), hash_, "left")
    )
    depth = F.coalesce(coarse_, fine_).cast("int")
    bits_text = F.when(depth == 0, F.lit("")).otherwise(
        F.lpad(F.bin(F.call_function("shiftright", F.col(hash_), F.lit(HASH_BITS) - depth)), depth, F.lit("0"))
    )
    return found.select(*rest, bits_text.alias("shard"), depth.alias("shard_depth"), F.col(bytes_).alias("row_bytes"))


def shard_directory(sharded: DataFrame) -> DataFrame:
    """One row per shard: depth, rows and bytes."""
    return sharded.groupBy("shard", "shard_depth").agg(
        F.count("*").alias("n_rows"), F.sum("row_bytes").alias("n_bytes")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard. A shard is within the byte limit, so one task writes it."""
    sharded.repartition("shard").write.partitionBy("shard_depth", "shard").parquet(path)
