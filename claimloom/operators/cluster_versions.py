"""Versions of clusters that are kept up by what changes.

A version covers a cluster's members (with scores to three decimals) and the states of the conflicts at them. Both are sums of hashes over a
multiset, so rows that come add to them and rows that go subtract: a batch of changes touches the clusters it names and reads no others' members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sums of 48-bit hashes stay exact far beyond any cluster's size.
SUM = "decimal(38,0)"
STATE = ["cluster_key", "n_members", "member_sum", "meaning_sum", "version", "last_change"]


def _hash(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12), 16, 10).cast(SUM)


def member_hash() -> Column:
    return _hash(F.col("claim_id"), F.format_string("%.3f", "score"))


def conflict_hash() -> Column:
    return _hash(F.col("conflict_id"), F.col("status"), F.col("severity"))


def _meaning(members: DataFrame, ends: DataFrame, sign: Column) -> DataFrame:
    """cluster_key, meaning: each conflict state at a member's claim, with a sign."""
    marks = ends.select("claim_id", conflict_hash().alias("_mark"))
    return members.join(marks, "claim_id").select("cluster_key", (sign * F.col("_mark")).cast(SUM).alias("meaning"))


def _sums(rows: DataFrame) -> DataFrame:
    """Sums per cluster of n, member and meaning; aggregated before and after the shuffle."""
    return rows.groupBy("cluster_key").agg(*[F.sum(c).cast(SUM).alias(f"_{c}") for c in ("n", "member", "meaning")])


def _parts(members: DataFrame, meaning: DataFrame, sign: Column) -> DataFrame:
    zero = F.lit(0).cast(SUM)
    return members.select("cluster_key", sign.cast(SUM).alias("n"), (sign * member_hash()).cast(SUM).alias("member"), zero.alias("meaning")).union(
        meaning.select("cluster_key", zero, zero, "meaning"))


def _versioned(rows: DataFrame) -> Column:
    return F.sha2(F.concat_ws("|", "cluster_key", F.col("member_sum").cast("string"), F.col("meaning_sum").cast("string")), 256)


def cluster_state(members: DataFrame, ends: DataFrame, as_of: Column) -> DataFrame:
    """The state of all clusters from scratch.

    ``members``: cluster_key, claim_id, score; ``ends``: a row for each claim of a conflict (conflict_id, claim_id, status, severity).
    """
    one = F.lit(1)
    rows = _sums(_parts(members, _meaning(members, ends, one), one))
    rows = rows.select("cluster_key", F.col("_n").cast("long").alias("n_members"), F.col("_member").alias("member_sum"), F.col("_meaning").alias("meaning_sum"))
    return rows.withColumn("version", _versioned(rows)).withColumn("last_change", as_of)


def update_state(
    state: DataFrame, members_before: DataFrame, ends_after: DataFrame, came: DataFrame, went: DataFrame, ends_came: DataFrame, ends_went: DataFrame, as_of: Column
) -> DataFrame:
    """The new state with ``change`` (new, changed, unchanged or superseded), and ``last_change`` kept where the version is.

    ``came`` and ``went`` are the member rows that changed (a new score is both), ``ends_came`` and ``ends_went`` those of conflicts. The changed
    meaning is that of changed members with the conflicts as they are now, and of members as they were with changed conflicts. A cluster
    of fewer than two members is none (superseded, or not yet there); it is kept while it has one.
    """
    one, minus = F.lit(1), F.lit(-1)
    delta = _sums(
        _parts(came, _meaning(came, ends_after, one), one)
        .union(_parts(went, _meaning(went, ends_after, minus), minus))
        .union(_parts(members_before.limit(0), _meaning(members_before, ends_came, one).union(_meaning(members_before, ends_went, minus)), one))
    )
    before = state.select("cluster_key", F.col("n_members").alias("_n0"), F.col("member_sum").alias("_m0"), F.col("meaning_sum").alias("_c0"),
                          F.col("version").alias("_v0"), F.col("last_change").alias("_t0"))
    rows = before.join(delta, "cluster_key", "full")
    add = lambda old, new: (F.coalesce(old, F.lit(0)).cast(SUM) + F.coalesce(new, F.lit(0)).cast(SUM)).cast(SUM)
    rows = rows.select(
        "cluster_key", add("_n0", "_n").cast("long").alias("n_members"), add("_m0", "_member").alias("member_sum"), add("_c0", "_meaning").alias("meaning_sum"),
        "_n0", "_v0", "_t0")
    rows = rows.withColumn("version", _versioned(rows))
    same = F.col("version").eqNullSafe(F.col("_v0"))
    was, now = F.coalesce(F.col("_n0"), F.lit(0)) > 1, F.col("n_members") > 1
    change = (
        F.when(was & ~now, F.lit("superseded")).when(now & ~was, F.lit("new")).when(now & ~same, F.lit("changed")).when(now, F.lit("unchanged"))
    )
    return rows.select("cluster_key", "n_members", "member_sum", "meaning_sum", "version", F.when(same, F.col("_t0")).otherwise(as_of).alias("last_change"), change.alias("change"))


def next_state(updated: DataFrame) -> DataFrame:
    """What the next update starts from: clusters that still have a member."""
    return updated.where("n_members > 0").select(*STATE)
