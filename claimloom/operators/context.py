"""Conversation context: nearby messages, bounded threads, bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.text import is_system_message

NEARBY_SECONDS, BEFORE, AFTER = 1800, 5, 3
MAX_MESSAGES, MAX_CHARS = 50, 40_000


def dedupe_messages(messages: DataFrame) -> DataFrame:
    """The last arrival of each (channel, ts)."""
    last = Window.partitionBy("channel", "ts").orderBy(F.col("arrived").desc())
    return messages.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def top_level(messages: DataFrame) -> DataFrame:
    """Messages (thread_ts, subtype) outside threads that no system event wrote: those that stand near another."""
    return messages.where((F.coalesce("thread_ts", F.lit("")) == "") & ~is_system_message(F.col("subtype")))


def nearby_messages(
    messages: DataFrame, selected: DataFrame, seconds: int = NEARBY_SECONDS, before: int = BEFORE, after: int = AFTER
) -> DataFrame:
    """For each selected (channel, ts) its nearest messages on both sides within the window.

    Messages (channel, ts, message_id) meet a selected one in the time bucket of either or a
    neighbouring one, so the interval join is an equi-join with bounded fan-out.
    """
    bucket = lambda c: F.floor(F.col(c) / seconds)
    left = selected.select("channel", F.col("ts").alias("selected_ts"), F.col("message_id").alias("selected_id"))
    left = left.withColumn("b", F.explode(F.array(bucket("selected_ts") - 1, bucket("selected_ts"), bucket("selected_ts") + 1)))
    right = messages.select("channel", "ts", "message_id", bucket("ts").alias("b"))
    near = left.join(right, ["channel", "b"]).where(
        (F.abs(F.col("ts") - F.col("selected_ts")) <= seconds) & (F.col("ts") != F.col("selected_ts"))
    )
    near = near.withColumn("side", F.when(F.col("ts") < F.col("selected_ts"), F.lit("before")).otherwise(F.lit("after")))
    closest = Window.partitionBy("selected_id", "side").orderBy(
        F.abs(F.col("ts") - F.col("selected_ts")), "message_id"
    )
    ranked = near.withColumn("place", F.row_number().over(closest))
    limit = F.when(F.col("side") == "before", F.lit(before)).otherwise(F.lit(after))
    return ranked.where(F.col("place") <= limit).select("selected_id", "message_id", "side", "place")


def bound_thread(
    messages: DataFrame, max_messages: int = MAX_MESSAGES, max_chars: int = MAX_CHARS
) -> DataFrame:
    """Threads (thread_id, ts, content, role in root/selected/other) cut to both limits.

    Root and selected messages stay; half of the other places go to the earliest ones that
    fit, the rest to the latest. Returns per thread retained and omitted ts arrays and counts.
    """
    item = F.struct("ts", F.length("content").alias("chars"), F.col("role").isin("root", "selected").alias("must"))
    threads = messages.groupBy("thread_id").agg(F.array_sort(F.collect_list(item)).alias("all"))

    def take(rows, start, limit=None):
        def step(acc, m):
            fits = (acc["n"] < max_messages) & (acc["chars"] + m["chars"] <= max_chars)
            if limit is not None:
                fits = fits & (acc["added"] < limit)
            one = fits.cast("int")
            return F.struct(
                (acc["n"] + one).alias("n"), (acc["chars"] + m["chars"] * one).alias("chars"), (acc["added"] + one).alias("added"),
                F.when(fits, F.array_append(acc["kept"], m["ts"])).otherwise(acc["kept"]).alias("kept"),
            )

        return F.aggregate(rows, start, step)

    must = F.filter("all", lambda m: m["must"])
    chars = lambda rows: F.aggregate(rows, F.lit(0), lambda a, m: a + m["chars"])
    out = threads.select(
        "thread_id", "all", must.alias("must"), F.filter("all", lambda m: ~m["must"]).alias("rest"),
        F.size("all").alias("n_all"), chars(F.col("all")).alias("chars_all"),
    )
    seed = F.struct(
        F.size("must").alias("n"), chars(F.col("must")).alias("chars"), F.lit(0).alias("added"),
        F.transform("must", lambda m: m["ts"]).alias("kept"),
    )
    out = out.withColumn("early", take(F.col("rest"), seed, F.floor((F.lit(max_messages) - F.size("must")) / 2)))
    left = F.filter("rest", lambda m: ~F.array_contains(F.col("early.kept"), m["ts"]))
    out = out.withColumn("final", take(F.reverse(left), F.col("early")))
    cut = (F.col("n_all") > max_messages) | (F.col("chars_all") > max_chars)
    every = F.transform("all", lambda m: m["ts"])
    kept = F.when(cut, F.array_sort(F.col("final.kept"))).otherwise(every)
    return out.select(
        "thread_id",
        cut.alias("truncated"),
        (F.col("n_all") > max_messages).alias("message_limit"),
        (F.col("chars_all") > max_chars).alias("char_limit"),
        F.col("n_all").alias("n_messages"),
        F.when(cut, F.col("final.n")).otherwise(F.col("n_all")).alias("n_retained"),
        F.col("chars_all").alias("n_chars"),
        F.when(cut, F.col("final.chars")).otherwise(F.col("chars_all")).alias("chars_retained"),
        kept.alias("retained"),
        F.array_except(every, kept).alias("omitted"),
    )


def context_role(messages: DataFrame) -> DataFrame:
    """selected, thread_root, thread_reply or nearby (ts, selected_ts, root_ts, thread_ts)."""
    role = (
        F.when(F.col("ts") == F.col("selected_ts"), F.lit("selected"))
        .when(F.col("ts") == F.col("root_ts"), F.lit("thread_root"))
        .when(F.col("thread_ts").isNotNull(), F.lit("thread_reply"))
        .otherwise(F.lit("nearby"))
    )
    return messages.withColumn("context_role", role)


def selection_strategy(counts: DataFrame) -> DataFrame:
    """From n_thread_others and n_nearby_selected."""
    strategy = (
        F.when(F.col("n_thread_others") > 0, F.lit("thread"))
        .when(F.col("n_nearby_selected") > 0, F.lit("nearby"))
        .otherwise(F.lit("selected_only"))
    )
    return counts.withColumn("strategy", strategy)


def bundle_hash(items: DataFrame) -> DataFrame:
    """One hash per bundle over its items in order (bundle_id, strategy, position, role, text)."""
    listed = F.array_sort(F.collect_list(F.struct("position", "role", "text")))
    body = F.concat_ws("\x1e", F.transform(listed, lambda x: F.concat_ws("\x1f", x["role"], x["text"])))
    return items.groupBy("bundle_id", "strategy").agg(F.sha2(F.concat_ws("\x1d", F.col("strategy"), body), 256).alias("bundle_hash"))


def commit_bundles(bundles: DataFrame, existing: DataFrame) -> DataFrame:
    """New versions of saved bundles: one per hash not seen for its save, linked to the one before.

    ``bundles``: save_id, bundle_id, bundle_hash, n_sources, n_items, n_primary, arrived;
    ``existing``: save_id, bundle_id, bundle_hash, version. ``problem`` explains a rejected row.
    """
    problem = (
        F.when(~F.col("n_sources").between(2, 60), F.lit("sources"))
        .when(~F.col("n_items").between(2, 70), F.lit("items"))
        .when(F.col("n_primary") != 1, F.lit("primary"))
        .when(~F.col("bundle_hash").rlike("^[0-9a-f]{64}$"), F.lit("hash"))
    )
    checked = bundles.withColumn("problem", problem)
    first = Window.partitionBy("save_id", "bundle_hash").orderBy("arrived", "bundle_id")
    good = checked.where("problem is null").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    new = good.join(existing.select("save_id", "bundle_hash"), ["save_id", "bundle_hash"], "left_anti")
    last = existing.groupBy("save_id").agg(F.max(F.struct("version", "bundle_id")).alias("last"))
    order = Window.partitionBy("save_id").orderBy("arrived", "bundle_id")
    return new.join(last, "save_id", "left").select(
        "save_id", "bundle_id", "bundle_hash",
        (F.coalesce("last.version", F.lit(0)) + F.row_number().over(order)).cast("long").alias("version"),
        F.coalesce(F.lag("bundle_id").over(order), F.col("last.bundle_id")).alias("previous_id"),
    )


def channel_policy(channels: DataFrame, allowed: DataFrame) -> DataFrame:
    """Why a conversation is refused (null: accepted): kind, is_member, is_external, channel."""
    listed = allowed.select("channel").distinct().withColumn("listed", F.lit(True))
    reason = (
        F.when(F.col("kind") == "im", F.lit("direct_message"))
        .when(F.col("kind") == "mpim", F.lit("group_message"))
        .when(~F.col("is_member"), F.lit("not_member"))
        .when(F.col("is_external") & F.col("listed").isNull(), F.lit("external_not_listed"))
    )
    return channels.join(listed, "channel", "left").select("channel", reason.alias("reason"))


def nearby_selection_issues(candidates: DataFrame, selected: DataFrame, most: int = 4) -> DataFrame:
    """Selections that name unknown or repeated candidates, or too many (bundle_id, message_id)."""
    known = candidates.select("bundle_id", "message_id").distinct()
    unknown = selected.join(known, ["bundle_id", "message_id"], "left_anti").select(
        "bundle_id", F.lit("unknown_candidate").alias("code")
    )
    again = selected.groupBy("bundle_id", "message_id").count().where("count > 1").select(
        "bundle_id", F.lit("duplicate_candidate").alias("code")
    )
    many = selected.groupBy("bundle_id").count().where(F.col("count") > most).select(
        "bundle_id", F.lit("too_many").alias("code")
    )
    return unknown.union(again).union(many).distinct()


def extraction_complete(expected: DataFrame, versions: DataFrame, plans: DataFrame) -> DataFrame:
    """save_id, complete: every expected source has a current version and each has a finished plan."""
    state = (
        expected.join(versions.select("source_id", "version_id").distinct(), "source_id", "left")
        .join(plans.where("status = 'completed'").select("version_id").distinct().withColumn("done", F.lit(True)), "version_id", "left")
    )
    return state.groupBy("save_id").agg(F.bool_and(F.col("version_id").isNotNull() & F.col("done").isNotNull()).alias("complete"))


def bundle_statistics(items: DataFrame) -> DataFrame:
    """Counts per bundle: items by role, distinct sources, spans with a permalink."""
    return items.groupBy("bundle_id").agg(
        F.count("*").alias("n_items"),
        F.count_if(F.col("role") == "selected").alias("n_selected"),
        F.count_if(F.col("role") == "thread_reply").alias("n_replies"),
        F.countDistinct("source_id").alias("n_sources"),
        F.count("permalink").alias("n_permalinks"),
    )


def external_teams(rows: DataFrame) -> DataFrame:
    """Teams of both arrays (shared, connected) but one's own, distinct and in order."""
    return rows.withColumn("external", F.array_sort(F.array_except(F.array_union("shared", "connected"), F.array("own"))))


def bundle_documents(items: DataFrame, spans: DataFrame) -> DataFrame:
    """Per bundle its items in order, each with its spans (bundle_id, position, role, source_version_id; spans by version)."""
    per_version = spans.groupBy("source_version_id").agg(F.array_sort(F.collect_list(F.struct("line", "span_id"))).alias("spans"))
    rows = items.join(per_version, "source_version_id", "left")
    item = F.struct("position", "role", "source_version_id", F.coalesce("spans", F.array().cast("array<struct<line:int,span_id:string>>")).alias("spans"))
    return rows.groupBy("bundle_id").agg(F.array_sort(F.collect_list(item)).alias("items"))


def bundle_audit(items: DataFrame, spans: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims that cite a span of a bundle's versions, with how many of their spans lie inside."""
    inside = items.select("bundle_id", "source_version_id").distinct().join(spans.select("source_version_id", "span_id"), "source_version_id")
    cited = inside.join(evidence.select("claim_id", "span_id").distinct(), "span_id")
    return cited.groupBy("bundle_id", "claim_id").agg(F.count("*").alias("n_spans"))


def saved_ids(messages: DataFrame) -> DataFrame:
    """external_id (workspace:channel:ts) of messages, and whether it has the canonical shape."""
    name = F.concat_ws(":", "workspace", "channel", "ts")
    return messages.withColumn("external_id", name).withColumn("canonical", F.col("external_id").rlike("^[A-Z0-9]+:[A-Z0-9]+:[0-9]+\\.[0-9]{6}$"))
