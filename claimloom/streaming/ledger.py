"""The event ledger: batch views, and the same as Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FACETS = ("connections", "contradictions", "embeddings", "graph")
ATTEMPTS = 3
MOST_ROUTES = 10_000


# Batch views ------------------------------------------------------------------------


def append_once(events: DataFrame, key: str = "idempotency_key") -> DataFrame:
    """The first event of each key."""
    first = Window.partitionBy(key).orderBy("ts", "event_id")
    return events.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def route_events(events: DataFrame, routes: DataFrame) -> DataFrame:
    """Events with the policies that their type has; a table of more than ``MOST_ROUTES`` routes is joined as Spark sees fit.

    The routes of the source system itself are a literal map in the plan (``streaming.routing``).
    """
    small = routes.limit(MOST_ROUTES + 1).count() <= MOST_ROUTES
    return events.join(F.broadcast(routes) if small else routes, "event_type")


def derived_tasks(routed: DataFrame) -> DataFrame:
    """Routed rows unique by (policy, subject, cause) and then by (policy, subject, version)."""
    return routed.dropDuplicates(["policy", "subject", "event_id"]).withColumn(
        "_n", F.row_number().over(Window.partitionBy("policy", "subject", "version").orderBy("ts", "event_id"))
    ).where("_n = 1").drop("_n")


def status_counts(events: DataFrame) -> DataFrame:
    """Latest event type of each user, counted."""
    last = events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))
    return last.groupBy("status").agg(F.count("*").alias("n_users"))


def timed_out_runs(runs: DataFrame, as_of) -> DataFrame:
    """Runs started and not finished by their deadline, retryable or terminal (run_id, started_at, finished_at, deadline, attempts)."""
    late = runs.where(F.col("finished_at").isNull() & (F.col("deadline") < as_of))
    return late.select("run_id", F.when(F.col("attempts") >= ATTEMPTS, F.lit("terminal")).otherwise(F.lit("retryable")).alias("outcome"))


def enrichment_state(events: DataFrame) -> DataFrame:
    """claim_id, facet of completed facets; ``events``: claim_id, facet, outcome, ts, event_id.

    A completed connections or contradictions facet invalidates graph; a failure clears its facet. A facet is done if
    its last completion is later than its last invalidation.
    """
    at = F.struct("ts", "event_id")
    ended = events.groupBy("claim_id", "facet").agg(
        F.max(F.when(F.col("outcome") == "completed", at)).alias("done"), F.max(F.when(F.col("outcome") == "failed", at)).alias("failed")
    )
    undone = events.where("outcome = 'completed' and facet in ('connections', 'contradictions')").groupBy("claim_id").agg(F.max(at).alias("undone"))
    rows = ended.join(undone, "claim_id", "left")
    holds = F.col("done").isNotNull() & (F.col("failed").isNull() | (F.col("done") > F.col("failed")))
    graph = (F.col("facet") != "graph") | F.col("undone").isNull() | (F.col("done") > F.col("undone"))
    return rows.where(holds & graph).select("claim_id", "facet")


def dirty_claims(events: DataFrame) -> DataFrame:
    """The latest reason for each claim."""
    return events.groupBy("claim_id").agg(F.max_by("reason", F.struct("ts", "event_id")).alias("reason"))


def timeline(events: DataFrame, limit: int = 100) -> DataFrame:
    severity = F.when(F.col("event_type") == "error", F.lit("error")).otherwise(F.lit("info"))
    rows = events.select("event_id", "ts", F.col("event_type").alias("label"), severity.alias("severity"))
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(max(1, min(limit, 100)))


def run_metrics(events: DataFrame) -> DataFrame:
    """Per policy: runs, mean and exact 95th percentile latency, share of retries; holds the distinct latencies of a policy, as ``latency_sketch`` does not."""
    return events.groupBy("policy").agg(
        F.count("*").alias("n_runs"), F.avg("latency").alias("mean_latency"), F.percentile("latency", 0.95).alias("p95_latency"),
        F.avg((F.col("attempt") > 1).cast("double")).alias("retry_share"),
    )


#: Ratio of the bounds of a sketch's buckets: a quantile read from it is within a hundredth of the true one.
SKETCH_GROWTH = 1.02


def latency_sketch(runs: DataFrame, by: list[str], value: str = "latency") -> DataFrame:
    """``by``, bucket, n: counts of values in buckets that grow by ``SKETCH_GROWTH`` (zero and less in one of their own).

    Counts add up in any order, so sketches of hours merge into days, and of policies into all, by ``merge_sketches``; a group has at most
    some hundred buckets for each power of ten of its values, whatever it holds. Works on a stream as on a table.
    """
    bucket = F.when(F.col(value) > 0, F.floor(F.log(F.col(value)) / F.log(F.lit(SKETCH_GROWTH)))).otherwise(F.lit(None).cast("long"))
    return runs.where(F.col(value).isNotNull()).groupBy(*by, bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merge_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))


def sketch_quantile(sketches: DataFrame, by: list[str], share: float, name: str) -> DataFrame:
    """The value below which a ``share`` of a sketch's values lies: the middle of its bucket, within one per cent."""
    order = Window.partitionBy(*by).orderBy(F.col("bucket").asc_nulls_first())
    rows = sketches.withColumn("_upto", F.sum("n").over(order)).withColumn("_all", F.sum("n").over(Window.partitionBy(*by)))
    first = rows.where(F.col("_upto") >= F.greatest(F.ceil(F.lit(share) * F.col("_all")), F.lit(1))).groupBy(*by).agg(
        F.min_by(F.struct("bucket"), F.col("_upto")).alias("_at"))
    middle = F.pow(F.lit(SKETCH_GROWTH), F.col("_at.bucket") + 0.5)
    return first.select(*by, F.coalesce(middle, F.lit(0.0)).alias(name))


def stream_latency_sketch(runs: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Sketches per policy and hour of a stream (ts, policy, latency), each window once it is over."""
    found = latency_sketch(runs.withWatermark("ts", late).withColumn("hour", F.window("ts", width)), ["hour", "policy"])
    return found.select(F.col("hour.start").alias("hour"), "policy", "bucket", "n")


def run_costs(events: DataFrame) -> DataFrame:
    """Per policy: share of runs on the fallback, and tokens in and out (policy, fallback: boolean, tokens_in, tokens_out)."""
    return events.groupBy("policy").agg(
        F.avg(F.col("fallback").cast("double")).alias("fallback_share"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out")
    )


def merged_timeline(kinds: dict[str, DataFrame], limit: int = 100) -> DataFrame:
    """The newest records of several kinds (id, ts, label, severity) in one list."""
    out = None
    for kind, rows in kinds.items():
        part = rows.select(F.lit(kind).alias("kind"), "id", "ts", "label", "severity")
        out = part if out is None else out.union(part)
    return out.orderBy(F.desc("ts"), "kind", F.desc("id")).limit(max(1, min(limit, 100)))


def causal_chain(events: DataFrame, links: DataFrame, depth: int = 4) -> DataFrame:
    """event_id, cause_id, depth: causes (event_id, cause_id) followed up to ``depth`` steps."""
    rows = events.select("event_id", F.col("event_id").alias("at"), F.lit(0).alias("depth"))
    out = None
    for d in range(1, depth + 1):
        step = rows.where(F.col("depth") == d - 1).join(links.select(F.col("event_id").alias("at"), "cause_id"), "at").select(
            "event_id", F.col("cause_id").alias("at"), F.lit(d).alias("depth")
        )
        rows = step
        out = step if out is None else out.union(step)
    return out.select("event_id", F.col("at").alias("cause_id"), "depth")


def proposal_state(log: DataFrame) -> DataFrame:
    """Latest known value of each field of a proposal (proposal_id, ts, event_id, valid, decision, reviewer)."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("ts", "event_id"))).alias(c)
    state = log.groupBy("proposal_id").agg(last("valid"), last("decision"), last("reviewer"))
    return state.withColumn("decision", F.coalesce("decision", F.lit("pending")))


def graph_events(events: DataFrame, schema: str, field: str) -> DataFrame:
    """The rows of an array in the events' JSON payload (event_id, ts, payload), for the upserts of connections and conflicts."""
    body = F.from_json("payload", f"{field} array<struct<{schema}>>")
    return events.select("event_id", "ts", F.inline(body[field]))


def stage_status(records: DataFrame, stages: list[str]) -> DataFrame:
    """Per item the state of every stage by its latest record (item_id, stage, status, ts, event_id), a summary and whether it is over.

    A stage without records waits; the item has failed if a stage has, and is complete if all are.
    """
    last = records.where(F.col("stage").isin(*stages)).groupBy("item_id", "stage").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))
    wide = last.groupBy("item_id").agg(*[F.coalesce(F.max(F.when(F.col("stage") == s, F.col("status"))), F.lit("waiting")).alias(s) for s in stages])
    states = F.array(*stages)
    summary = (
        F.when(F.exists(states, lambda x: x == "failed"), F.lit("failed")).when(F.forall(states, lambda x: x == "completed"), F.lit("completed"))
        .when(F.exists(states, lambda x: x == "running"), F.lit("running")).otherwise(F.lit("waiting"))
    )
    return wide.withColumn("summary", summary).withColumn("terminal", F.col("summary").isin("failed", "completed"))


def suppressed(events: DataFrame, causes: DataFrame, readiness: DataFrame) -> DataFrame:
    """Pending events that need no work (event_id, resolution).

    A change of a cluster (subject, version) that a neighbourhood sweep caused is redundant if that version was
    evaluated already; a pending sweep itself is superseded.
    """
    pending = events.where(F.col("status").isin("pending", "processing"))
    swept = causes.where("cause_type = 'synthesis_neighborhood_dirty'").select("event_id")
    done = readiness.select(F.col("cluster_key").alias("subject"), "version").distinct()
    again = pending.where("event_type = 'cluster_changed'").join(swept, "event_id", "left_semi").join(done, ["subject", "version"], "left_semi")
    sweeps = pending.where("event_type = 'synthesis_neighborhood_dirty' and actor = 'global_synthesis_sweep'")
    return again.select("event_id", F.lit("redundant").alias("resolution")).union(sweeps.select("event_id", F.lit("superseded")))


# Streams ------------------------------------------------------------------------------


def stream_append_once(events: DataFrame, key: str = "idempotency_key", late: str = "1 hour") -> DataFrame:
    """A stream with each key once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def stream_run_metrics(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and mean value per event type and tumbling window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean_value")
    )


def stream_enrichment(events: DataFrame) -> DataFrame:
    """Completed facets of each claim, folded in event order as state; one row per change.

    The state holds the times that decide (last completion, failure and invalidation of each of four facets), so a late
    event gives the same result as in the batch view.
    """
    zero = (pd.Timestamp("1970-01-01"), -1)

    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = {}
        if state.exists:
            for item in filter(None, state.get[0].split(";")):
                name, ts, number = item.split("|")
                kept[name] = (pd.Timestamp(ts), int(number))
        for pdf in batches:
            for r in pdf.itertuples():
                at = (r.ts, int(r.event_id))
                for name in [f"{r.outcome}:{r.facet}"] + (
                    ["undone:graph"] if r.outcome == "completed" and r.facet in ("connections", "contradictions") else []
                ):
                    kept[name] = max(kept.get(name, zero), at)
        state.update((";".join(f"{n}|{t.isoformat()}|{i}" for n, (t, i) in sorted(kept.items())),))
        done = [
            f for f in FACETS
            if (at := kept.get(f"completed:{f}", zero)) > kept.get(f"failed:{f}", zero) and (f != "graph" or at > kept.get("undone:graph", zero))
        ]
        yield pd.DataFrame({"claim_id": [key[0]], "facets": [",".join(sorted(done))]})

    return events.groupBy("claim_id").applyInPandasWithState(
        fold, "claim_id string, facets string", "times string", "update", GroupStateTimeout.NoTimeout
    )


def write_upserts(stream: DataFrame, path: str, checkpoint: str, key: str = "idempotency_key"):
    """Append a stream's new keys to a Parquet ledger, exactly once per key, batch by batch."""

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = append_once(batch, key)
        try:
            old = spark.read.parquet(path).where(F.col("batch") != number)
        except Exception as error:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(error):
                raise
        else:
            rows = rows.join(old.select(key), key, "left_anti")
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("batch").parquet(path)

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
