"""Routing of ledger events to tasks, in batch and as one stream.

Events: event_id, ts, event_type, subject_type, subject_id, input_version, payload (a JSON object). The route table is data; as a literal map
it travels inside the plan, so routing is a projection without any join.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Event type, policy and subject type of the forty routes.
ROUTES = [
    ("slack_context_committed", "extract_slack_context", "context_bundle"),
    ("source_committed", "extract_memory", "source"),
    ("memory_section_ready", "extract_memory_section", "section"),
    ("memory_section_completed", "consolidate_memory", "source"),
    ("memory_committed", "connect_memory", "memory"),
    ("memory_committed", "detect_contradiction", "memory"),
    ("memory_committed", "update_embeddings", "memory"),
    ("memory_committed", "update_graph", "memory"),
    ("memory_committed", "discover_candidate", "memory"),
    ("memory_committed", "check_freshness", "memory"),
    ("memory_committed", "recompute_cluster", "memory"),
    ("memory_connected", "recompute_cluster", "memory"),
    ("connections_updated", "update_graph", "memory"),
    ("connections_updated", "recompute_cluster", "memory"),
    ("contradiction_recorded", "recompute_cluster", "memory"),
    ("contradictions_updated", "update_graph", "memory"),
    ("contradictions_updated", "recompute_cluster", "memory"),
    ("embeddings_updated", "recompute_cluster", "memory"),
    ("graph_updated", "recompute_cluster", "memory"),
    ("memory_confirmed", "recompute_cluster", "memory"),
    ("memory_confirmed", "update_graph", "memory"),
    ("memory_edited", "connect_memory", "memory"),
    ("memory_edited", "detect_contradiction", "memory"),
    ("memory_edited", "update_embeddings", "memory"),
    ("memory_edited", "update_graph", "memory"),
    ("memory_edited", "discover_candidate", "memory"),
    ("memory_edited", "check_freshness", "memory"),
    ("memory_edited", "recompute_cluster", "memory"),
    ("memory_removed", "update_graph", "memory"),
    ("memory_removed", "recompute_cluster", "memory"),
    ("memory_review_changed", "update_graph", "memory"),
    ("memory_review_changed", "recompute_cluster", "memory"),
    ("synthesis_neighborhood_dirty", "recompute_cluster", "memory"),
    ("cluster_changed", "evaluate_synthesis_readiness", "cluster"),
    ("synthesis_ready", "synthesize_brief", "cluster"),
    ("candidate_created", "rank_candidate", "candidate"),
    ("candidate_approved", "draft_artifact", "candidate"),
    ("artifact_drafted", "gate_output", "artifact"),
    ("artifact_rejected", "revise_artifact", "artifact"),
    ("decision_committed", "check_freshness", "decision"),
]
# Routes with a subject or version of their own; names of payload fields, and what stands for a missing last one.
SUBJECT_FIELDS = {("memory_section_completed", "consolidate_memory"): "sourceVersionId"}
VERSION_FIELDS = {
    ("memory_section_completed", "consolidate_memory"): ("planId", "completedSectionOrdinal", None),
    ("synthesis_ready", "synthesize_brief"): ("clusterVersion", "generationIntent", "initiative_brief"),
}
TASK_KEY = ["policy", "subject_type", "subject"]


def _table(routes) -> dict[str, list[dict]]:
    out: dict[str, list[dict]] = {}
    for event_type, policy, subject_type in routes:
        first, second, default = VERSION_FIELDS.get((event_type, policy), (None, None, None))
        out.setdefault(event_type, []).append({
            "policy": policy, "to_type": subject_type, "subject_field": SUBJECT_FIELDS.get((event_type, policy)),
            "first_field": first, "second_field": second, "second_default": default,
        })
    return out


def route(events: DataFrame, routes=ROUTES) -> DataFrame:
    """event_id, ts, policy, subject_type, subject, version: a row for each route of an event's type.

    The subject is the event's own if the types agree, else the payload's ``<type>Id``, else the event's; the version is the event's, else
    its id and time. Some routes take either from fields of the payload. A payload that is no JSON object has no fields.
    """
    kind = "map<string, array<struct<policy: string, to_type: string, subject_field: string, first_field: string, second_field: string, second_default: string>>>"
    rules = F.from_json(F.lit(json.dumps(_table(routes))), kind)
    rows = events.withColumn("_fields", F.from_json("payload", "map<string, string>")).withColumn("_rule", F.explode(F.try_element_at(rules, "event_type")))
    rule = lambda name: F.col(f"_rule.{name}")
    field = lambda name: F.try_element_at("_fields", name)
    number = F.col("event_id").cast("string")
    own = F.when(rule("to_type") == F.col("subject_type"), F.col("subject_id")).otherwise(
        F.coalesce(field(F.concat(rule("to_type"), F.lit("Id"))), F.col("subject_id")))
    subject = F.when(rule("subject_field").isNull(), own).otherwise(F.coalesce(field(rule("subject_field")), F.col("subject_id")))
    plain = F.coalesce("input_version", F.concat_ws(":", number, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")))
    combined = F.concat_ws(
        ":", F.coalesce(field(rule("first_field")), F.col("input_version"), number), F.coalesce(field(rule("second_field")), rule("second_default"), number))
    version = F.when(rule("first_field").isNull(), plain).otherwise(combined)
    return rows.select("event_id", "ts", rule("policy").alias("policy"), rule("to_type").alias("subject_type"), subject.alias("subject"), version.alias("version"))


def tasks(routed: DataFrame) -> DataFrame:
    """Routed rows unique by policy, subject and cause, and by policy, subject and version: the first of each by time."""
    first = Window.partitionBy(*TASK_KEY, "version").orderBy("ts", "event_id")
    return routed.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def stream_tasks(events: DataFrame, routes=ROUTES) -> DataFrame:
    """The tasks of a stream of events, in update mode: the least (ts, event_id) of each policy, subject and version is the batch view's task.

    Repeated events, in one batch or later, change nothing; an event that comes after a later one of its version replaces that. A version is
    given again, with its least event so far, by each batch that has an event of it. State is a row for each version, aggregated natively: no
    row goes to Python. Needs the RocksDB state store.
    """
    first = route(events, routes).groupBy(*TASK_KEY, "version").agg(F.min(F.struct("ts", "event_id")).alias("_first"))
    return first.select(*TASK_KEY, "version", "_first.event_id", "_first.ts")
