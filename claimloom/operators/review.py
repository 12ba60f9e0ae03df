"""Review state of claims: an append-only log and views of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def active_claims(claims: DataFrame, reviews: DataFrame) -> DataFrame:
    """Claims neither removed nor replaced."""
    gone = reviews.where(F.col("review").isin("remove", "edit")).select("claim_id")
    return claims.join(gone, "claim_id", "left_anti")


def review_state(claims: DataFrame, reviews: DataFrame) -> DataFrame:
    """claim_id, review_state: removed, superseded, confirmed or unreviewed, the strongest first."""
    seen = reviews.groupBy("claim_id").agg(*[F.bool_or(F.col("review") == r).alias(r) for r in ("remove", "edit", "confirm")])
    state = (
        F.when(F.col("remove"), F.lit("removed")).when(F.col("edit"), F.lit("superseded"))
        .when(F.col("confirm"), F.lit("confirmed")).otherwise(F.lit("unreviewed"))
    )
    return claims.select("claim_id").join(seen, "claim_id", "left").select("claim_id", state.alias("review_state"))


def apply_review_actions(claims: DataFrame, actions: DataFrame) -> DataFrame:
    """Claims with a replacement appended for each edit; ``supersedes`` names the original."""
    edits = actions.where("action = 'edit'").select("claim_id", "action_id", "replacement")
    old = claims.withColumn("supersedes", F.lit(None).cast("string"))
    new = claims.join(edits, "claim_id").select(*[
        F.concat_ws("~", "claim_id", "action_id").alias("claim_id") if c == "claim_id"
        else F.col("replacement").alias("statement") if c == "statement" else F.col(c)
        for c in claims.columns
    ], F.col("claim_id").alias("supersedes"))
    return old.unionByName(new)


def claim_history(reviews: DataFrame) -> DataFrame:
    """Each claim's reviews in order, as an array."""
    listed = F.array_sort(F.collect_list(F.struct("ts", "event_id", "review")))
    return reviews.groupBy("claim_id").agg(listed.alias("history"), F.count("*").alias("n_events"))


def list_active(claims: DataFrame, reviews: DataFrame, order: list, limit: int = 200) -> DataFrame:
    return active_claims(claims, reviews).orderBy(*order).limit(max(1, min(limit, 200)))


def claim_tables(claims: DataFrame) -> dict[str, DataFrame]:
    """A batch of nested claims as flat tables."""
    return {"claims": claims.select("claim_id", "statement", "claim_type", "epistemic"), **claim_links(claims)}


def claim_links(claims: DataFrame) -> dict[str, DataFrame]:
    """What claims refer to as flat tables; their statements aren't needed."""
    return {
        "evidence": claims.select("claim_id", F.posexplode("evidence").alias("position", "span_id")),
        "entities": claims.select("claim_id", F.col("source").alias("name"), F.lit("source").alias("entity_type")),
        "schemas": claims.select("claim_id", F.col("lang").alias("subject_type"), F.lit("states").alias("predicate"),
                                 F.col("source").alias("object_type")),
    }


def claim_documents(claims: DataFrame, evidence: DataFrame, spans: DataFrame, states: DataFrame) -> DataFrame:
    """Claims with their evidence texts nested in order and their state; children are gathered once."""
    texts = evidence.join(spans.select("span_id", "text"), "span_id").groupBy("claim_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "span_id", "text"))).alias("evidence_spans")
    )
    return claims.join(texts, "claim_id", "left").join(states, "claim_id", "left")


def nested_claims(claims: DataFrame, parts: dict[str, DataFrame], states: DataFrame) -> DataFrame:
    """Claims with their evidence ids, entities and schemas nested in order, and their review state; each child table is gathered once."""
    ids = parts["evidence"].groupBy("claim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "span_id"))), lambda x: x["span_id"]).alias("evidence_ids"))
    names = parts["entities"].groupBy("claim_id").agg(F.array_sort(F.collect_set(F.struct("name", "entity_type"))).alias("entities"))
    patterns = parts["schemas"].groupBy("claim_id").agg(F.array_sort(F.collect_set(F.struct("subject_type", "predicate", "object_type"))).alias("schemas"))
    rows = claims
    for part in (ids, names, patterns, states):
        rows = rows.join(part, "claim_id", "left")
    return rows


def pending_reviews(proposals: DataFrame, limit: int = 100) -> DataFrame:
    ready = proposals.where("valid and approval_required and status = 'pending'")
    return ready.orderBy(F.col("created_at").desc(), "proposal_id").limit(limit)


def preferences(log: DataFrame) -> DataFrame:
    """Latest non-null value of each preference (claim_id, ts, event_id, pinned, excluded)."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("ts", "event_id")))
    return log.groupBy("claim_id").agg(last("pinned").alias("pinned"), last("excluded").alias("excluded"))


def latest_status(log: DataFrame, key: str, status: str, order: list[str]) -> DataFrame:
    """The last status of each key by ``order``."""
    return log.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias("status"))


def backfill_semantics(claims: DataFrame, relations: DataFrame) -> DataFrame:
    """Conservative relations for claims that have none: the claim type gives the predicate."""
    bare = claims.join(relations.select("claim_id"), "claim_id", "left_anti")
    predicate = (
        F.when(F.col("claim_type") == "risk", F.lit("threatens"))
        .when(F.col("claim_type") == "dependency", F.lit("depends_on"))
        .when(F.col("claim_type") == "reported_decision", F.lit("decides"))
        .otherwise(F.lit("states"))
    )
    return bare.select("claim_id", F.col("source").alias("subject"), predicate.alias("predicate"), F.col("claim_type").alias("object"))


def replacement_chain(events: DataFrame) -> DataFrame:
    """Number of edits before each review of a claim."""
    w = Window.partitionBy("claim_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("edits_before", F.coalesce(F.sum((F.col("review") == "edit").cast("int")).over(w), F.lit(0)))


def ingestion_status(log: DataFrame, key: str, failed: str) -> DataFrame:
    """The last status of each key, with its error text if that is ``failed`` (key, status, error, ts, event_id)."""
    last = log.groupBy(key).agg(F.max_by(F.struct("status", "error"), F.struct("ts", "event_id")).alias("last"))
    return last.select(key, "last.status", F.when(F.col("last.status") == failed, F.col("last.error")).alias("error"))
