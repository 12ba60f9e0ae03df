"""Validators: each emits one row per problem (subject_id, code); no rows means valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.text import is_generic_entity, normalize_key, normalize_words

APPROVAL_TARGETS = ["memory_item", "decision", "artifact", "brief", "policy", "connector", "export", "delete", "share"]


def _issues(rows: DataFrame, subject: str, codes: dict[str, Column]) -> DataFrame:
    listed = F.array_compact(F.array(*[F.when(bad, F.lit(code)) for code, bad in codes.items()]))
    return rows.select(F.col(subject).alias("subject_id"), F.explode(listed).alias("code"))


def claim_shape(claims: DataFrame, types: list[str], epistemics: list[str]) -> DataFrame:
    return _issues(claims, "claim_id", {
        "statement_length": ~F.length("statement").between(1, 2000),
        "claim_type": ~F.col("claim_type").isin(*types),
        "epistemic": ~F.col("epistemic").isin(*epistemics),
        "evidence_count": ~F.size("evidence").between(1, 12),
    })


def unknown_references(rows: DataFrame, subject: str, ids: str, known: DataFrame, known_id: str, code: str) -> DataFrame:
    """Ids in an array column that the known table does not have."""
    listed = rows.select(F.col(subject).alias("subject_id"), F.explode(ids).alias("_ref")).distinct()
    lost = listed.join(known.select(F.col(known_id).alias("_ref")), "_ref", "left_anti")
    return lost.select("subject_id", F.lit(code).alias("code"), F.col("_ref").alias("reference"))


def missing_evidence(claims: DataFrame) -> DataFrame:
    return _issues(claims, "claim_id", {"missing_evidence": F.coalesce(F.size("evidence"), F.lit(0)) == 0})


def outside_parent(relations: DataFrame, claims: DataFrame) -> DataFrame:
    """Relations (claim_id, relation_id, evidence) that cite evidence their claim does not have."""
    joined = relations.join(claims.select("claim_id", F.col("evidence").alias("own")), "claim_id")
    return joined.where(F.size(F.array_except("evidence", "own")) > 0).select(
        F.col("relation_id").alias("subject_id"), F.lit("relation_evidence_outside_claim").alias("code")
    )


def duplicate_statements(claims: DataFrame, batch: list[str], order: list[str]) -> DataFrame:
    """Claims whose statement (as a key) came earlier in their batch."""
    w = Window.partitionBy(*batch, "_key").orderBy(*order)
    rows = claims.withColumn("_key", normalize_key(F.col("statement"))).withColumn("_n", F.row_number().over(w))
    return rows.where("_n > 1").select(F.col("claim_id").alias("subject_id"), F.lit("duplicate_statement").alias("code"))


def decision_status(claims: DataFrame) -> DataFrame:
    bad = (F.col("epistemic") == "observed") & (F.col("claim_type") == "reported_decision")
    return _issues(claims, "claim_id", {"decision_status_invalid": bad})


def stale_versions(proposals: DataFrame, current: DataFrame) -> DataFrame:
    """Proposals (proposal_id, item_id, version) not made on their item's current version."""
    now = current.select("item_id", F.col("version").alias("_now"))
    return proposals.join(now, "item_id").where("version <> _now").select(
        F.col("proposal_id").alias("subject_id"), F.lit("stale_source_version").alias("code")
    )


def unsurfaced(rows: DataFrame) -> DataFrame:
    """Blocking contradictions (array blocking) that the array surfaced omits."""
    return _issues(rows, "subject", {"contradiction_not_surfaced": F.size(F.array_except("blocking", "surfaced")) > 0})


def approval_required(proposals: DataFrame) -> DataFrame:
    bad = F.col("target_type").isin(*APPROVAL_TARGETS) & ~F.col("approval_required")
    return _issues(proposals, "proposal_id", {"human_approval_required": bad})


def merge(*results: DataFrame) -> DataFrame:
    """Issues of several validators, counted per subject."""
    out = results[0].select("subject_id", "code")
    for r in results[1:]:
        out = out.unionByName(r.select("subject_id", "code"))
    return out.groupBy("subject_id").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"), F.count("*").alias("n"))


def route_candidates(
    candidates: DataFrame, issues: DataFrame, decisions: DataFrame | None, verifier_up: bool = True
) -> DataFrame:
    """claim_id and route: duplicate, rejected, auto or review.

    The first of equal statements (by batch, ordinal) goes on; a claim with issues is rejected;
    then its verifier decision (claim_id, decision, correction_valid) counts.
    """
    w = Window.partitionBy("batch", "_norm").orderBy("ordinal")
    rows = candidates.withColumn("_norm", normalize_words(F.col("statement"))).withColumn("_n", F.row_number().over(w))
    bad = issues.select(F.col("subject_id").alias("claim_id")).distinct().withColumn("_bad", F.lit(True))
    rows = rows.join(bad, "claim_id", "left")
    if decisions is None:
        verdict = F.lit("auto" if verifier_up else "review")
    else:
        rows = rows.join(decisions.select("claim_id", "decision", "correction_valid"), "claim_id", "left")
        verdict = (
            F.when(F.col("decision").isNull(), F.lit("review"))
            .when(F.col("decision") == "verified", F.lit("auto"))
            .when(F.col("decision") == "needs_review", F.lit("review"))
            .when(F.col("decision") == "corrected", F.when(F.col("correction_valid"), F.lit("auto")).otherwise(F.lit("review")))
            .when(F.col("decision") == "duplicate", F.lit("duplicate"))
            .otherwise(F.lit("rejected"))
        )
    route = F.when(F.col("_n") > 1, F.lit("duplicate")).when(F.col("_bad"), F.lit("rejected")).otherwise(verdict)
    return rows.select("claim_id", route.alias("route"))


def decision_issues(decisions: DataFrame, candidates: DataFrame, key: str = "claim_id") -> DataFrame:
    """Decisions on unknown or repeated candidates, or corrected without a correction."""
    known = candidates.select(key).distinct()
    unknown = decisions.join(known, key, "left_anti").select(F.col(key).alias("subject_id"), F.lit("unknown_candidate").alias("code"))
    again = decisions.groupBy(key).count().where("count > 1").select(F.col(key).alias("subject_id"), F.lit("duplicate_decision").alias("code"))
    bare = decisions.where("decision = 'corrected' and correction is null").select(
        F.col(key).alias("subject_id"), F.lit("correction_missing").alias("code")
    )
    return unknown.union(again).union(bare)


def connection_decision_issues(decisions: DataFrame, candidates: DataFrame, types: list[str]) -> DataFrame:
    """Decisions (candidate_id, connection_type, confidence, evidence) against their candidates (candidate_id, evidence)."""
    found = decision_issues(decisions.withColumns({"decision": F.lit(None).cast("string"), "correction": F.lit(None).cast("string")}), candidates, "candidate_id")
    shape = _issues(decisions, "candidate_id", {
        "unknown_connection_type": ~F.coalesce(F.col("connection_type").isin(*types), F.lit(False)),
        "invalid_connection_confidence": ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)),
    })
    known = decisions.join(candidates.select("candidate_id", F.col("evidence").alias("own")), "candidate_id")
    lost = known.where(F.size(F.array_except("evidence", "own")) > 0).select(F.col("candidate_id").alias("subject_id"), F.lit("unavailable_evidence").alias("code"))
    return found.union(shape).union(lost).distinct()


def citation_issues(answers: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Citations (answer_id, claim_id, span_id) of unknown claims, unknown spans, or spans that the cited claim lacks."""
    code = lambda rows, name: rows.select(F.col("answer_id").alias("subject_id"), F.lit(name).alias("code"))
    no_claim = answers.join(claims.select("claim_id"), "claim_id", "left_anti")
    no_span = answers.join(evidence.select("span_id").distinct(), "span_id", "left_anti")
    known = answers.join(claims.select("claim_id"), "claim_id", "left_semi").join(evidence.select("span_id").distinct(), "span_id", "left_semi")
    loose = known.join(evidence.select("claim_id", "span_id"), ["claim_id", "span_id"], "left_anti")
    return code(no_claim, "unknown_claim").union(code(no_span, "unknown_evidence")).union(code(loose, "evidence_outside_claim")).distinct()


def embedding_batch_issues(batches: DataFrame, vectors: DataFrame, dimension: int, most: int = 128) -> DataFrame:
    """Batches (batch_id, n_inputs) with too many inputs, another number of vectors (batch_id, embedding), or a wrong dimension."""
    got = vectors.groupBy("batch_id").agg(F.count("*").alias("n"), F.count_if(F.size("embedding") != dimension).alias("wrong"))
    rows = batches.join(got, "batch_id", "left").fillna(0, ["n", "wrong"])
    return _issues(rows, "batch_id", {
        "too_many_inputs": F.col("n_inputs") > most, "count_mismatch": F.col("n") != F.col("n_inputs"), "wrong_dimension": F.col("wrong") > 0,
    })


def merge_qualifiers(original: Column, corrected: Column) -> Column:
    """Union of two maps; the correction wins."""
    return F.map_zip_with(original, corrected, lambda k, a, b: F.coalesce(b, a))


def sanitize_entities(entities: DataFrame) -> DataFrame:
    """Entities (claim_id, position, name, canonical, entity_type) worth keeping, the first of each label and type."""
    trimmed = entities.select(
        "claim_id", "position", F.trim("name").alias("name"), F.nullif(F.trim("canonical"), F.lit("")).alias("canonical"),
        F.trim("entity_type").alias("entity_type"),
    )
    label = normalize_words(F.coalesce("canonical", "name"))
    rows = trimmed.withColumn("label", label).where(
        (F.col("name") != "") & (F.col("entity_type") != "") & ~is_generic_entity(F.col("label"))
        & ~is_generic_entity(normalize_words(F.col("name")))
    )
    first = Window.partitionBy("claim_id", "label", F.lower("entity_type")).orderBy("position")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def connection_issues(connections: DataFrame) -> DataFrame:
    return _issues(connections, "connection_id", {
        "invalid_connection_claims": F.coalesce(F.col("from_id") == F.col("to_id"), F.lit(True)),
        "invalid_connection_confidence": ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)),
        "connection_missing_evidence": F.coalesce(F.size("evidence"), F.lit(0)) == 0,
    })


def conflict_issues(conflicts: DataFrame) -> DataFrame:
    """Conflicts need two members, and every member evidence (members: array of struct with evidence)."""
    return _issues(conflicts, "conflict_id", {
        "conflict_requires_members": F.coalesce(F.size("members"), F.lit(0)) < 2,
        "conflict_member_missing_evidence": F.exists("members", lambda m: F.coalesce(F.size(m["evidence"]), F.lit(0)) == 0),
    })


def listing_issues(lists: DataFrame, candidates: DataFrame) -> DataFrame:
    """Unknown or repeated ids in a ranking (query_id, claim_id) against its candidates."""
    known = candidates.select("query_id", "claim_id").distinct()
    unknown = lists.join(known, ["query_id", "claim_id"], "left_anti").select("query_id", F.lit("unknown_claim").alias("code"))
    again = lists.groupBy("query_id", "claim_id").count().where("count > 1").select("query_id", F.lit("duplicate_claim").alias("code"))
    return unknown.union(again).distinct()


def embedding_issues(embeddings: DataFrame, dimension: int) -> DataFrame:
    return _issues(embeddings, "target_id", {"wrong_dimension": F.coalesce(F.size("embedding"), F.lit(-1)) != dimension})


def commit_gate(proposals: DataFrame, committed: DataFrame) -> DataFrame:
    """Proposals that may be committed now."""
    ready = proposals.where("valid and (not approval_required or approved)")
    return ready.join(committed.select("proposal_id"), "proposal_id", "left_anti")


def duplicate_selection(rows: DataFrame) -> DataFrame:
    return _issues(rows, "subject", {"duplicate_selection": F.size("ids") != F.size(F.array_distinct("ids"))})


def review_action_issues(actions: DataFrame, spans: DataFrame) -> DataFrame:
    """An edit has a replacement and nothing else does; its evidence lies in the claim's version."""
    edit = F.col("action") == "edit"
    shape = _issues(actions, "claim_id", {"replacement_mismatch": edit != F.col("replacement").isNotNull()})
    cited = actions.where(edit).select("claim_id", "source_version_id", F.explode("replacement_evidence").alias("span_id"))
    wrong = cited.join(spans.select("source_version_id", "span_id"), ["source_version_id", "span_id"], "left_anti")
    return shape.union(wrong.select("claim_id", F.lit("evidence_outside_version")).distinct())


def render_model_input(spans: DataFrame, limit: int = 50_000) -> DataFrame:
    """One text per version: its spans in tagged blocks with escaped attributes and text."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    block = F.concat(
        F.lit('<evidence id="'), safe(F.col("span_id")), F.lit('" line="'), F.col("line").cast("string"), F.lit('">'),
        safe(F.col("text")), F.lit("</evidence>"),
    )
    listed = F.array_sort(F.collect_list(F.struct("line", block.alias("block"))))
    body = F.concat_ws("\n", F.transform(listed, lambda x: x["block"]))
    return spans.groupBy("source_version_id").agg(F.substring(body, 1, limit).alias("prompt"))
