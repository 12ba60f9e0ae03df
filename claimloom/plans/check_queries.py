"""Registered queries of validators, context, section and review operators, over inputs that are broken on purpose."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimloom.functions import text as T
from claimloom.operators import context, evidence, graph, metrics, retrieval, review, sections, synthesis, validation, vector_index
from claimloom.plans import views as V
from claimloom.plans.queries import query, rounded
from claimloom.sources import derive
from claimloom.sources.derive import table

NO_STRINGS = "array<string>"


def _empty():
    return F.array().cast(NO_STRINGS)


# A: sources -------------------------------------------------------------------------------


@query("""SELECT user_id, sha256('{"event_type":"' || event_type || '","k":"' || json_extract_string(props, '$.k') || '","user":"' || user_id || '"}') AS json_sha256, event_id FROM events""")
def canonical_payloads(spark, d):
    rows = derive.ledger(spark, d)
    payload = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("k"), F.col("k").cast("string"), F.lit("event_type"), F.col("event_type"))
    return rows.select("user_id", F.sha2(T.canonical_json(payload), 256).alias("json_sha256"), "event_id")


@query(f"""WITH {V.SPANS}, shifted AS (SELECT *, CASE WHEN line % 7 = 0 THEN 1 ELSE 0 END AS by_chars FROM spans)
SELECT span_id FROM shifted JOIN sources USING (source_version_id) WHERE substr(sources.content, (start_char + by_chars + 1)::BIGINT, (end_char - start_char)::BIGINT) <> text""")
def shifted_spans(spark, d):
    versions = evidence.sources(table(spark, d, "documents"))
    moved = F.when(F.col("line") % 7 == 0, F.lit(1)).otherwise(F.lit(0))
    rows = derive.spans(spark, d).withColumns({"start_char": F.col("start_char") + moved, "end_char": F.col("end_char") + moved})
    return evidence.span_violations(rows, versions).select("span_id")


@query("""SELECT doc_id, 'AB-' || doc_id % 97 || ',' || CASE WHEN doc_id % 2 = 0 THEN 'XY2-7' ELSE 'ZED-1' END AS tickets FROM documents""")
def merged_tickets(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.concat_ws(" ", F.lit("see ab-"), "doc_id").alias("x"))
    said = F.concat(F.lit("see ab-"), (F.col("doc_id") % 97).cast("string"), F.lit(" and xy2-7, x-1"))
    known = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("XY2-7"))).otherwise(F.array(F.lit("ZED-1")))
    found = F.when(F.col("doc_id") % 2 == 0, T.issue_tickets(said)).otherwise(T.issue_tickets(F.regexp_replace(said, "xy2-7", "")))
    return rows.select("doc_id", F.array_join(T.merged_identities(found, known), ",").alias("tickets"))


@query("""SELECT event_id, 'T1:C' || user_id || ':' || floor(epoch(ts))::BIGINT || '.' || lpad((event_id % 1000000)::VARCHAR, CASE WHEN event_id % 9 = 0 THEN 5 ELSE 6 END, '0') AS external_id, event_id % 9 <> 0 AS canonical FROM events""")
def external_ids(spark, d):
    part = F.lpad((F.col("event_id") % 1000000).cast("string"), 6, "0")
    ts = F.concat(F.unix_timestamp("ts").cast("string"), F.lit("."), F.when(F.col("event_id") % 9 == 0, F.lpad((F.col("event_id") % 1000000).cast("string"), 5, "0")).otherwise(part))
    rows = table(spark, d, "events").select("event_id", F.lit("T1").alias("workspace"), F.concat(F.lit("C"), "user_id").alias("channel"), ts.alias("ts"))
    return context.saved_ids(rows).select("event_id", "external_id", "canonical")


@query(f"""WITH {V.LEDGER}, old AS (SELECT item_id, k, row_number() OVER (PARTITION BY item_id ORDER BY arrived) AS version FROM (SELECT user_id AS item_id, k, min(event_id) AS arrived FROM ledger WHERE event_id % 2 = 0 GROUP BY ALL)),
new AS (SELECT user_id AS item_id, k, min(event_id) AS arrived FROM ledger WHERE event_id % 2 = 1 GROUP BY ALL)
SELECT n.item_id, n.k, coalesce((SELECT max(version) FROM old o WHERE o.item_id = n.item_id), 0) + row_number() OVER (PARTITION BY n.item_id ORDER BY arrived) AS version
FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.item_id = n.item_id AND o.k = n.k)""")
def later_versions(spark, d):
    """Versions on top of a table that already has some."""
    rows = derive.ledger(spark, d).select(F.col("user_id").alias("item_id"), F.col("k").cast("string").alias("content_hash"), F.col("event_id").alias("arrived"))
    none = spark.createDataFrame([], "item_id long, content_hash string, version long")
    old = evidence.version_sources(rows.where("arrived % 2 = 0"), none)
    found = evidence.version_sources(rows.where("arrived % 2 = 1"), old)
    return found.select("item_id", F.col("content_hash").cast("long").alias("k"), "version")


@query(f"""WITH {V.CLAIMS}, {V.REVIEWS}, live AS (SELECT doc_id, string_agg(claim_id, ',' ORDER BY claim_id) AS claim_ids, count(*) AS n_claims FROM claims WHERE claim_id NOT IN (SELECT claim_id FROM reviews WHERE review IN ('remove', 'edit')) GROUP BY 1),
lines_ AS (SELECT doc_id, count(*) AS n_spans FROM spans GROUP BY 1)
SELECT doc_id, n_spans, coalesce(n_claims, 0) AS n_claims, coalesce(claim_ids, '') AS claim_ids FROM lines_ LEFT JOIN live USING (doc_id)""")
def ingestion_results(spark, d):
    reviews = derive.review_events(derive.ledger(spark, d), table(spark, d, "documents").count())
    found = evidence.ingestion_results(derive.spans(spark, d), review.active_claims(derive.claims(spark, d), reviews))
    return found.select("doc_id", F.size("spans").cast("long").alias("n_spans"), F.size("claim_ids").cast("long").alias("n_claims"), F.array_join("claim_ids", ",").alias("claim_ids"))


# B: context -------------------------------------------------------------------------------


@query("""SELECT conv_id, turn, turn % 4 IN (0, 2) AS is_system FROM conversations""")
def system_messages(spark, d):
    subtype = F.element_at(F.array(F.lit("channel_join"), F.lit(None).cast("string"), F.lit("message_deleted"), F.lit("thread_broadcast")), (F.col("turn") % 4 + 1).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.is_system_message(subtype).alias("is_system"))


@query("SELECT user_id AS channel, floor(epoch(ts))::BIGINT // 3600 AS ts, max(event_id) AS arrived FROM events GROUP BY 1, 2")
def deduped_messages(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("channel"), F.floor(F.unix_timestamp("ts") / 3600).alias("ts"), F.col("event_id").alias("arrived"))
    return context.dedupe_messages(rows)


@query("""SELECT conv_id, CASE WHEN count(*) FILTER (turn > 3) > 0 THEN 'thread' WHEN count(*) FILTER (turn > 0 AND conv_id % 2 = 0) > 0 THEN 'nearby' ELSE 'selected_only' END AS strategy FROM conversations GROUP BY 1""")
def selection_strategies(spark, d):
    counts = table(spark, d, "conversations").groupBy("conv_id").agg(
        F.count_if(F.col("turn") > 3).alias("n_thread_others"), F.count_if((F.col("turn") > 0) & (F.col("conv_id") % 2 == 0)).alias("n_nearby_selected")
    )
    return context.selection_strategy(counts).select("conv_id", "strategy")


@query("""WITH s AS (SELECT conv_id, conv_id * 100 + turn AS id, turn FROM conversations)
SELECT conv_id // 4 AS save_id, bool_and(id % 17 <> 0 AND id % 13 <> 0) AS complete FROM s GROUP BY 1""")
def complete_extractions(spark, d):
    rows = table(spark, d, "conversations").select(F.floor(F.col("conv_id") / 4).alias("save_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("source_id"))
    versions = rows.where("source_id % 17 <> 0").select("source_id", (F.col("source_id") + 1).alias("version_id"))
    status = F.when(F.col("source_id") % 13 == 0, F.lit("running")).otherwise(F.lit("completed"))
    return context.extraction_complete(rows, versions, versions.select("version_id", status.alias("status")))


@query("""SELECT conv_id, array_to_string(list_sort(list_distinct(list_filter(list_concat(list(turn::VARCHAR), list((turn // 2 + 3)::VARCHAR)), lambda x: x <> '0'))), ',') AS external FROM conversations GROUP BY 1""")
def external_teams(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(
        F.collect_list(F.col("turn").cast("string")).alias("shared"), F.collect_list(F.floor(F.col("turn") / 2 + 3).cast("string")).alias("connected")
    ).withColumn("own", F.lit("0"))
    return context.external_teams(rows).select("conv_id", F.array_join("external", ",").alias("external"))


_ITEMS = "items AS (SELECT conv_id, turn, role, 'srcv_' || (conv_id * 7 + turn) AS source_version_id FROM conversations)"


def _items(spark, d):
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("bundle_id"), F.col("turn").alias("position"), "role", F.concat(F.lit("srcv_"), (F.col("conv_id") * 7 + F.col("turn")).cast("string")).alias("source_version_id")
    )


@query(f"""WITH {V.SPANS}, {_ITEMS}, v AS (SELECT source_version_id, string_agg(span_id, ',' ORDER BY line) AS s FROM spans GROUP BY 1)
SELECT conv_id, sha256(string_agg(turn || ':' || role || ':' || coalesce(s, ''), chr(10) ORDER BY turn)) AS document_sha256 FROM items LEFT JOIN v USING (source_version_id) GROUP BY 1""")
def bundle_documents(spark, d):
    found = context.bundle_documents(_items(spark, d), derive.spans(spark, d))
    text = F.transform("items", lambda x: F.concat_ws(":", x["position"].cast("string"), x["role"], F.array_join(F.transform(x["spans"], lambda s: s["span_id"]), ",")))
    return found.select(F.col("bundle_id").alias("conv_id"), F.sha2(F.array_join(text, "\n"), 256).alias("document_sha256"))


@query(f"""WITH {V.CLAIMS}, {_ITEMS} SELECT conv_id, claim_id, count(*) AS n_spans FROM (SELECT DISTINCT conv_id, source_version_id FROM items) JOIN spans USING (source_version_id)
 JOIN (SELECT DISTINCT claim_id, unnest(evidence) AS span_id FROM claims) USING (span_id) GROUP BY 1, 2""")
def bundle_audits(spark, d):
    found = context.bundle_audit(_items(spark, d), derive.spans(spark, d), derive.claim_evidence(derive.claims(spark, d)))
    return found.select(F.col("bundle_id").alias("conv_id"), "claim_id", "n_spans")


# C: sections ------------------------------------------------------------------------------


_HALVES = """halves AS (SELECT source_version_id, n, CASE WHEN n = 1 THEN 1 ELSE n // 2 END AS cut FROM (SELECT source_version_id, count(*) AS n FROM spans GROUP BY 1)),
plan AS (SELECT source_version_id, 1 AS section, 0 AS first_span, cut - 1 AS last_span FROM halves UNION ALL SELECT source_version_id, 2, cut, n - 1 FROM halves WHERE n > 1)"""


def _halves(spark, d):
    """Two sections per version, from the counts of its spans."""
    sizes = derive.spans(spark, d).groupBy("source_version_id").agg(F.count("*").alias("n"))
    cut = F.when(F.col("n") == 1, F.lit(1)).otherwise(F.floor(F.col("n") / 2))
    first = sizes.select("source_version_id", F.lit(1).alias("section"), F.lit(0).alias("first_span"), (cut - 1).alias("last_span"))
    return first.union(sizes.where("n > 1").select("source_version_id", F.lit(2), cut, F.col("n") - 1))


@query(f"WITH {V.SPANS}, {_HALVES} SELECT source_version_id, section::BIGINT AS section, span_no::BIGINT AS span_no FROM spans JOIN plan USING (source_version_id) WHERE span_no BETWEEN first_span AND last_span")
def section_spans(spark, d):
    found = sections.spans_for_section(_halves(spark, d), derive.spans(spark, d))
    return found.select("source_version_id", F.col("section").cast("long").alias("section"), F.col("span_no").cast("long").alias("span_no"))


@query(f"""WITH {V.SPANS}, {_HALVES}, b AS (
  SELECT source_version_id, section, CASE WHEN hash_ = 1 AND section = 2 THEN first_span + 1 WHEN hash_ = 2 AND section = 2 THEN first_span - 1 ELSE first_span END AS first_span,
    CASE WHEN hash_ = 3 AND (section = 2 OR n = 1) THEN last_span - 1 WHEN hash_ = 4 AND section = 1 THEN last_span + 1000000 ELSE last_span END AS last_span, n
  FROM (SELECT plan.*, n, substr(source_version_id, 6)::BIGINT % 6 AS hash_ FROM plan JOIN halves USING (source_version_id))
), r AS (SELECT b.*, f.start_char AS from_char, l.end_char AS to_char, coalesce(max(last_span + 1) OVER (PARTITION BY b.source_version_id ORDER BY section ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS expected,
  lead(section) OVER (PARTITION BY b.source_version_id ORDER BY section) IS NULL AS final
  FROM b LEFT JOIN spans f ON f.source_version_id = b.source_version_id AND f.span_no = b.first_span LEFT JOIN spans l ON l.source_version_id = b.source_version_id AND l.span_no = b.last_span)
SELECT source_version_id, section::BIGINT AS section, code FROM (SELECT source_version_id, section, unnest([CASE WHEN from_char IS NULL OR to_char IS NULL THEN 'unknown_span' END, CASE WHEN last_span < first_span THEN 'out_of_order' END,
  CASE WHEN first_span < expected THEN 'overlap' END, CASE WHEN first_span > expected THEN 'gap' END, CASE WHEN to_char - from_char > 8000 AND last_span > first_span THEN 'oversized' END,
  CASE WHEN section > 1 THEN 'too_many_sections' END, CASE WHEN final AND last_span + 1 < n THEN 'tail_not_covered' END]) AS code FROM r) WHERE code IS NOT NULL""")
def broken_plan_issues(spark, d):
    """Every code of a plan's validation: bounds are moved by the document's number."""
    plan = _halves(spark, d).withColumn("h", F.expr("cast(substring(source_version_id, 6) as bigint)") % 6)
    sizes = derive.spans(spark, d).groupBy("source_version_id").agg(F.count("*").alias("n"))
    second = F.col("section") == 2
    broken = plan.join(sizes, "source_version_id").select(
        "source_version_id", "section",
        F.when((F.col("h") == 1) & second, F.col("first_span") + 1).when((F.col("h") == 2) & second, F.col("first_span") - 1).otherwise(F.col("first_span")).alias("first_span"),
        F.when((F.col("h") == 3) & (second | (F.col("n") == 1)), F.col("last_span") - 1).when((F.col("h") == 4) & ~second, F.col("last_span") + 1_000_000).otherwise(F.col("last_span")).alias("last_span"),
    )
    issues = sections.plan_issues(broken, derive.spans(spark, d), max_sections=1)
    return issues.select("source_version_id", F.col("section").cast("long").alias("section"), "code")


@query(rf"""WITH {V.SPANS}, t AS (SELECT span_id, span_no, trim(regexp_replace(regexp_replace(text, '^#{{1,6}}\s*', ''), '\s+', ' ', 'g')) AS c FROM spans)
SELECT span_id, CASE WHEN length(c) BETWEEN 1 AND 100 THEN regexp_replace(c, ':$', '') ELSE 'Section ' || span_no END AS title FROM t""")
def section_titles(spark, d):
    return derive.spans(spark, d).select("span_id", T.section_title(F.col("text"), F.col("span_no")).alias("title"))


@query(f"WITH {V.CLAIMS} SELECT claim_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id, part) - 1) // 30 AS chunk FROM claims")
def claim_chunks(spark, d):
    found = sections.chunked(derive.claims(spark, d), ["source"], ["doc_id", "part"])
    return found.select("claim_id", "source", F.col("chunk").cast("long").alias("chunk"))


@query("SELECT user_id AS source_version_id, min(event_id) AS plan_id FROM events GROUP BY 1")
def committed_plans(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("source_version_id"), F.col("event_id").alias("plan_id"), F.col("event_id").alias("created_at"))
    return sections.commit_plans(rows).select("source_version_id", "plan_id")


@query(f"WITH {V.SPANS}, p AS (SELECT source_version_id, source_version_id AS plan_id, min_by(span_id, line) AS a, CASE WHEN doc_id % 5 = 0 THEN 'ev_none' ELSE max_by(span_id, line) END AS b FROM spans GROUP BY source_version_id, doc_id) SELECT plan_id, 'bound_outside_version' AS code FROM p WHERE b = 'ev_none'")
def plan_bounds_outside(spark, d):
    spans = derive.spans(spark, d)
    last = F.when(F.max("doc_id") % 5 == 0, F.lit("ev_none")).otherwise(F.max_by("span_id", "line"))
    plans = spans.groupBy("source_version_id").agg(F.min_by("span_id", "line").alias("first_id"), last.alias("last_id")).withColumn("plan_id", F.col("source_version_id"))
    return sections.bounds_outside(plans, spans)


@query("SELECT user_id AS plan_id, bool_and(event_type <> 'error') AS completed FROM events GROUP BY 1")
def plan_completions(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("plan_id"), F.col("event_id").alias("proposal_id"), "event_type")
    return sections.completed_plans(rows.select("plan_id", "proposal_id"), rows.where("event_type <> 'error'"))


@query("""SELECT conv_id AS plan_id, bool_and(turn % 5 <> 4) AS gate_open, min(turn) FILTER (turn % 5 = 4) AS current_section FROM conversations GROUP BY 1""")
def consolidation_gates(spark, d):
    status = F.when(F.col("turn") % 5 == 4, F.lit("running")).otherwise(F.lit("completed"))
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("plan_id"), F.col("turn").alias("section"), status.alias("status"))
    return sections.section_progress(rows).select("plan_id", "gate_open", "current_section")


# D: validation ----------------------------------------------------------------------------


@query(f"WITH {V.CLAIMS} SELECT claim_id AS subject_id, 'missing_evidence' AS code FROM claims WHERE doc_id % 7 = 0")
def missing_evidence(spark, d):
    rows = derive.claims(spark, d).withColumn("evidence", F.when(F.col("doc_id") % 7 != 0, F.col("evidence")).otherwise(_empty()))
    return validation.missing_evidence(rows)


@query(f"WITH {V.CLAIMS} SELECT 'rel_' || claim_id AS subject_id, 'relation_evidence_outside_claim' AS code FROM claims WHERE doc_id % 5 = 0 OR NOT list_contains(evidence, 'ev_' || doc_id || '_1')")
def relations_outside_claim(spark, d):
    rows = derive.claims(spark, d)
    cited = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("ev_x"))).otherwise(F.array(F.concat(F.lit("ev_"), "doc_id", F.lit("_1"))))
    return validation.outside_parent(rows.select("claim_id", F.concat(F.lit("rel_"), "claim_id").alias("relation_id"), cited.alias("evidence")), rows)


@query(f"WITH {V.CLAIMS} SELECT claim_id AS subject_id, 'decision_status_invalid' AS code FROM claims WHERE doc_id % 10 = 2 AND doc_id % 3 = 0")
def decision_status_issues(spark, d):
    rows = derive.claims(spark, d).withColumn("epistemic", F.when(F.col("doc_id") % 3 == 0, F.lit("observed")).otherwise(F.lit("reported")))
    return validation.decision_status(rows)


@query(f"""WITH {V.CLAIMS} SELECT claim_id AS subject_id, code FROM (SELECT claim_id, unnest([CASE WHEN doc_id % 6 = 0 THEN 'statement_length' END, CASE WHEN doc_id % 6 = 1 THEN 'claim_type' END, CASE WHEN doc_id % 6 = 2 THEN 'epistemic' END,
 CASE WHEN doc_id % 6 = 3 THEN 'evidence_count' END]) AS code FROM claims) WHERE code IS NOT NULL""")
def broken_claim_shapes(spark, d):
    case = lambda n, bad, good: F.when(F.col("doc_id") % 6 == n, bad).otherwise(F.col(good))
    rows = derive.claims(spark, d).withColumns({
        "statement": case(0, F.lit(""), "statement"), "claim_type": case(1, F.lit("rumour"), "claim_type"), "epistemic": case(2, F.lit("guessed"), "epistemic"),
        "evidence": case(3, _empty(), "evidence"),
    })
    return validation.claim_shape(rows, derive.CLAIM_TYPES, ["reported", "observed"])


@query(f"WITH {V.CLAIMS} SELECT DISTINCT user_id::VARCHAR AS subject_id, 'unknown_memory' AS code, 'mem_' || k || '_0' AS reference FROM (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE 'mem_' || k || '_0' NOT IN (SELECT claim_id FROM claims WHERE doc_id % 2 = 0)")
def unknown_memory_references(spark, d):
    rows = derive.ledger(spark, d).groupBy(F.col("user_id").cast("string").alias("proposal")).agg(F.collect_set(F.concat(F.lit("mem_"), "k", F.lit("_0"))).alias("refs"))
    return validation.unknown_references(rows, "proposal", "refs", derive.claims(spark, d).where("doc_id % 2 = 0"), "claim_id", "unknown_memory")


@query(f"WITH {V.SPANS} SELECT DISTINCT conv_id::VARCHAR AS subject_id, 'unknown_evidence' AS code, 'ev_' || conv_id || '_' || turn AS reference FROM conversations WHERE 'ev_' || conv_id || '_' || turn NOT IN (SELECT span_id FROM spans)")
def artifact_references(spark, d):
    rows = table(spark, d, "conversations").groupBy(F.col("conv_id").cast("string").alias("artifact")).agg(F.collect_set(F.concat(F.lit("ev_"), "conv_id", F.lit("_"), "turn")).alias("refs"))
    return validation.unknown_references(rows, "artifact", "refs", derive.spans(spark, d), "span_id", "unknown_evidence")


@query(f"WITH {V.LEDGER} SELECT event_id AS subject_id, 'stale_source_version' AS code FROM ledger JOIN (SELECT user_id, max(k) AS now FROM ledger GROUP BY 1) USING (user_id) WHERE k <> now")
def stale_proposals(spark, d):
    rows = derive.ledger(spark, d).select(F.col("event_id").alias("proposal_id"), F.col("user_id").alias("item_id"), F.col("k").alias("version"))
    return validation.stale_versions(rows, rows.groupBy("item_id").agg(F.max("version").alias("version")))


@query(f"WITH {V.LEDGER} SELECT user_id AS subject_id, 'contradiction_not_surfaced' AS code FROM ledger GROUP BY user_id HAVING len(list_filter(coalesce(list(DISTINCT k) FILTER (event_type = 'error'), []), lambda x: NOT list_contains(coalesce(list(DISTINCT k) FILTER (event_type = 'purchase'), []), x))) > 0")
def unsurfaced_contradictions(spark, d):
    pick = lambda kind: F.collect_set(F.when(F.col("event_type") == kind, F.col("k")))
    rows = derive.ledger(spark, d).groupBy(F.col("user_id").alias("subject")).agg(pick("error").alias("blocking"), pick("purchase").alias("surfaced"))
    return validation.unsurfaced(rows)


@query("SELECT event_id AS subject_id, 'human_approval_required' AS code FROM events WHERE event_type IN ('purchase', 'error') AND user_id % 2 = 0")
def approvals_required(spark, d):
    kind = F.when(F.col("event_type") == "purchase", F.lit("brief")).when(F.col("event_type") == "error", F.lit("delete")).otherwise(F.lit("note"))
    rows = table(spark, d, "events").select(F.col("event_id").alias("proposal_id"), kind.alias("target_type"), (F.col("user_id") % 2 == 1).alias("approval_required"))
    return validation.approval_required(rows)


_DECIDED = f"""decided AS (SELECT 'mem_' || (event_id % 2000) || '_0' AS claim_id, CASE event_id % 3 WHEN 0 THEN 'corrected' ELSE 'verified' END AS decision, CASE WHEN event_id % 2 = 0 THEN 'x' END AS correction FROM events)"""


def _decided(spark, d):
    return table(spark, d, "events").select(
        F.concat(F.lit("mem_"), (F.col("event_id") % 2000).cast("string"), F.lit("_0")).alias("claim_id"),
        F.when(F.col("event_id") % 3 == 0, F.lit("corrected")).otherwise(F.lit("verified")).alias("decision"), F.when(F.col("event_id") % 2 == 0, F.lit("x")).alias("correction"),
    )


@query(f"""WITH {V.CLAIMS}, {_DECIDED} SELECT DISTINCT claim_id AS subject_id, 'unknown_candidate' AS code FROM decided WHERE claim_id NOT IN (SELECT claim_id FROM claims)
UNION SELECT claim_id, 'duplicate_decision' FROM decided GROUP BY 1 HAVING count(*) > 1 UNION SELECT claim_id, 'correction_missing' FROM decided WHERE decision = 'corrected' AND correction IS NULL""")
def verifier_decision_issues(spark, d):
    return validation.decision_issues(_decided(spark, d), derive.claims(spark, d)).distinct()


@query(f"""WITH {V.LEDGER} SELECT event_id, (CASE WHEN event_id % 2 = 0 THEN k + 1 ELSE k END)::VARCHAR AS k, event_type AS kind, CASE WHEN event_id % 3 = 0 THEN 'yes' END AS added FROM ledger""")
def merged_qualifiers(spark, d):
    entry = lambda name, value: F.struct(F.lit(name).alias("key"), value.alias("value"))
    rows = derive.ledger(spark, d)
    original = F.map_from_entries(F.array(entry("k", F.col("k").cast("string")), entry("kind", F.col("event_type"))))
    fixes = F.array_compact(F.array(
        F.when(F.col("event_id") % 2 == 0, entry("k", (F.col("k") + 1).cast("string"))), F.when(F.col("event_id") % 3 == 0, entry("added", F.lit("yes"))),
    ))
    merged = validation.merge_qualifiers(original, F.map_from_entries(fixes))
    return rows.select("event_id", merged.alias("m")).select("event_id", F.col("m")["k"].alias("k"), F.col("m")["kind"].alias("kind"), F.col("m")["added"].alias("added"))


@query("""WITH c AS (SELECT conv_id, count(*) AS n, bool_or(turn % 4 = 3) AS bare FROM conversations WHERE turn > 0 OR conv_id % 3 = 0 GROUP BY 1)
SELECT conv_id AS subject_id, 'conflict_requires_members' AS code FROM c WHERE n < 2 UNION ALL SELECT conv_id, 'conflict_member_missing_evidence' FROM c WHERE bare""")
def conflict_issues(spark, d):
    proof = F.when(F.col("turn") % 4 == 3, _empty()).otherwise(F.array(F.lit("ev")))
    rows = table(spark, d, "conversations").where("turn > 0 or conv_id % 3 = 0").groupBy(F.col("conv_id").alias("conflict_id")).agg(
        F.collect_list(F.struct(F.col("turn"), proof.alias("evidence"))).alias("members")
    )
    return validation.conflict_issues(rows)


_TRIED = """tried AS (SELECT event_id % 3000 AS candidate_id, event_type AS connection_type, value / 100 AS confidence, CASE WHEN event_id % 5 = 0 THEN 'b' ELSE 'a' END AS e FROM events)"""


@query(f"""WITH {_TRIED}, known AS (SELECT DISTINCT event_id % 3000 AS candidate_id FROM events WHERE event_id % 6 <> 5)
SELECT candidate_id AS subject_id, 'unknown_candidate' AS code FROM tried WHERE candidate_id NOT IN (SELECT candidate_id FROM known) UNION SELECT candidate_id, 'duplicate_decision' FROM tried GROUP BY 1 HAVING count(*) > 1
UNION SELECT candidate_id, 'unknown_connection_type' FROM tried WHERE connection_type = 'error' UNION SELECT candidate_id, 'invalid_connection_confidence' FROM tried WHERE confidence > 1
UNION SELECT candidate_id, 'unavailable_evidence' FROM tried JOIN known USING (candidate_id) WHERE e = 'b'""")
def connection_decision_issues(spark, d):
    events = table(spark, d, "events")
    rows = events.select(
        (F.col("event_id") % 3000).alias("candidate_id"), F.col("event_type").alias("connection_type"), (F.col("value") / 100).alias("confidence"),
        F.when(F.col("event_id") % 5 == 0, F.array(F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("evidence"),
    )
    known = events.where("event_id % 6 <> 5").select((F.col("event_id") % 3000).alias("candidate_id"), F.array(F.lit("a")).alias("evidence")).distinct()
    return validation.connection_decision_issues(rows, known, ["view", "click", "purchase", "search", "login", "logout", "signup"])


@query("""WITH l AS (SELECT user_id AS query_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 60 AS claim_id FROM events)
SELECT DISTINCT query_id, 'unknown_claim' AS code FROM l WHERE claim_id >= 50 UNION SELECT query_id, 'duplicate_claim' FROM l GROUP BY query_id, claim_id HAVING count(*) > 1""")
def rerank_list_issues(spark, d):
    rows = derive.ledger(spark, d).select(F.col("user_id").alias("query_id"), (F.col("k") % 60).alias("claim_id"))
    known = rows.select("query_id").distinct().select("query_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(49).cast("long"))).alias("claim_id"))
    return validation.listing_issues(rows, known)


@query(f"""WITH {V.CLAIMS}, cites AS (SELECT conv_id AS answer_id, 'mem_' || conv_id || '_' || turn % 3 AS claim_id, 'ev_' || conv_id || '_' || turn * 5 + 1 AS span_id FROM conversations),
own AS (SELECT DISTINCT claim_id, unnest(evidence) AS span_id FROM claims)
SELECT answer_id AS subject_id, 'unknown_claim' AS code FROM cites WHERE claim_id NOT IN (SELECT claim_id FROM claims) UNION SELECT answer_id, 'unknown_evidence' FROM cites WHERE span_id NOT IN (SELECT span_id FROM own)
UNION SELECT answer_id, 'evidence_outside_claim' FROM cites c WHERE claim_id IN (SELECT claim_id FROM claims) AND span_id IN (SELECT span_id FROM own) AND (claim_id, span_id) NOT IN (SELECT claim_id, span_id FROM own)""")
def answer_citation_issues(spark, d):
    claims = derive.claims(spark, d)
    cites = table(spark, d, "conversations").select(
        F.col("conv_id").alias("answer_id"), F.concat(F.lit("mem_"), "conv_id", F.lit("_"), F.col("turn") % 3).alias("claim_id"),
        F.concat(F.lit("ev_"), "conv_id", F.lit("_"), F.col("turn") * 5 + 1).alias("span_id"),
    )
    return validation.citation_issues(cites, claims, derive.claim_evidence(claims))


@query("""WITH v AS (SELECT vec_id // 150 AS batch_id, CASE WHEN vec_id % 331 = 0 THEN 63 ELSE 64 END AS size FROM embeddings), g AS (SELECT batch_id, count(*) AS n, count(*) FILTER (size <> 64) AS wrong FROM v GROUP BY 1)
SELECT batch_id AS subject_id, code FROM (SELECT batch_id, unnest([CASE WHEN n - batch_id % 2 > 128 THEN 'too_many_inputs' END, CASE WHEN batch_id % 2 = 1 THEN 'count_mismatch' END, CASE WHEN wrong > 0 THEN 'wrong_dimension' END]) AS code FROM g) WHERE code IS NOT NULL""")
def embedding_batch_issues(spark, d):
    cut = F.when(F.col("vec_id") % 331 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    vectors = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 150).alias("batch_id"), cut.alias("embedding"))
    batches = vectors.groupBy("batch_id").agg((F.count("*") - F.max(F.col("batch_id") % 2)).alias("n_inputs"))
    return validation.embedding_batch_issues(batches, vectors, 64)


@query(f"""WITH {V.CLAIMS}, a AS (SELECT claim_id, source_version_id, action, replacement, cited FROM (SELECT claim_id, 'srcv_' || doc_id AS source_version_id, CASE doc_id % 3 WHEN 0 THEN 'edit' WHEN 1 THEN 'confirm' ELSE 'remove' END AS action,
 CASE WHEN doc_id % 4 < 2 THEN 'new' END AS replacement, 'ev_' || CASE WHEN doc_id % 5 = 0 THEN doc_id + 1 ELSE doc_id END || '_1' AS cited FROM claims))
SELECT claim_id AS subject_id, 'replacement_mismatch' AS code FROM a WHERE (action = 'edit') <> (replacement IS NOT NULL)
UNION ALL SELECT DISTINCT claim_id, 'evidence_outside_version' FROM a WHERE action = 'edit' AND (source_version_id, cited) NOT IN (SELECT source_version_id, span_id FROM spans)""")
def review_action_issues(spark, d):
    action = F.element_at(F.array(F.lit("edit"), F.lit("confirm"), F.lit("remove")), (F.col("doc_id") % 3 + 1).cast("int"))
    cited = F.concat(F.lit("ev_"), F.when(F.col("doc_id") % 5 == 0, F.col("doc_id") + 1).otherwise(F.col("doc_id")), F.lit("_1"))
    rows = derive.claims(spark, d).select(
        "claim_id", F.concat(F.lit("srcv_"), "doc_id").alias("source_version_id"), action.alias("action"), F.when(F.col("doc_id") % 4 < 2, F.lit("new")).alias("replacement"),
        F.array(cited).alias("replacement_evidence"),
    )
    found = validation.review_action_issues(rows, derive.spans(spark, d))
    return found.toDF("subject_id", "code")


# E: review --------------------------------------------------------------------------------


@query("SELECT event_id AS proposal_id FROM events WHERE value > 20 AND event_type IN ('purchase', 'click') AND user_id % 3 <> 0 ORDER BY ts DESC, event_id LIMIT 100")
def pending_reviews(spark, d):
    rows = table(spark, d, "events").select(
        F.col("event_id").alias("proposal_id"), (F.col("value") > 20).alias("valid"), F.col("event_type").isin("purchase", "click").alias("approval_required"),
        F.when(F.col("user_id") % 3 != 0, F.lit("pending")).otherwise(F.lit("approved")).alias("status"), F.col("ts").alias("created_at"),
    )
    return review.pending_reviews(rows).select("proposal_id")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, CASE WHEN arg_max(event_type, (ts, event_id)) = 'error' THEN 'code ' || arg_max(json_extract_string(props, '$.k'), (ts, event_id)) END AS error FROM events GROUP BY 1")
def ingestion_statuses(spark, d):
    rows = derive.ledger(spark, d).select("user_id", "ts", "event_id", F.col("event_type").alias("status"), F.concat(F.lit("code "), F.col("k").cast("string")).alias("error"))
    return review.ingestion_status(rows, "user_id", "error")


# G: retrieval inputs ----------------------------------------------------------------------


@query("SELECT vec_id % 40 AS target_id, min(vec_id) AS vec_id FROM embeddings WHERE vec_id % 3 <> 0 AND vec_id % 40 NOT IN (SELECT vec_id % 40 FROM embeddings WHERE vec_id % 3 = 0 AND vec_id % 40 < 10) GROUP BY 1")
def upserted_embeddings(spark, d):
    rows = table(spark, d, "embeddings").select(
        F.lit("claim").alias("target_type"), (F.col("vec_id") % 40).alias("target_id"), F.lit("m").alias("model"), (F.col("vec_id") % 40).alias("text_hash"), "vec_id"
    )
    found = retrieval.upsert_embeddings(rows.where("vec_id % 3 = 0 and target_id < 10"), rows.where("vec_id % 3 <> 0"), ["vec_id"])
    return found.select("target_id", "vec_id")


@query(f"""WITH {V.CLAIMS} SELECT target_type, count(*) AS n_targets, sum(length(text))::BIGINT AS n_chars FROM (
 SELECT 'claim' AS target_type, statement AS text FROM claims UNION ALL SELECT 'evidence_span', text FROM spans UNION ALL SELECT 'entity', min(source) FROM claims GROUP BY lower(source)
 UNION ALL SELECT 'schema_pattern', min(lang || ' states ' || source) FROM claims GROUP BY lower(lang || ' states ' || source)) GROUP BY 1""")
def embedding_targets(spark, d):
    rows = derive.claims(spark, d)
    parts = review.claim_tables(rows)
    found = retrieval.embedding_targets(rows, derive.spans(spark, d), parts["entities"], parts["schemas"])
    return found.groupBy("target_type").agg(F.count("*").alias("n_targets"), F.sum(F.length("text")).cast("long").alias("n_chars"))


@query("SELECT a.vec_id, round(greatest(0, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def neighbour_cosines(spark, d):
    rows = table(spark, d, "embeddings")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rounded(rows.join(after, "vec_id").select("vec_id", retrieval.cosine(F.col("embedding"), F.col("other")).alias("score")), "score")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id AS target_id, greatest(0, round(list_cosine_similarity(e::DOUBLE[], embedding::DOUBLE[]), 9)) AS score FROM q, embeddings WHERE vec_id % 7 <> 3),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, target_id) AS rank FROM s)
SELECT query_id, target_id, round(score, 6) AS score FROM r WHERE rank <= 64 AND score >= 0.2 AND query_id <> target_id""")
def similar_active_pairs(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("target_id"), "embedding")
    found = retrieval.similar_pairs(rows.where("target_id % 20 = 0").withColumnRenamed("target_id", "query_id"), rows, 0.2, without=rows.where("target_id % 7 = 3"))
    return rounded(found.select("query_id", "target_id", "score"), "score")


@query()
def indexed_candidates(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("target_id"), "embedding")
    queries = rows.where("target_id % 20 = 0").withColumnRenamed("target_id", "query_id")
    return rounded(vector_index.indexed_candidates(queries, vector_index.build_index(rows), 64), "score")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id AS target_id, greatest(0, round(list_cosine_similarity(e::DOUBLE[], embedding::DOUBLE[]), 9)) AS score FROM q, embeddings WHERE vec_id % 7 <> 3),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, target_id) AS rank FROM s)
SELECT query_id, target_id, round(score, 6) AS score FROM r WHERE rank <= 64 AND score >= 0.25 AND query_id <> target_id""")
def indexed_pairs(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("target_id"), "embedding")
    seeds = rows.where("target_id % 20 = 0").withColumnRenamed("target_id", "query_id")
    found = vector_index.indexed_pairs(seeds, vector_index.build_index(rows), 0.25, without=rows.where("target_id % 7 = 3"))
    return rounded(found.select("query_id", "target_id", "score"), "score")


# J: evaluation ----------------------------------------------------------------------------


@query("""WITH s AS (SELECT conv_id, CASE WHEN turn % 6 = 5 THEN turn - 1 ELSE turn END AS span_id, turn % 4 AS first_line, turn % 5 AS last_line FROM conversations)
SELECT conv_id AS fixture_id, 'duplicate_span' AS code FROM s GROUP BY conv_id, span_id HAVING count(*) > 1 UNION SELECT conv_id, 'bad_range' FROM s WHERE first_line < 1 OR last_line < first_line OR last_line > 3
UNION SELECT conv_id, 'missing_support' FROM s x WHERE NOT EXISTS (SELECT 1 FROM s y WHERE y.conv_id = x.conv_id AND y.span_id = 3)""")
def fixture_problems(spark, d):
    turn = F.col("turn")
    spans = table(spark, d, "conversations").select(
        F.col("conv_id").alias("fixture_id"), F.when(turn % 6 == 5, turn - 1).otherwise(turn).alias("span_id"), (turn % 4).alias("first_line"), (turn % 5).alias("last_line"), F.lit(3).alias("n_lines")
    )
    items = spans.select("fixture_id").distinct().withColumn("support", F.array(F.lit(3).cast("long")))
    return metrics.fixture_problems(spans, items)


@query("SELECT user_id, event_type, count(*) AS n_rows FROM events GROUP BY ALL HAVING count(*) > 1")
def duplicate_event_keys(spark, d):
    return metrics.duplicate_keys(table(spark, d, "events"), ["user_id", "event_type"])
