"""More registered queries: validators, logs and read models over the derived tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimloom.functions import text as T
from claimloom.functions.stemming import lexemes
from claimloom.operators import context, evidence, graph, metrics, neighborhoods, retrieval, review, sections, synthesis, validation, vector_index
from claimloom.plans import views as V
from claimloom.plans.queries import _CONNECTIONS, _graph_claims, _questions, _reviews, _sparse, _SPARSE, query, rounded
from claimloom.sources import derive
from claimloom.sources.derive import table
from claimloom.sources.shared import checkpointed
from claimloom.streaming import ledger as L


@query("SELECT conv_id, turn, sha256(concat_ws(chr(10) || chr(10), text, CASE WHEN role <> text THEN role END)) AS content_sha256 FROM (SELECT conv_id, turn, role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations)")
def message_contents(spark, d):
    rows = table(spark, d, "conversations")
    body = evidence.message_content(F.col("text"), F.array("role", "text"))
    return rows.select("conv_id", "turn", F.sha2(body, 256).alias("content_sha256"))


@query(f"WITH {V.SPANS} SELECT source_version_id, count(*) AS n_spans, sha256(string_agg(text, chr(10) ORDER BY line)) AS texts_sha256 FROM spans GROUP BY 1")
def spans_by_version(spark, d):
    found = evidence.spans_by_version(derive.spans(spark, d))
    texts = F.array_join(F.transform("spans", lambda s: s["text"]), "\n")
    return found.select("source_version_id", F.size("spans").cast("long").alias("n_spans"), F.sha2(texts, 256).alias("texts_sha256"))


@query(f"WITH {V.SPANS} SELECT doc_id, line::BIGINT AS line, length(text) <= 120 AND (regexp_matches(text, '^#{{1,6}}\\s') OR regexp_matches(text, '^[A-Z][^.!?]{{0,100}}:?$')) AS heading FROM spans")
def likely_headings(spark, d):
    return derive.spans(spark, d).select("doc_id", F.col("line").cast("long").alias("line"), T.is_likely_heading(F.col("text")).alias("heading"))


@query(f"WITH {V.CLAIMS} SELECT claim_id, array_to_string({V.TOPICS.format('statement')}[1:1], ',') AS first_topic, len({V.TOKENS.format('statement')})::BIGINT AS n_tokens FROM claims")
def claim_tokens(spark, d):
    return derive.claims(spark, d).select(
        "claim_id", F.coalesce(F.get(T.topic_tokens(F.col("statement")), 0), F.lit("")).alias("first_topic"),
        F.size(T.connection_tokens(F.col("statement"))).cast("long").alias("n_tokens"),
    )


@query("""SELECT conv_id, turn, CASE WHEN turn = m THEN 'selected' WHEN turn = 0 THEN 'thread_root' WHEN role = 'user' THEN 'thread_reply' ELSE 'nearby' END AS context_role
FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS m FROM conversations)""")
def context_roles(spark, d):
    rows = table(spark, d, "conversations").select(
        "conv_id", F.col("turn").alias("ts"), F.max("turn").over(Window.partitionBy("conv_id")).alias("selected_ts"), F.lit(0).alias("root_ts"),
        F.when(F.col("role") == "user", F.lit(0)).alias("thread_ts"),
    )
    return context.context_role(rows).select("conv_id", F.col("ts").alias("turn"), "context_role")


@query("""WITH s AS (SELECT conv_id, turn FROM conversations WHERE role = 'assistant'), c AS (SELECT conv_id, turn FROM conversations WHERE turn % 3 <> 1)
SELECT DISTINCT conv_id AS bundle_id, 'unknown_candidate' AS code FROM s WHERE (conv_id, turn) NOT IN (SELECT conv_id, turn FROM c)
UNION SELECT conv_id, 'too_many' FROM s GROUP BY 1 HAVING count(*) > 4""")
def nearby_selection_issues(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("bundle_id"), F.col("turn").alias("message_id"), "role")
    return context.nearby_selection_issues(rows.where("message_id % 3 <> 1"), rows.where("role = 'assistant'"))


@query("""SELECT conv_id AS plan_id, count(*) AS n_sections, count(*) FILTER (s = 'completed') AS n_completed, CASE WHEN count(*) FILTER (s = 'failed') > 0 THEN 'failed' WHEN count(*) FILTER (s = 'completed') = count(*) THEN 'completed'
 WHEN count(*) FILTER (s IN ('running', 'completed')) > 0 THEN 'extracting' ELSE 'planned' END AS phase FROM (SELECT conv_id, CASE WHEN turn % 7 = 6 THEN 'failed' WHEN turn % 5 = 4 THEN 'running' WHEN conv_id % 9 = 0 THEN 'pending' ELSE 'completed' END AS s FROM conversations) GROUP BY 1""")
def section_progress(spark, d):
    status = F.when(F.col("turn") % 7 == 6, F.lit("failed")).when(F.col("turn") % 5 == 4, F.lit("running")).when(F.col("conv_id") % 9 == 0, F.lit("pending")).otherwise(F.lit("completed"))
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("plan_id"), F.col("turn").alias("section"), status.alias("status"))
    return sections.section_progress(rows).select("plan_id", "n_sections", "n_completed", "phase")


@query(f"""WITH {V.LEDGER}, i AS (SELECT user_id, 'negative' AS code FROM ledger WHERE value < 10 UNION ALL SELECT user_id, 'error' FROM ledger WHERE event_type = 'error')
SELECT user_id::VARCHAR AS subject_id, string_agg(DISTINCT code, ',' ORDER BY code) AS codes, count(*) AS n FROM i GROUP BY 1""")
def merged_issues(spark, d):
    rows = derive.ledger(spark, d)
    issue = lambda where, code: rows.where(where).select(F.col("user_id").cast("string").alias("subject_id"), F.lit(code).alias("code"))
    return validation.merge(issue("value < 10", "negative"), issue("event_type = 'error'", "error"))


@query("""SELECT event_id AS connection_id, code FROM (SELECT event_id, unnest([CASE WHEN event_id % 7 = user_id % 7 THEN 'invalid_connection_claims' END, CASE WHEN value > 100 THEN 'invalid_connection_confidence' END,
 CASE WHEN event_id % 11 = 0 THEN 'connection_missing_evidence' END]) AS code FROM events) WHERE code IS NOT NULL""")
def connection_issues(spark, d):
    rows = table(spark, d, "events").select(
        F.col("event_id").alias("connection_id"), (F.col("event_id") % 7).alias("from_id"), (F.col("user_id") % 7).alias("to_id"), (F.col("value") / 100).alias("confidence"),
        F.when(F.col("event_id") % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("e"))).alias("evidence"),
    )
    return validation.connection_issues(rows).withColumnRenamed("subject_id", "connection_id")


@query("""WITH p AS (SELECT event_id AS proposal_id, value > 20 AS valid, event_type = 'purchase' AS approval_required, user_id % 2 = 0 AS approved FROM events)
SELECT proposal_id FROM p WHERE valid AND (NOT approval_required OR approved) AND proposal_id % 10 <> 0""")
def commit_gate(spark, d):
    rows = table(spark, d, "events").select(
        F.col("event_id").alias("proposal_id"), (F.col("value") > 20).alias("valid"), (F.col("event_type") == "purchase").alias("approval_required"), (F.col("user_id") % 2 == 0).alias("approved")
    )
    return validation.commit_gate(rows, rows.where("proposal_id % 10 = 0")).select("proposal_id")


@query(f"WITH {V.LEDGER} SELECT user_id::VARCHAR AS subject, 'duplicate_selection' AS code FROM ledger GROUP BY user_id HAVING count(k) <> count(DISTINCT k)")
def duplicate_selections(spark, d):
    rows = derive.ledger(spark, d).groupBy(F.col("user_id").cast("string").alias("subject")).agg(F.collect_list("k").alias("ids"))
    return validation.duplicate_selection(rows).select(F.col("subject_id").alias("subject"), "code")


@query(f"WITH {V.LEDGER} SELECT user_id::VARCHAR AS claim_id, arg_max(value, (ts, event_id)) FILTER (event_type = 'click') AS pinned, arg_max(value, (ts, event_id)) FILTER (event_type = 'error') AS excluded FROM ledger GROUP BY 1")
def claim_preferences(spark, d):
    rows = derive.ledger(spark, d).select(
        F.col("user_id").cast("string").alias("claim_id"), "ts", "event_id", F.when(F.col("event_type") == "click", F.col("value")).alias("pinned"),
        F.when(F.col("event_type") == "error", F.col("value")).alias("excluded"),
    )
    return review.preferences(rows)


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY 1")
def latest_statuses(spark, d):
    return review.latest_status(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"])


@query(f"""WITH {V.CLAIMS}, {V.REVIEWS} SELECT claim_id, statement_sha256, supersedes FROM (
  SELECT claim_id, sha256(statement) AS statement_sha256, NULL AS supersedes FROM claims
  UNION ALL SELECT claim_id || '~' || event_id, sha256('edited ' || event_id), claim_id FROM claims JOIN reviews USING (claim_id) WHERE review = 'edit')""")
def applied_reviews(spark, d):
    actions = _reviews(spark, d).select("claim_id", F.col("event_id").alias("action_id"), F.col("review").alias("action"), F.concat_ws(" ", F.lit("edited"), "event_id").alias("replacement"))
    found = review.apply_review_actions(derive.claims(spark, d), actions)
    return found.select("claim_id", F.sha2("statement", 256).alias("statement_sha256"), "supersedes")


@query(f"""WITH {V.CLAIMS}, {V.REVIEWS} SELECT claim_id FROM claims WHERE claim_id NOT IN (SELECT claim_id FROM reviews WHERE review IN ('remove', 'edit')) ORDER BY doc_id DESC, part DESC LIMIT 50""")
def newest_active_claims(spark, d):
    return review.list_active(derive.claims(spark, d), _reviews(spark, d), [F.desc("doc_id"), F.desc("part")], 50).select("claim_id")


@query(f"WITH {V.CLAIMS} SELECT claim_id, source AS subject, CASE claim_type WHEN 'risk' THEN 'threatens' WHEN 'dependency' THEN 'depends_on' WHEN 'reported_decision' THEN 'decides' ELSE 'states' END AS predicate FROM claims WHERE doc_id % 4 <> 0")
def backfilled_semantics(spark, d):
    rows = derive.claims(spark, d)
    return review.backfill_semantics(rows, rows.where("doc_id % 4 = 0")).select("claim_id", "subject", "predicate")


@query("""SELECT user_id AS from_id, event_id % 5 AS to_id, event_type AS connection_type, max(round(value / 100, 6)) AS confidence, arg_max(event_id, event_id) AS rationale FROM events GROUP BY 1, 2, 3""")
def upserted_connections(spark, d):
    rows = table(spark, d, "events").select(
        F.col("user_id").alias("from_id"), (F.col("event_id") % 5).alias("to_id"), F.col("event_type").alias("connection_type"), F.round(F.col("value") / 100, 6).alias("confidence"),
        F.col("event_id").alias("rationale"), F.col("event_id").alias("updated_at"),
    )
    return graph.upsert_connections(rows.where("rationale % 2 = 0"), rows.where("rationale % 2 = 1"))


@query(f"WITH {V.CLAIMS} SELECT 'claim' AS target_type, claim_id AS target_id FROM claims WHERE doc_id % 2 = 1 ORDER BY 1, 2 LIMIT 512")
def missing_embeddings(spark, d):
    rows = derive.claims(spark, d).select(F.lit("claim").alias("target_type"), F.col("claim_id").alias("target_id"), F.col("statement").alias("text"), "doc_id")
    have = rows.where("doc_id % 2 = 0").select("target_type", "target_id", F.lit("m").alias("model"))
    return retrieval.missing_embeddings(rows, have, "m").select("target_type", "target_id")


@query("SELECT vec_id // 3 AS target_id, max(vec_id) AS text_hash FROM embeddings GROUP BY 1")
def latest_embeddings(spark, d):
    rows = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 3).alias("target_id"), F.lit("m").alias("model"), F.col("vec_id").alias("created_at"), F.col("vec_id").alias("text_hash"))
    return retrieval.latest_embedding(rows).select("target_id", "text_hash")


@query(f"""WITH {V.CLAIMS}, {_SPARSE}, listed AS (SELECT query_id, claim_id, rank() OVER (PARTITION BY query_id ORDER BY claim_id DESC) AS position FROM sparse WHERE rank <= 12 AND rank % 3 = 0)
SELECT query_id, claim_id, row_number() OVER (PARTITION BY query_id ORDER BY position NULLS LAST, rank) AS final_rank FROM sparse LEFT JOIN listed USING (query_id, claim_id) WHERE rank <= 12""")
def reranked_claims(spark, d):
    ranked = _sparse(spark, d).where("rank <= 12")
    order = Window.partitionBy("query_id").orderBy(F.desc("claim_id"))
    lists = ranked.where("rank % 3 = 0").select("query_id", "claim_id", F.row_number().over(order).alias("position"))
    found = retrieval.rerank(ranked.select("query_id", "claim_id", "rank"), lists)
    return found.select("query_id", "claim_id", F.col("final_rank").cast("long").alias("final_rank"))


@query(f"WITH {V.CLAIMS}, {_SPARSE} SELECT query_id, 'sparse' AS source, 'claim' AS target_type, count(*) AS n FROM sparse WHERE rank <= 32 GROUP BY 1")
def seed_counts(spark, d):
    rows = _sparse(spark, d).select("query_id", F.lit("sparse").alias("source"), F.lit("claim").alias("target_type"))
    return retrieval.seed_counts(rows)


@query(f"""WITH {V.CLAIMS}, seeds AS (SELECT * FROM claims WHERE doc_id % 20 = 0),
l AS (SELECT DISTINCT s.claim_id AS seed_id, c.claim_id, 'evidence' AS reason, 3 AS w FROM seeds s JOIN claims c ON s.doc_id = c.doc_id AND s.claim_id <> c.claim_id
  UNION ALL SELECT s.claim_id, c.claim_id, 'entity', 1 FROM seeds s JOIN claims c ON s.source = c.source AND s.claim_id <> c.claim_id),
r AS (SELECT seed_id, claim_id, sum(w)::BIGINT AS score, row_number() OVER (PARTITION BY seed_id ORDER BY sum(w) DESC, claim_id) AS place FROM l GROUP BY 1, 2)
SELECT seed_id, claim_id, score FROM r WHERE place < 8""")
def synthesis_bundles(spark, d):
    rows = checkpointed(derive.claims(spark, d).select("claim_id", "doc_id", "source"))
    keyed = rows.select("claim_id", F.lit("evidence").alias("reason"), F.col("doc_id").cast("string").alias("key"), F.lit("strong").alias("strength")).union(
        rows.select("claim_id", F.lit("entity"), "source", F.lit("weak"))
    )
    found = synthesis.synthesis_bundle(rows.where("doc_id % 20 = 0"), keyed)
    return found.select("seed_id", "claim_id", F.col("score").cast("long").alias("score"))


@query(f"""WITH {V.CLAIMS}, t AS (SELECT claim_id, doc_id, {V.TOKENS.format("statement")} AS w, {V.TOKENS.format('statement')} AS k FROM claims)
SELECT a.claim_id AS seed_id, b.claim_id FROM t a JOIN t b ON a.claim_id <> b.claim_id AND a.doc_id % 20 = 0 AND len(a.w) > 0 AND len(list_intersect(a.w, b.k)) = len(a.w)""")
def text_matches(spark, d):
    rows = derive.claims(spark, d).select("claim_id", "doc_id", "statement")
    seeds = rows.where("doc_id % 20 = 0").select("claim_id", T.connection_tokens(F.col("statement")).alias("tokens"))
    return synthesis.text_match(seeds, rows.select("claim_id", T.connection_tokens(F.col("statement")).alias("tokens")))


def _seed_neighborhoods(spark, d, matches):
    rows = checkpointed(derive.claims(spark, d))
    active = review.active_claims(rows, _reviews(spark, d)).select("claim_id", F.col("doc_id").alias("created"))
    vectors = table(spark, d, "embeddings").select(F.concat(F.lit("mem_"), "vec_id", F.lit("_0")).alias("target_id"), "embedding", "vec_id")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("target_id").alias("query_id"), "embedding")
    similar = vector_index.indexed_pairs(asked, vector_index.build_index(vectors), 0.25)
    named = rows.select("claim_id", F.explode(F.array(F.concat(F.lit("entity:"), "source"), F.concat_ws(":", F.lit("schema"), "lang", "source"))).alias("key"))
    seeds = rows.where("doc_id % 20 = 0")
    found = neighborhoods.seed_neighborhoods(
        seeds.select(F.col("doc_id").alias("seed_group"), "claim_id"), active, graph.connections(_graph_claims(spark, d)), similar, named, matches(seeds, rows))
    return found.select("seed_group", "claim_id", F.col("priority").cast("long").alias("priority"), F.col("place").cast("long").alias("place"))


@query(f"""WITH {V.CLAIMS}, {V.REVIEWS}, {_CONNECTIONS}, act AS (SELECT claim_id, doc_id AS created FROM claims WHERE claim_id NOT IN (SELECT claim_id FROM reviews WHERE review IN ('remove', 'edit'))),
seeds AS (SELECT doc_id AS seed_group, claim_id, source FROM claims WHERE doc_id % 20 = 0), t AS (SELECT claim_id, doc_id, {V.TOKENS.format('statement')} AS k FROM claims),
v AS (SELECT 'mem_' || vec_id || '_0' AS id, vec_id, embedding::DOUBLE[] AS e FROM embeddings), scored AS (SELECT a.id AS q, b.id AS t, round(list_cosine_similarity(a.e, b.e), 9) AS score FROM v a JOIN v b ON a.vec_id % 20 = 0),
cos AS (SELECT q, t FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, t) AS n FROM scored) WHERE n <= 64 AND score >= 0.25 AND q <> t),
c AS (
  SELECT seed_group, claim_id, 0 AS priority FROM seeds UNION ALL SELECT seed_group, to_id, 1 FROM seeds JOIN connections ON from_id = claim_id UNION ALL SELECT seed_group, from_id, 1 FROM seeds JOIN connections ON to_id = claim_id
  UNION ALL SELECT seed_group, t, 1 FROM seeds JOIN cos ON q = claim_id UNION ALL SELECT seed_group, claims.claim_id, 2 FROM (SELECT DISTINCT seed_group, source FROM seeds) JOIN claims USING (source)
  UNION ALL SELECT a.doc_id, b.claim_id, 3 FROM t a JOIN t b ON a.claim_id <> b.claim_id AND a.doc_id % 20 = 0 AND len(a.k) > 0 AND len(list_intersect(a.k, b.k)) = len(a.k)
  UNION ALL SELECT seed_group, claims.claim_id, 4 FROM (SELECT DISTINCT seed_group FROM seeds), claims
), m AS (SELECT seed_group, claim_id, min(priority) AS priority FROM c GROUP BY 1, 2)
SELECT seed_group, claim_id, priority::BIGINT AS priority, place FROM (SELECT *, row_number() OVER (PARTITION BY seed_group ORDER BY priority, created DESC, claim_id) AS place FROM m JOIN act USING (claim_id)) WHERE place <= 500""")
def corpus_neighborhoods(spark, d):
    """Around each twentieth document's claims, with texts matched by their words as they are."""
    words = lambda df: df.select("claim_id", T.connection_tokens(F.col("statement")).alias("tokens"))
    return _seed_neighborhoods(spark, d, lambda seeds, rows: synthesis.text_match(words(seeds), words(rows)))


@query()
def stemmed_neighborhoods(spark, d):
    """The same with texts matched by their lexemes."""
    return _seed_neighborhoods(spark, d, lambda seeds, rows: synthesis.text_match(lexemes(seeds), lexemes(rows)))


@query()
def stemmed_text_matches(spark, d):
    rows = derive.claims(spark, d)
    return synthesis.text_match(lexemes(rows.where("doc_id % 20 = 0")), lexemes(rows))


@query(f"""WITH {V.LEDGER}, v AS (SELECT user_id AS draft_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, event_type, k FROM ledger)
SELECT draft_id, version, CASE WHEN version = 1 THEN '' ELSE concat_ws(',', CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 'event_type' END, CASE WHEN k IS DISTINCT FROM lag(k) OVER w THEN 'k' END) END AS changed
FROM v WINDOW w AS (PARTITION BY draft_id ORDER BY version)""")
def draft_changes(spark, d):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = derive.ledger(spark, d).select(F.col("user_id").alias("draft_id"), F.row_number().over(order).cast("long").alias("version"), "event_type", "k")
    return synthesis.draft_changes(rows, ["event_type", "k"])


@query(f"WITH {V.CLAIMS} SELECT claim_id FROM claims WHERE doc_id % 3 <> 0 ORDER BY doc_id, claim_id LIMIT 500")
def incremental_targets(spark, d):
    rows = derive.claims(spark, d).select("claim_id", F.lit(1).alias("version"), F.col("doc_id").alias("changed_at"))
    return synthesis.incremental_targets(rows, rows.where("changed_at % 3 = 0")).select("claim_id")


@query("SELECT event_id AS run_id, CASE WHEN event_id % 4 + 1 >= 3 THEN 'terminal' ELSE 'retryable' END AS outcome FROM events WHERE event_type <> 'purchase' AND ts + INTERVAL 1 HOUR < (SELECT max(ts) FROM events)")
def timed_out_runs(spark, d):
    rows = table(spark, d, "events")
    now = rows.agg(F.max("ts")).first()[0]
    runs = rows.select(
        F.col("event_id").alias("run_id"), F.when(F.col("event_type") == "purchase", F.col("ts")).alias("finished_at"), (F.col("ts") + F.expr("interval 1 hour")).alias("deadline"),
        (F.col("event_id") % 4 + 1).alias("attempts"),
    )
    return L.timed_out_runs(runs, F.lit(now))


@query("SELECT user_id::VARCHAR AS claim_id, arg_max(event_type, (ts, event_id)) AS reason FROM events GROUP BY 1")
def dirty_claims(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("claim_id"), F.col("event_type").alias("reason"), "ts", "event_id")
    return L.dirty_claims(rows)


@query("""SELECT user_id AS proposal_id, arg_max(value > 50, (ts, event_id)) FILTER (event_type = 'view') AS valid, coalesce(arg_max(CASE WHEN event_type = 'purchase' THEN 'approved' ELSE 'rejected' END, (ts, event_id)) FILTER (event_type IN ('purchase', 'error')), 'pending') AS decision
FROM events GROUP BY 1""")
def proposal_states(spark, d):
    kind = F.col("event_type")
    rows = table(spark, d, "events").select(
        F.col("user_id").alias("proposal_id"), "ts", "event_id", F.when(kind == "view", F.col("value") > 50).alias("valid"),
        F.when(kind == "purchase", F.lit("approved")).when(kind == "error", F.lit("rejected")).alias("decision"), F.lit(None).cast("string").alias("reviewer"),
    )
    return L.proposal_state(rows).select("proposal_id", "valid", "decision")


@query(f"""WITH {V.CLAIMS}, {_SPARSE}, g AS (SELECT query_id, list(claim_id) AS got FROM sparse WHERE rank <= 5 GROUP BY 1), tops AS (SELECT claim_id FROM sparse WHERE rank = 1 AND query_id % 3 = 0),
c AS (SELECT item_id AS case_id, coalesce(got, []) AS got, [CASE WHEN item_id % 2 = 0 THEN (SELECT min(claim_id) FROM sparse x WHERE x.query_id = item_id AND x.rank = 2) ELSE 'mem_none' END] AS expected, (SELECT list(DISTINCT claim_id) FROM tops) AS forbidden FROM benchmark LEFT JOIN g ON query_id = item_id),
n AS (SELECT case_id, len(got)::BIGINT AS n_returned, len(list_filter(expected, lambda x: NOT list_contains(got, x)))::BIGINT AS n_missing, len(list_intersect(forbidden, got))::BIGINT AS n_forbidden FROM c)
SELECT *, n_missing = 0 AND n_forbidden = 0 AND n_returned >= 3 AS passed FROM n""")
def retrieval_expectations(spark, d):
    """Even cases expect their second claim, odd ones a claim that is not there; the first claims of every third case are forbidden."""
    found = checkpointed(_sparse(spark, d).where("rank <= 5").select(F.col("query_id").alias("case_id"), "claim_id", "rank"))
    second = found.where("rank = 2").select("case_id", F.col("claim_id").alias("second"))
    forbidden = found.where("rank = 1 and case_id % 3 = 0").agg(F.collect_set("claim_id").alias("forbidden"))
    expected = F.array(F.when(F.col("case_id") % 2 == 0, F.col("second")).otherwise(F.lit("mem_none")))
    cases = _questions(spark, d).select(F.col("query_id").alias("case_id"), F.lit(3).alias("least")).join(second, "case_id", "left").join(F.broadcast(forbidden))
    checked = metrics.retrieval_expectations(cases.select("case_id", expected.alias("expected"), "forbidden", "least"), found)
    return checked.select("case_id", *[F.col(c).cast("long").alias(c) for c in ("n_returned", "n_missing", "n_forbidden")], "passed")
