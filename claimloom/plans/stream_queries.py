"""Registered queries of routing, deadlines, chains and nested messages; streams run over the same tables until they are read up."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import text as T
from claimloom.operators import chains, cluster_versions, context, evidence, sections
from claimloom.plans import views as V
from claimloom.plans.queries import query
from claimloom.sources import derive
from claimloom.sources.derive import table
from claimloom.sources.shared import checkpointed, shared_folder
from claimloom.streaming import ledger, routing, runs

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_up(spark: SparkSession, stream: DataFrame, mode: str, schema: str) -> DataFrame:
    """What a stream puts out until its files are read up, from a folder that all machines share."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    names = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.shuffle.partitions": str(min(16, int(spark.conf.get("spark.sql.shuffle.partitions"))))}
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    try:
        def append(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")  # the same place if the batch runs again

        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/check").foreachBatch(append)
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        for n, v in before.items():
            spark.conf.set(n, v) if v is not None else spark.conf.unset(n)
    return spark.read.schema(schema).parquet(f"{folder}/out/batch=*")


def _events_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream: the folder is watched for that file, or the folder of that name for its files."""
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")


# A7 ---------------------------------------------------------------------------------------


@query(f"""WITH p AS (SELECT conv_id, turn, [text, text, role] || CASE WHEN turn % 5 = 0 THEN [] ELSE ['turn ' || turn, substr(text, 1, 20), role] END AS parts FROM conversations),
q AS (SELECT conv_id, turn, list_filter(list_transform(parts, lambda x: {V.TRIM.format("regexp_replace(x, '\\r\\n?', chr(10), 'g')")}), lambda x: length(x) > 0) AS parts FROM p)
SELECT conv_id, turn, sha256(array_to_string(list_filter(parts, lambda x, i: list_position(parts, x) = i), chr(10) || chr(10))) AS content_hash FROM q""")
def nested_messages(spark, d):
    js = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    lit = F.lit
    blocks = F.concat(lit('[{"type":"section","text":{"type":"x","text":'), js("text"), lit('}},{"elements":[{"inner":{"deep":[{"footer":'), js("role"), lit(',"skip":"no"}]}}]}]'))
    attachments = F.concat(
        lit('[{"title":'), js("role"), lit(',"fallback":'), js("substring(text, 1, 20)"), lit(',"title":'), js("concat('turn ', turn)"), lit('},"loose",{"other":"x","author_name":'), js("role"), lit("}]"))
    rows = table(spark, d, "conversations").withColumn("blocks", blocks).withColumn("attachments", F.when(F.col("turn") % 5 == 0, lit('[{"text":')).otherwise(attachments))
    body = evidence.nested_message_content(F.col("text"), F.col("blocks"), F.col("attachments"))
    return rows.select("conv_id", "turn", F.sha2(body, 256).alias("content_hash"))


# B1 ---------------------------------------------------------------------------------------


@query("""
WITH m AS (SELECT event_id AS message_id, user_id AS channel, epoch(ts)::BIGINT AS ts, event_type FROM events),
near AS (
  SELECT s.message_id AS selected_id, o.message_id, CASE WHEN o.ts < s.ts THEN 'before' ELSE 'after' END AS side, abs(o.ts - s.ts) AS gap
  FROM m s JOIN m o ON s.channel = o.channel AND abs(o.ts - s.ts) <= 1800 AND o.ts <> s.ts WHERE s.event_type = 'purchase' AND o.message_id % 4 <> 1 AND o.message_id % 6 <> 2
), ranked AS (SELECT *, row_number() OVER (PARTITION BY selected_id, side ORDER BY gap, message_id) AS place FROM near)
SELECT selected_id, message_id, side, place FROM ranked WHERE place <= CASE side WHEN 'before' THEN 5 ELSE 3 END""")
def nearby_top_level_messages(spark, d):
    """Every fourth message answers in a thread, every sixth is a system's, another sixth a bot's (which counts)."""
    number = F.col("event_id")
    rows = table(spark, d, "events").select(
        number.alias("message_id"), F.col("user_id").alias("channel"), V.whole_seconds("ts").alias("ts"), "event_type",
        F.when(number % 4 == 1, F.lit("171.2")).when(number % 8 == 0, F.lit("")).alias("thread_ts"), F.when(number % 6 == 2, F.lit("channel_join")).when(number % 6 == 3, F.lit("bot_message")).alias("subtype"))
    found = context.nearby_messages(context.top_level(rows), rows.where("event_type = 'purchase'"))
    return found.withColumn("place", F.col("place").cast("long"))


# C8 ---------------------------------------------------------------------------------------


def _halves(depth: int) -> str:
    """Paths after each depth: groups of more than 3,000 characters are cut at the span nearest to their middle."""
    parts = ["p0 AS (SELECT source_version_id, span_no, start_char, end_char, '' AS path FROM spans)"]
    for k in range(depth):
        parts.append(f"""g{k} AS (SELECT *, count(*) OVER w AS n, max(end_char) OVER w - min(start_char) OVER w AS total, lag(end_char) OVER (PARTITION BY source_version_id, path ORDER BY span_no) - min(start_char) OVER w AS before
  FROM p{k} WINDOW w AS (PARTITION BY source_version_id, path)), c{k} AS (SELECT source_version_id, path, arg_min(span_no, (abs(total / 2 - before), span_no)) AS split_at FROM g{k} WHERE n > 1 AND total > 3000 AND before IS NOT NULL GROUP BY 1, 2),
p{k + 1} AS (SELECT source_version_id, span_no, start_char, end_char, CASE WHEN split_at IS NULL THEN path WHEN span_no < split_at THEN path || '0' ELSE path || '1' END AS path FROM p{k} LEFT JOIN c{k} USING (source_version_id, path))""")
    return ", ".join(parts)


@query(f"WITH {V.SPANS}, {_halves(3)} SELECT source_version_id, path, count(*) AS n_spans, min(span_no)::BIGINT AS first_span FROM p3 GROUP BY 1, 2")
def saturated_sections(spark, d):
    """Documents cut in halves, at most three times, while a part has more than 3,000 characters."""
    found = sections.subdivide_saturated(derive.spans(spark, d), ["source_version_id"], lambda n, chars: chars > 3000)
    return found.groupBy("source_version_id", "path").agg(F.count("*").alias("n_spans"), F.min("span_no").cast("long").alias("first_span"))


# I2, I3 -----------------------------------------------------------------------------------

_TYPES = sorted({r[0] for r in routing.ROUTES})
_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
_SUBJECTS = ["memory", "source", "cluster", "section"]


def _loop_events(rows: DataFrame) -> DataFrame:
    """Ledger events whose type, subject, version and payload follow from their id, user and k."""
    k, number = F.get_json_object("props", "$.k").cast("long"), F.col("event_id")
    item = lambda values, at: F.element_at(T.words_array(values), (at + 1).cast("int"))
    some = lambda name, n, of, prefix: F.when(F.pmod(k, F.lit(n)) == 0, F.concat(F.lit(prefix), F.pmod(of, F.lit(7)))).alias(name)
    payload = F.to_json(F.struct(
        some("memoryId", 2, F.col("user_id"), "m"), some("sourceVersionId", 3, F.col("user_id"), "v"), some("planId", 4, k, "p"),
        F.when(k % 5 > 0, k % 5).alias("completedSectionOrdinal"), some("clusterVersion", 2, k, "c"), some("generationIntent", 3, k, "g")))
    return rows.select(
        "event_id", "ts", item(_TYPES, F.pmod(number, F.lit(len(_TYPES)))).alias("event_type"), item(_SUBJECTS, F.pmod(number, F.lit(4))).alias("subject_type"),
        F.concat(F.lit("s"), F.col("user_id") % 30).alias("subject_id"), F.when(k % 3 == 0, F.concat(F.lit("i"), k % 10)).alias("input_version"),
        F.when(k % 11 != 0, payload).otherwise(F.lit("no json")).alias("payload"))


_ROUTED = f"""e AS (
  SELECT event_id, ts, k, {_LIST(_TYPES)}[event_id % {len(_TYPES)} + 1] AS event_type, {_LIST(_SUBJECTS)}[event_id % 4 + 1] AS subject_type, 's' || user_id % 30 AS subject_id,
    CASE WHEN k % 3 = 0 THEN 'i' || k % 10 END AS iv, event_id::VARCHAR AS id, k % 11 <> 0 AS ok,
    CASE WHEN ok AND k % 2 = 0 THEN 'm' || user_id % 7 END AS memory_id, CASE WHEN ok AND k % 3 = 0 THEN 'v' || user_id % 7 END AS source_id, CASE WHEN ok AND k % 4 = 0 THEN 'p' || k % 7 END AS plan_id,
    CASE WHEN ok AND k % 5 > 0 THEN (k % 5)::VARCHAR END AS ordinal, CASE WHEN ok AND k % 2 = 0 THEN 'c' || k % 7 END AS cluster_version, CASE WHEN ok AND k % 3 = 0 THEN 'g' || k % 7 END AS intent
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
), routes(event_type, policy, to_type) AS (VALUES {', '.join(str(r) for r in routing.ROUTES)}), routed AS (
  SELECT event_id, ts, policy, to_type AS subject_type,
    CASE WHEN policy = 'consolidate_memory' THEN coalesce(source_id, subject_id) WHEN to_type = subject_type THEN subject_id WHEN to_type = 'memory' THEN coalesce(memory_id, subject_id) ELSE subject_id END AS subject,
    CASE WHEN policy = 'consolidate_memory' THEN coalesce(plan_id, iv, id) || ':' || coalesce(ordinal, id) WHEN policy = 'synthesize_brief' THEN coalesce(cluster_version, iv, id) || ':' || coalesce(intent, 'initiative_brief')
      ELSE coalesce(iv, id || ':' || strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad((date_part('ms', ts)::BIGINT % 1000)::VARCHAR, 3, '0') || 'Z') END AS version
  FROM e JOIN routes USING (event_type)
)"""
_TASKS = f"WITH {_ROUTED} SELECT policy, subject_type, subject, version, event_id FROM routed QUALIFY row_number() OVER (PARTITION BY policy, subject_type, subject, version ORDER BY ts, event_id) = 1"


@query(f"WITH {_ROUTED} SELECT event_id, policy, subject_type, subject, version FROM routed")
def loop_routes(spark, d):
    return routing.route(_loop_events(table(spark, d, "events"))).drop("ts")


@query(_TASKS)
def loop_tasks(spark, d):
    return routing.tasks(routing.route(_loop_events(table(spark, d, "events")))).drop("ts")


@query(_TASKS)
def streamed_tasks(spark, d):
    stream = routing.stream_tasks(_loop_events(_events_stream(spark, d)))
    out = run_up(spark, stream, "update", "policy string, subject_type string, subject string, version string, event_id long, ts timestamp")
    return routing.tasks(out).drop("ts")  # a version that was given again keeps its first event


# I5 ---------------------------------------------------------------------------------------

_RUNS = """r AS (
  SELECT 'r' || user_id || '_' || k % 10 AS run_id, (k % 4 + 1)::INT AS attempt, CASE WHEN event_type IN ('view', 'signup') THEN 'started' ELSE 'finished' END AS kind, ts,
    CASE WHEN event_type IN ('view', 'signup') THEN 3600.0 * (1 + event_id % 48) END AS lease
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
), s AS (SELECT run_id, attempt, min(ts) AS started_at, arg_min(lease, (ts, lease)) AS lease FROM r WHERE kind = 'started' GROUP BY 1, 2
), l AS (SELECT run_id, attempt, started_at, started_at + to_microseconds((lease * 1000000)::BIGINT) AS deadline FROM s
), expired AS (
  SELECT *, CASE WHEN attempt >= 3 THEN 'terminal' ELSE 'retryable' END AS outcome FROM l
  WHERE deadline < (SELECT max(ts) FROM events) - INTERVAL 1 DAY AND NOT EXISTS (SELECT 1 FROM r WHERE r.run_id = l.run_id AND r.attempt = l.attempt AND kind = 'finished' AND ts BETWEEN started_at AND deadline)
)"""


def _runs(rows: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    starts = F.col("event_type").isin("view", "signup")
    return rows.select(
        F.concat(F.lit("r"), F.col("user_id"), F.lit("_"), k % 10).alias("run_id"), (k % 4 + 1).cast("int").alias("attempt"),
        F.when(starts, F.lit("started")).otherwise(F.lit("finished")).alias("kind"), F.col("ts").cast("timestamp").alias("ts"), F.when(starts, 3600.0 * (1 + F.col("event_id") % 48)).alias("lease_seconds"))


def _expired(rows: DataFrame) -> DataFrame:
    return runs.expired_runs(_runs(rows), F.lit(rows.agg(F.max("ts")).first()[0]).cast("timestamp") - F.expr("interval 1 day"))


def _plain(found: DataFrame) -> DataFrame:
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "deadline")})


@query(f"WITH {_RUNS} SELECT run_id, attempt, started_at, deadline, outcome FROM expired")
def expired_runs(spark, d):
    rows = table(spark, d, "events")
    return _plain(_expired(rows))


@query(f"WITH {_RUNS} SELECT outcome, count(*) AS n_runs, round(avg(date_diff('microsecond', started_at, deadline)) / 1000000, 6) AS mean_seconds FROM expired GROUP BY 1")
def expired_run_summary(spark, d):
    return runs.expired_summary(_expired(table(spark, d, "events"))).withColumn("mean_seconds", F.round("mean_seconds", 6))


@query(f"WITH {_RUNS} SELECT run_id, attempt, started_at, deadline, outcome FROM expired")
def streamed_expired_runs(spark, d):
    # Events of one file come in any order: the watermark stays a day behind the latest of them.
    return _plain(run_up(spark, runs.stream_expired_runs(_runs(_events_stream(spark, d)), "1 day"), "append", runs.RESULT))


# I13 --------------------------------------------------------------------------------------

_SKETCH = """sketch AS (
  SELECT event_type AS policy, date_trunc('hour', ts) AS hour, CASE WHEN value > 0 THEN floor(ln(value) / ln(1.02::DOUBLE))::BIGINT END AS bucket, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2, 3
), days AS (SELECT policy, bucket, sum(n) AS n FROM sketch GROUP BY 1, 2), ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY policy ORDER BY bucket NULLS FIRST) AS upto, sum(n) OVER (PARTITION BY policy) AS every FROM days
)"""


@query(f"WITH {_SKETCH} SELECT policy, round(arg_min(pow(1.02::DOUBLE, bucket + 0.5), upto), 6) AS p95_latency FROM ranked WHERE upto >= ceil(0.95 * every) GROUP BY 1")
def latency_quantiles(spark, d):
    """Sketches stored per hour and policy, merged to policies, read at 95 per cent."""
    rows = table(spark, d, "events").select(F.date_trunc("hour", "ts").alias("hour"), F.col("event_type").alias("policy"), F.col("value").alias("latency"))
    merged = ledger.merge_sketches(ledger.latency_sketch(rows, ["hour", "policy"]), ["policy"])
    return ledger.sketch_quantile(merged, ["policy"], 0.95, "p95_latency").withColumn("p95_latency", F.round("p95_latency", 6))


# H11, H12 ---------------------------------------------------------------------------------

_VERSIONS = f"""m AS (SELECT 'entity:' || source AS cluster_key, claim_id, 0.9 AS score, doc_id FROM claims UNION ALL SELECT 'tag:' || lang || ':' || claim_type, claim_id, 0.82, doc_id FROM claims),
e0 AS (SELECT 'x' || doc_id AS conflict_id, 'mem_' || (doc_id + unnest([0, 1])) || '_0' AS claim_id, 'open' AS status FROM documents), e1 AS (SELECT conflict_id, claim_id, CASE WHEN substr(conflict_id, 2)::BIGINT % 50 = 0 THEN 'resolved' ELSE status END AS status FROM e0),
s AS (SELECT cluster_key, claim_id, ('0x' || substr(md5(claim_id || ':' || printf('%.3f', score)), 1, 12))::BIGINT::HUGEINT AS h, doc_id FROM m),
h0 AS (SELECT claim_id, sum(('0x' || substr(md5(conflict_id || ':' || status || ':warning'), 1, 12))::BIGINT::HUGEINT) AS h FROM e0 GROUP BY 1), h1 AS (SELECT claim_id, sum(('0x' || substr(md5(conflict_id || ':' || status || ':warning'), 1, 12))::BIGINT::HUGEINT) AS h FROM e1 GROUP BY 1),
v0 AS (SELECT cluster_key, count(*) AS n, sha256(cluster_key || '|' || sum(s.h) || '|' || coalesce(sum(h0.h), 0)) AS version FROM s LEFT JOIN h0 USING (claim_id) WHERE doc_id % 25 <> 0 GROUP BY 1),
v1 AS (SELECT cluster_key, count(*) AS n, sha256(cluster_key || '|' || sum(s.h) || '|' || coalesce(sum(h1.h), 0)) AS version FROM s LEFT JOIN h1 USING (claim_id) WHERE doc_id % 40 <> 1 GROUP BY 1)"""


@query(f"""WITH {V.CLAIMS}, {_VERSIONS} SELECT cluster_key, v1.n AS n_members, v1.version, CASE WHEN v0.version = v1.version THEN 0 ELSE 1 END AS last_change,
CASE WHEN v1.n > 1 AND coalesce(v0.n, 0) < 2 THEN 'new' WHEN v1.n < 2 AND coalesce(v0.n, 0) > 1 THEN 'superseded' WHEN v1.n > 1 AND v0.version = v1.version THEN 'unchanged' WHEN v1.n > 1 THEN 'changed' END AS change FROM v1 LEFT JOIN v0 USING (cluster_key)""")
def kept_cluster_versions(spark, d):
    """Clusters of entities and of tagged claim types over two days: documents came and went, and some conflicts were resolved."""
    rows = checkpointed(derive.claims(spark, d).select("claim_id", "doc_id", "source", "lang", "claim_type"))
    every = rows.select("doc_id", F.concat(F.lit("entity:"), "source").alias("cluster_key"), "claim_id", F.lit(0.9).alias("score")).union(
        rows.select("doc_id", F.concat(F.lit("tag:"), "lang", F.lit(":"), "claim_type"), "claim_id", F.lit(0.82)))
    before, after = "doc_id % 25 <> 0", "doc_id % 40 <> 1"
    part = lambda where: every.where(where).drop("doc_id")
    ends = table(spark, d, "documents").select(
        F.concat(F.lit("x"), "doc_id").alias("conflict_id"), F.explode(F.array("doc_id", F.col("doc_id") + 1)).alias("doc"), (F.col("doc_id") % 50 == 0).alias("over"))
    state = lambda where, status: ends.where(where).select("conflict_id", F.concat(F.lit("mem_"), "doc", F.lit("_0")).alias("claim_id"), status.alias("status"), F.lit("warning").alias("severity"))
    first, last = state("true", F.lit("open")), state("true", F.when(F.col("over"), F.lit("resolved")).otherwise(F.lit("open")))
    old = cluster_versions.cluster_state(part(before), first, F.lit(0))
    new = cluster_versions.update_state(
        old, part(before), last, part(f"{after} and not ({before})"), part(f"{before} and not ({after})"),
        state("over", F.lit("resolved")), state("over", F.lit("open")), F.lit(1))
    return new.where("n_members > 0").select("cluster_key", "n_members", "version", "last_change", "change")


# I15, E4 ----------------------------------------------------------------------------------


@query(f"""WITH {V.LEDGER}, o AS (SELECT event_id, user_id, row_number() OVER w - 1 AS depth, first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS root FROM ledger WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id AS id, CASE WHEN user_id % 7 <> 0 THEN root END AS "end", CASE WHEN user_id % 7 <> 0 THEN depth END AS depth, user_id % 7 = 0 AS in_cycle FROM o""")
def causal_roots(spark, d):
    from pyspark.sql import Window

    rows = derive.ledger(spark, d)
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    whole = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.lag("event_id").over(order)
    # The first event of every seventh user is caused by the user's last: a cycle.
    cause = F.coalesce(before, F.when(F.col("user_id") % 7 == 0, F.last("event_id").over(whole)))
    return chains.chain_ends(rows.select(F.col("event_id").alias("id"), cause.alias("to")))


@query(f"""WITH {V.REVIEWS}, e AS (SELECT claim_id, row_number() OVER (PARTITION BY claim_id ORDER BY ts, event_id) AS n FROM reviews WHERE review = 'edit'),
c AS (SELECT claim_id, max(n) AS n FROM e GROUP BY 1) SELECT claim_id || '#' || g.i AS id, claim_id || '#' || n AS "end", n - g.i AS depth, false AS in_cycle FROM c, generate_series(0, n) AS g(i)""")
def last_replacements(spark, d):
    from pyspark.sql import Window

    reviews = derive.review_events(derive.ledger(spark, d), table(spark, d, "documents").count()).where("review = 'edit'")
    n = F.row_number().over(Window.partitionBy("claim_id").orderBy("ts", "event_id"))
    version = lambda at: F.concat_ws("#", "claim_id", at.cast("string"))
    return chains.chain_ends(reviews.withColumn("n", n).select(version(F.col("n") - 1).alias("id"), version(F.col("n")).alias("to")))
