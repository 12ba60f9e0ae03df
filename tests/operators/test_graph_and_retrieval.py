import datetime
import random

from pyspark.sql import functions as F

from claimloom.operators import context, graph, retrieval, synthesis, validation
from claimloom.streaming import ledger


def claims(spark, rows):
    return spark.createDataFrame(
        rows, "claim_id string, source_version_id string, statement string, claim_type string, evidence array<string>, "
        "entities array<string>, schemas array<string>, relations array<string>, subjects array<string>")


def test_connections_lose_no_pair(spark):
    rng = random.Random(4)
    types = ["risk", "dependency", "fact", "ownership_statement", "reported_decision"]
    pick = lambda p, n: [f"{p}{rng.randint(0, 1)}" for _ in range(rng.randint(0, n))]
    rows = [(f"c{i:03}", f"v{rng.randint(0, 25)}", " ".join(rng.choices([f"word{k}" for k in range(8)], k=rng.randint(1, 5))), rng.choice(types),
             pick("ev", 1), pick("ent", 2), pick("sch", 1), pick("rel", 1), []) for i in range(120)]
    features = graph.connection_features(claims(spark, rows))
    every = features.select(F.col("claim_id").alias("left_id")).crossJoin(features.select(F.col("claim_id").alias("right_id"))).where("left_id < right_id")
    expected = {(r.from_id, r.to_id): r.confidence for r in graph.score_pairs(every, features).where("confidence >= 0.55").collect()}
    got = {(r.from_id, r.to_id): r.confidence for r in graph.connections(claims(spark, rows)).collect()}
    assert got == expected and len(got) > 50


def test_connection_candidates_are_the_best_of_all_pairs(spark):
    rng = random.Random(9)
    types = ["risk", "dependency", "fact", "metric", "user_signal", "ownership_statement", "reported_decision"]
    pick = lambda p, m, n: [f"{p}{rng.randint(0, m)}" for _ in range(rng.randint(0, n))]
    rows = [(f"c{i:03}", f"v{rng.randint(0, 60)}", " ".join(rng.choices([f"word{k}" for k in range(14)], k=rng.randint(1, 9))), rng.choice(types),
             pick("ev", 40, 1), pick("ent", 3, 2), pick("sch", 2, 2), pick("rel", 20, 1), []) for i in range(140)]
    features = graph.connection_features(claims(spark, rows))
    every = features.select(F.col("claim_id").alias("left_id")).crossJoin(features.select(F.col("claim_id").alias("right_id"))).where("left_id < right_id")
    for k in (4, 120):
        best: dict = {}
        for r in graph.score_pairs(every, features).collect():
            work = {r.left_claim_type, r.right_claim_type} & set(graph.WORK_SIGNALS)
            if r.confidence >= 0.12 or (r.grounded and work):
                best.setdefault(r.from_id, []).append((-r.confidence, r.to_id))
        expected = {(a, b, -c) for a, near in best.items() for c, b in sorted(near)[:k]}
        assert {(r.from_id, r.to_id, r.confidence) for r in graph.connection_candidates(claims(spark, rows), k).collect()} == expected


def test_conflicts(spark):
    rows = [("a", "v1", "launch plan approved for north region", "fact", [], ["North"], [], [], []),
            ("b", "v2", "north region blocked", "dependency", [], ["north"], [], [], []),
            ("c", "v3", "launch plan for north region not ready", "metric", [], [], [], [], []),
            ("d", "v4", "other subject blocked", "fact", [], [], [], [], [])]
    got = {(r.left_id, r.right_id): (r.conflict_type, r.severity) for r in graph.conflicts(claims(spark, rows)).collect()}
    assert got == {("a", "b"): ("decision", "blocking"), ("a", "c"): ("decision", "blocking")}


def test_pagerank_both_ways(spark):
    nodes = spark.createDataFrame([(q, n) for q in (1, 2) for n in "abcde"], "query_id long, node_id string")
    edges = spark.createDataFrame([(q, x, y, "t", w) for q in (1, 2) for x, y, w in (("a", "b", 1.0), ("b", "c", 0.5), ("c", "d", 0.0), ("a", "b", 0.4))],
                                  "query_id long, from_node string, to_node string, edge_type string, weight double")
    reset = spark.createDataFrame([(1, "a", 0.75)], "query_id long, node_id string, weight double")
    small = {(r.query_id, r.node_id): r.score for r in retrieval.personalized_pagerank(nodes, edges, reset, 12).collect()}
    wide = {(r.query_id, r.node_id): r.score for r in retrieval.personalized_pagerank_wide(nodes, edges, reset, 12).collect()}
    assert small.keys() == wide.keys()
    assert all(abs(small[k] - wide[k]) < 1e-9 for k in small)
    assert abs(sum(v for (q, _), v in small.items() if q == 1) - 1) < 1e-9
    assert small[1, "a"] > small[1, "b"] > small[1, "c"] > small[1, "d"] > small[1, "e"] == 0 and small[2, "e"] > 0


def test_prerank_reserves_places(spark):
    rows = [(1, f"g{i:02}", 1.0 - i / 100, 0.0, 0.0) for i in range(20)] + [(1, "direct", 0.01, 0.0, 1.0)]
    got = retrieval.prerank(spark.createDataFrame(rows, "query_id long, claim_id string, graph double, vector double, lexical double"), 5).collect()
    assert {r.claim_id for r in got} == {"g00", "g01", "g02", "g03", "direct"} and max(r.rank for r in got) == 5


def test_vector_candidates_match_plain_cosine(spark):
    rng = random.Random(2)
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(300)] + [(900, [0.0] * 8)]
    df = spark.createDataFrame(vectors, "target_id long, embedding array<double>").repartition(3)
    queries = df.where("target_id < 5").withColumnRenamed("target_id", "query_id")
    got = [(r.query_id, r.target_id) for r in retrieval.vector_candidates(queries, df, 7).orderBy("query_id", "rank").collect()]
    table = queries.crossJoin(df.withColumnRenamed("embedding", "other")).select(
        "query_id", "target_id", F.round(retrieval.cosine(F.col("embedding"), F.col("other")), 9).alias("s")).collect()
    expected = []
    for q in range(5):
        best = sorted((r for r in table if r.query_id == q), key=lambda r: (-r.s, r.target_id))[:7]
        expected += [(q, r.target_id) for r in best]
    assert got == expected


def brute_thread(messages, limit, chars):
    rows = sorted(messages)
    if len(rows) <= limit and sum(len(c) for _, c, _ in rows) <= chars:
        return [t for t, _, _ in rows]
    kept = {t: len(c) for t, c, r in rows if r != "other"}
    rest = [(t, len(c)) for t, c, r in rows if r == "other"]
    early, target = 0, (limit - len(kept)) // 2

    def add(t, n):
        if t in kept or len(kept) >= limit or sum(kept.values()) + n > chars:
            return False
        kept[t] = n
        return True

    for t, n in rest:
        if early >= target:
            break
        early += add(t, n)
    for t, n in reversed(rest):
        add(t, n)
    return sorted(kept)


def test_bound_thread_against_fold(spark):
    rng = random.Random(6)
    rows = []
    for thread in range(40):
        n = rng.randint(2, 16)
        rows += [(thread, t, "x" * rng.randint(0, 60), "root" if t == 0 else "selected" if t == n // 2 else "other") for t in range(n)]
    df = spark.createDataFrame(rows, "thread_id long, ts long, content string, role string")
    for r in context.bound_thread(df, 8, 200).collect():
        assert list(r.retained) == brute_thread([x[1:] for x in rows if x[0] == r.thread_id], 8, 200)
        assert len(r.retained) + len(r.omitted) == r.n_messages


def test_clusters_and_dossier(spark):
    rows = [(f"m{i}", f"alpha bravo statement{i}", ["Acme"], [], ["ops"], []) for i in range(3)]
    keyed = synthesis.cluster_keys(spark.createDataFrame(
        rows, "claim_id string, statement string, entities array<string>, relations array<string>, tags array<string>, schemas array<string>"))
    members = synthesis.discover_clusters(keyed).collect()
    assert {r.cluster_key for r in members} == {"entity:acme", "tag:ops", "topic:alpha", "topic:bravo"}
    assert {r.role for r in members if r.cluster_key == "entity:acme"} == {"core"}
    m = spark.createDataFrame([("k", f"c{i:02}", 1.0 - i / 100) for i in range(30)], "cluster_key string, claim_id string, score double")
    cost = spark.createDataFrame([(f"c{i:02}", 20_000 if i == 1 else 15_000 if i == 0 else 900) for i in range(30)], "claim_id string, cost long")
    got = [r.claim_id for r in synthesis.cluster_dossier(m, cost).orderBy("position").collect()]
    assert got == ["c00"] + [f"c{i:02}" for i in range(2, 17)]


def test_dossier_takes_members_at_any_place(spark):
    rng = random.Random(6)
    costs = {"k": [4000] * 150 + [1500, 900, 400], "two": [rng.randint(1, 9000) for _ in range(300)], "none": [30_001]}
    rows = [(k, f"{k}{i:03}", 1.0 - i / 1000, cost) for k, v in costs.items() for i, cost in enumerate(v)]
    df = spark.createDataFrame(rows, "cluster_key string, claim_id string, score double, cost long")
    expected = {}
    for k, claim, _, cost in rows:
        chars, ids = expected.get(k, (0, []))
        if chars + cost <= 30_000 and len(ids) < 16:
            expected[k] = (chars + cost, [*ids, claim])
    got = {}
    for r in synthesis.cluster_dossier(df.drop("cost"), df.select("claim_id", "cost")).orderBy("position").collect():
        got.setdefault(r.cluster_key, (r.n_chars, []))[1].append(r.claim_id)
    assert got == expected and got["k"][1][-2:] == ["k150", "k152"]


def test_routes(spark):
    rows = [(f"c{i}", "b", i, t) for i, t in enumerate(["one", "One!", "two", "three", "four", "five"])]
    df = spark.createDataFrame(rows, "claim_id string, batch string, ordinal int, statement string")
    issues = spark.createDataFrame([("c2", "x")], "subject_id string, code string")
    decisions = spark.createDataFrame([("c3", "verified", None), ("c4", "corrected", False)], "claim_id string, decision string, correction_valid boolean")
    got = {r.claim_id: r.route for r in validation.route_candidates(df, issues, decisions).collect()}
    assert got == {"c0": "review", "c1": "duplicate", "c2": "rejected", "c3": "auto", "c4": "review", "c5": "review"}


def test_enrichment_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    start = datetime.datetime(2024, 1, 1)
    rows = [(f"c{rng.randint(0, 4)}", rng.choice(ledger.FACETS), rng.choice(["completed", "completed", "failed"]),
             start + datetime.timedelta(minutes=rng.randint(0, 90)), i) for i in range(120)]
    df = spark.createDataFrame(rows, "claim_id string, facet string, outcome string, ts timestamp, event_id long")
    for k in range(3):
        df.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {}

    def keep(batch, number):
        for r in batch.collect():
            got[r.claim_id] = r.facets

    ledger.stream_enrichment(stream).writeStream.outputMode("update").foreachBatch(keep).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    batch = {}
    for r in ledger.enrichment_state(df).collect():
        batch.setdefault(r.claim_id, []).append(r.facet)
    assert {k: v for k, v in got.items() if v} == {k: ",".join(sorted(v)) for k, v in batch.items()}


def test_ledger_sink_is_idempotent(spark, tmp_path):
    schema = "event_id long, ts timestamp, idempotency_key string"
    spark.sql("select 1L event_id, timestamp'2024-01-01' ts, 'a' idempotency_key union all select 2, timestamp'2024-01-01', 'b' union all select 3, timestamp'2024-01-02', 'a'").write.parquet(str(tmp_path / "in"))
    run = lambda: ledger.write_upserts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    run()
    spark.sql("select 4L event_id, timestamp'2024-01-03' ts, 'b' idempotency_key union all select 5, timestamp'2024-01-03', 'c'").write.mode("append").parquet(str(tmp_path / "in"))
    run()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.idempotency_key, r.event_id) for r in got.collect()) == [("a", 1), ("b", 2), ("c", 5)]
