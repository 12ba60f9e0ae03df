"""Streams against their batch views: order, repetition, lateness, restarts."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from claimloom.streaming import routing, runs

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
START = datetime.datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    yield spark
    spark.conf.set(name, before) if before else spark.conf.unset(name)


def feed(spark, rows, schema, folder, files):
    """The rows as Parquet files that a stream reads one by one."""
    size = -(-len(rows) // files)
    for k in range(files):
        part = rows[k * size:(k + 1) * size]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


EVENT = "event_id long, ts timestamp, event_type string, subject_type string, subject_id string, input_version string, payload string"


def events(n, seed):
    rng = random.Random(seed)
    kinds = sorted({r[0] for r in routing.ROUTES}) + ["unknown"]
    out = []
    for k in range(n):
        payload = {f: f"{f}{rng.randint(0, 2)}" for f in ("memoryId", "sourceVersionId", "planId", "clusterVersion", "generationIntent", "sectionId") if rng.random() < 0.4}
        if rng.random() < 0.3:
            payload["completedSectionOrdinal"] = rng.randint(1, 3)
        out.append((k, START + datetime.timedelta(seconds=rng.randint(0, 500)), rng.choice(kinds), rng.choice(["memory", "source", "cluster", "section"]),
                    f"s{rng.randint(0, 5)}", rng.choice([None, "v1", "v2"]), rng.choice([json.dumps(payload)] * 4 + ["not json", None])))
    return out


def plain_route(e):
    number, ts, kind, of, subject, version, payload = e
    try:
        body = json.loads(payload)
    except (TypeError, ValueError):
        body = {}
    text = lambda name: None if body.get(name) is None else str(body[name])
    for event_type, policy, to in routing.ROUTES:
        if event_type == kind:
            who = subject if to == of else text(f"{to}Id") or subject
            what = version or f"{number}:{ts.isoformat(timespec='milliseconds')}Z"
            if policy == "consolidate_memory":
                who = text("sourceVersionId") or subject
                what = f"{text('planId') or version or number}:{text('completedSectionOrdinal') or number}"
            if policy == "synthesize_brief":
                what = f"{text('clusterVersion') or version or number}:{text('generationIntent') or 'initiative_brief'}"
            yield (number, policy, to, who, what)


def test_routes(spark):
    rows = events(600, 1)
    assert len(routing.ROUTES) == 40
    got = routing.route(spark.createDataFrame(rows, EVENT)).select("event_id", "policy", "subject_type", "subject", "version").collect()
    assert sorted(map(tuple, got)) == sorted(r for e in rows for r in plain_route(e))


def test_streamed_tasks_equal_the_batch_and_survive_a_restart(rocks, tmp_path):
    rows = events(400, 2)
    rows += random.Random(3).sample(rows, 100)  # delivered again
    random.Random(4).shuffle(rows)
    stream = feed(rocks, rows, EVENT, f"{tmp_path}/in", 4)
    seen: dict = {}

    def upsert(batch, number):
        for r in batch.collect():
            key = (r.policy, r.subject_type, r.subject, r.version)
            seen[key] = min(seen.get(key, (r.ts, r.event_id)), (r.ts, r.event_id))

    writer = routing.stream_tasks(stream).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/check").foreachBatch(upsert)
    writer.trigger(availableNow=True).start().awaitTermination()
    first = len(seen)
    more = events(500, 5)[400:]
    rocks.createDataFrame(more, EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    writer.trigger(availableNow=True).start().awaitTermination()  # from the checkpoint
    batch = routing.tasks(routing.route(rocks.createDataFrame(list({r[0]: r for r in rows}.values()) + more, EVENT).dropDuplicates(["event_id", "ts", "event_type"]))).collect()
    assert {k: v[1] for k, v in seen.items()} == {(r.policy, r.subject_type, r.subject, r.version): r.event_id for r in batch}
    assert len(seen) > first


def test_streamed_tasks_of_many_subjects_stay_out_of_python(rocks, tmp_path):
    """A subject or version of its own for each event: one row of state each, no Python worker and no state in it."""
    rows = [(k, START + datetime.timedelta(seconds=k % 7) if k % 50 else None, "memory_edited", "memory", f"s{k // 2}", f"v{k % 3}", None) for k in range(3000)]
    stream = routing.stream_tasks(feed(rocks, rows, EVENT, f"{tmp_path}/in", 2))
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert "Python" not in plan and "Pandas" not in plan
    found = []
    writer = stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/check").foreachBatch(lambda batch, _: found.extend(batch.collect()))
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    batch = routing.tasks(routing.route(rocks.createDataFrame(rows, EVENT))).collect()
    names = ["policy", "subject_type", "subject", "version", "event_id"]
    assert {tuple(r[n] for n in names) for r in found} == {tuple(r[n] for n in names) for r in batch}
    states = [p["stateOperators"][0]["numRowsTotal"] for p in map(lambda p: json.loads(p.json), query.recentProgress) if p["stateOperators"]]
    assert states[-1] == len(batch)


def test_attempts_share_state_and_timers(rocks, tmp_path, monkeypatch):
    """Hundreds of attempts in three buckets: no row of state for each, and each leaves at its own deadline."""
    monkeypatch.setattr(runs, "BUCKETS", 3)
    rows = [(f"r{k}", 1, "started", START + datetime.timedelta(seconds=k), 60.0 * (1 + k % 5) if k % 50 else None) for k in range(400)]
    rows += [(f"r{k}", 1, "finished", START + datetime.timedelta(seconds=k + k % 400), None) for k in range(0, 400, 3)]
    stream = feed(rocks, rows + [("end", 1, "finished", START + datetime.timedelta(days=2), None)], RUN, f"{tmp_path}/in", 1)
    query = runs.stream_expired_runs(stream).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/check").format("parquet")
    query = query.option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    columns = ["run_id", "attempt", "started_at", "deadline", "outcome"]
    got = sorted(map(tuple, rocks.read.parquet(f"{tmp_path}/out").select(*columns).collect()))
    assert got == sorted(map(tuple, runs.expired_runs(rocks.createDataFrame(rows, RUN), F.lit(START + datetime.timedelta(days=1))).select(*columns).collect())) and len(got) > 200
    states = [p["stateOperators"][0]["numRowsTotal"] for p in map(lambda p: json.loads(p.json), query.recentProgress) if p["stateOperators"]]
    assert max(states) <= 9 and states[-1] <= 3


RUN = "run_id string, attempt int, kind string, ts timestamp, lease_seconds double"


def test_streamed_deadlines_equal_the_batch(rocks, tmp_path):
    rng = random.Random(6)
    rows = []
    for k in range(150):
        run, attempt, at = f"r{k % 60}", k // 60 + 1 + k % 2, START + datetime.timedelta(seconds=rng.randint(0, 3000))
        lease = rng.choice([30.0, 90.5, 300.0])
        rows.append((run, attempt, "started", at, lease))
        if rng.random() < 0.6:
            rows.append((run, attempt, "finished", at + datetime.timedelta(seconds=rng.uniform(-20, 400)), None))
    rows += rng.sample(rows, 40)
    # In order of time but for delays of up to five minutes, within the watermark's ten.
    rows.sort(key=lambda r: r[3].timestamp() + rng.uniform(0, 300))
    end = ("end", 1, "finished", START + datetime.timedelta(days=2), None)
    stream = feed(rocks, rows, RUN, f"{tmp_path}/in", 6)
    rocks.createDataFrame([end], RUN).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    query = runs.stream_expired_runs(stream).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/check").format("parquet")
    query = query.option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    columns = ["run_id", "attempt", "started_at", "deadline", "outcome"]
    got = sorted(map(tuple, rocks.read.parquet(f"{tmp_path}/out").select(*columns).collect()))
    want = sorted(map(tuple, runs.expired_runs(rocks.createDataFrame(rows, RUN), F.lit(START + datetime.timedelta(days=1))).select(*columns).collect()))
    assert got == want and len({r[4] for r in got}) == 2
    states = [p["stateOperators"][0]["numRowsTotal"] for p in map(lambda p: json.loads(p.json), query.recentProgress) if p["stateOperators"]]
    assert states[-1] <= 3  # the end event's own rows: all other state is gone
    total = {r.outcome: r.n_runs for r in runs.expired_summary(rocks.createDataFrame(got, runs.RESULT)).collect()}
    assert sum(total.values()) == len(got)
