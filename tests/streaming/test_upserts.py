"""Bucketed sinks: results, replays, and which files a batch opens."""

import datetime
import random

from claimloom.streaming import ledger, upserts
from tests.streaming.test_streams import START, feed

EVENT = "event_id long, ts timestamp, idempotency_key string, value double"


def rows(n, seed, keys):
    rng = random.Random(seed)
    return [(k, START + datetime.timedelta(seconds=k), f"k{rng.randint(0, keys)}", rng.random()) for k in range(n)]


def drain(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def test_ledger_takes_each_key_once(spark, tmp_path):
    data = rows(300, 1, 120)
    stream = feed(spark, data, EVENT, f"{tmp_path}/in", 4)
    writer = upserts.append_to_ledger(stream, f"{tmp_path}/out", f"{tmp_path}/check", buckets=8)
    drain(writer)
    got = {(r.idempotency_key, r.event_id) for r in upserts.read_ledger(spark, f"{tmp_path}/out").collect()}
    want = {(r.idempotency_key, r.event_id) for r in ledger.append_once(spark.createDataFrame(data, EVENT)).collect()}
    assert got == want
    drain(writer)
    assert upserts.read_ledger(spark, f"{tmp_path}/out").count() == len(want)


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    stream = feed(spark, rows(200, 2, 80), EVENT, f"{tmp_path}/in", 2)
    drain(upserts.append_to_ledger(stream, f"{tmp_path}/out", f"{tmp_path}/check", buckets=4))
    before = sorted(map(tuple, upserts.read_ledger(spark, f"{tmp_path}/out").collect()))
    # As after a crash before the commit: a new checkpoint starts from the first batch again.
    drain(upserts.append_to_ledger(stream, f"{tmp_path}/out", f"{tmp_path}/check2", buckets=4))
    assert sorted(map(tuple, upserts.read_ledger(spark, f"{tmp_path}/out").collect())) == before


def test_a_batch_opens_its_buckets_alone(spark, tmp_path):
    stream = feed(spark, rows(200, 3, 80), EVENT, f"{tmp_path}/in", 1)
    drain(upserts.append_to_ledger(stream, f"{tmp_path}/out", f"{tmp_path}/check", buckets=16))
    new = [(900, START, "new", 1.0)]
    own = spark.createDataFrame(new, EVENT).select(upserts.bucket_of("idempotency_key", 16)).first()[0]
    for file in (tmp_path / "out").rglob("*.parquet"):
        if f"bucket={own}/" not in str(file):
            file.write_bytes(b"broken")  # whoever opens another bucket fails
            (file.parent / f".{file.name}.crc").unlink()
    spark.createDataFrame(new, EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    drain(upserts.append_to_ledger(stream, f"{tmp_path}/out", f"{tmp_path}/check", buckets=16))
    assert list((tmp_path / "out" / f"bucket={own}").glob("batch=1/*.parquet"))


def test_latest_rows(spark, tmp_path):
    data = rows(400, 4, 60)
    random.Random(5).shuffle(data)
    stream = feed(spark, data, EVENT, f"{tmp_path}/in", 5)
    drain(upserts.upsert_latest(stream, f"{tmp_path}/out", f"{tmp_path}/check", "idempotency_key", ["ts", "event_id"], buckets=8))
    want = {}
    for r in sorted(data, key=lambda r: (r[1], r[0])):
        want[r[2]] = r
    assert {tuple(r) for r in upserts.read_latest(spark, f"{tmp_path}/out").select("event_id", "ts", "idempotency_key", "value").collect()} == set(want.values())


def test_streamed_dirty_claims_equal_the_batch(spark, tmp_path):
    schema = "claim_id string, reason string, ts timestamp, event_id long"
    data = [(f"c{r[2]}", f"r{r[0]}", r[1], r[0]) for r in rows(300, 6, 40)]
    random.Random(7).shuffle(data)
    stream = feed(spark, data, schema, f"{tmp_path}/in", 3)
    seen = {}
    writer = upserts.stream_dirty_claims(stream).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/check")
    drain(writer.foreachBatch(lambda batch, number: seen.update({r.claim_id: r.reason for r in batch.collect()})))
    assert seen == {r.claim_id: r.reason for r in ledger.dirty_claims(spark.createDataFrame(data, schema)).collect()}
