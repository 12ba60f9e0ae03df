"""Stream sinks that read and write only the buckets that a micro-batch touches.

A table is a folder of Parquet partitioned by ``bucket`` (the hash of the key) and ``batch`` (the micro-batch that wrote the files). A batch names
the buckets of its keys, reads those alone and replaces nothing but its own partitions, so a batch that is run again after a crash
writes the same rows to the same place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.streaming.ledger import append_once

BUCKETS = 64


def bucket_of(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _touched(batch: DataFrame) -> list[int]:
    return [r["bucket"] for r in batch.select("bucket").distinct().collect()]  # at most as many as there are buckets


def _stored(spark: SparkSession, path: str, schema: T.StructType, buckets: list[int], before: int) -> DataFrame | None:
    """The rows of some buckets from earlier batches; None where there is no table yet. Other buckets' files are not opened."""
    kind = T.StructType([f for f in schema.fields if f.name not in ("bucket", "batch")]).add("bucket", T.IntegerType()).add("batch", T.LongType())
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema(kind).parquet(path).where(F.col("bucket").isin(buckets) & (F.col("batch") < before))


def _write(rows: DataFrame, path: str, number: int) -> None:
    names = sorted(c for c in rows.columns if c not in ("bucket", "batch"))  # every file has its columns in one order
    rows.select(*names, "bucket").withColumn("batch", F.lit(number).cast("long")).repartition("bucket").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)


def append_to_ledger(stream: DataFrame, path: str, checkpoint: str, key: str = "idempotency_key", buckets: int = BUCKETS):
    """A writer that appends each key of a stream (with ts and event_id) once, the first by time of its first batch."""

    def append(batch: DataFrame, number: int) -> None:
        rows = append_once(batch.withColumn("bucket", bucket_of(key, buckets)), key).persist()
        try:
            old = _stored(batch.sparkSession, path, batch.schema, _touched(rows), number)
            _write(rows if old is None else rows.join(old.select("bucket", key), ["bucket", key], "left_anti"), path, number)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket", "batch")


def upsert_latest(stream: DataFrame, path: str, checkpoint: str, key: str, version: list[str], buckets: int = BUCKETS):
    """A writer that keeps the row of the greatest version for each key: touched buckets are written anew, others stay as they are."""
    newest = lambda df: df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in version]))).where("_n = 1").drop("_n")

    def upsert(batch: DataFrame, number: int) -> None:
        rows = newest(batch.withColumn("bucket", bucket_of(key, buckets))).persist()
        try:
            old = _stored(batch.sparkSession, path, batch.schema, _touched(rows), number)
            _write(rows if old is None else newest(rows.unionByName(_current(old).drop("batch"))), path, number)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)


def _current(rows: DataFrame) -> DataFrame:
    """The rows of each bucket's latest batch, which hold all of the bucket."""
    last = rows.groupBy("bucket").agg(F.max("batch").alias("batch"))
    return rows.join(F.broadcast(last), ["bucket", "batch"])  # a row for each bucket


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    return _current(spark.read.parquet(path)).drop("bucket", "batch")


def stream_dirty_claims(events: DataFrame) -> DataFrame:
    """The latest reason for each claim (claim_id, reason, ts, event_id), in update mode: a row for each claim that a batch changes."""
    last = F.max_by(F.struct("reason", "ts", "event_id"), F.struct("ts", "event_id"))
    return events.groupBy("claim_id").agg(last.alias("last")).select("claim_id", "last.reason", "last.ts", "last.event_id")
