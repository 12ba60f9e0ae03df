"""Runs that miss their deadline, in batch and as a stream with event-time timers.

Run events: run_id, attempt, kind (started, finished), ts, lease_seconds (of starts). A run's attempt starts with its earliest start, has
to finish within that start's lease, and is timed out if no finish lies between both. From the third attempt on that is terminal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

# Fixed value: attempts after which a run is not tried again.
ATTEMPTS = 3
RESULT = "run_id string, attempt int, started_at timestamp, deadline timestamp, outcome string"


def outcome(attempt):
    return F.when(attempt >= ATTEMPTS, F.lit("terminal")).otherwise(F.lit("retryable"))


def expired_runs(events: DataFrame, as_of) -> DataFrame:
    """run_id, attempt, started_at, deadline, outcome of the attempts that missed a deadline before ``as_of``."""
    start = F.when(F.col("kind") == "started", F.struct("ts", "lease_seconds"))
    runs = events.groupBy("run_id", "attempt").agg(
        F.min(start).alias("start"), F.array_sort(F.collect_set(F.when(F.col("kind") == "finished", F.col("ts")))).alias("ends"))
    runs = runs.where("start is not null").select(
        "run_id", "attempt", F.col("start.ts").alias("started_at"), F.expr("start.ts + make_dt_interval(0, 0, 0, start.lease_seconds)").alias("deadline"), "ends")
    done = F.exists("ends", lambda t: (t >= F.col("started_at")) & (t <= F.col("deadline")))
    late = runs.where(~done & (F.col("deadline") < as_of))
    return late.select("run_id", "attempt", "started_at", "deadline", outcome(F.col("attempt")).alias("outcome"))


def expired_summary(expired: DataFrame) -> DataFrame:
    """Per outcome the number of missed deadlines and the mean seconds from start to deadline."""
    seconds = (F.unix_micros("deadline") - F.unix_micros("started_at")) / 1e6
    return expired.groupBy("outcome").agg(F.count("*").alias("n_runs"), F.avg(seconds).alias("mean_seconds"))


#: Groups of attempts (by a hash) that share one value of state and one timer.
BUCKETS = 1024
HELD = ["run_id", "attempt", "at", "lease_seconds"]


class _Deadlines(StatefulProcessor):
    """Holds a bucket's attempts (earliest start with its lease, and finishes: rows without ``start``) until their deadlines have passed.

    Each attempt leaves when the watermark passes its deadline, and is told if it was missed. A bucket's timer stands at the earliest of these.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "timer long, body binary")

    def _read(self) -> tuple[int | None, pd.DataFrame]:
        if not self.held.exists():
            return None, pd.DataFrame(columns=[*HELD, "start"])
        timer, body = self.held.get()
        return timer, pa.ipc.open_stream(bytes(body)).read_pandas()

    def _keep(self, rows: pd.DataFrame, before: int | None) -> None:
        """The bucket's rows and its timer, instead of that of ``before``."""
        timer = int(_timers(rows).min()) if len(rows) else None
        if before is not None and before != timer:
            self.handle.deleteTimer(before)
        if timer is None:
            self.held.clear()
            return
        if before != timer:
            self.handle.registerTimer(timer)
        table, sink = pa.Table.from_pandas(rows, HELD_SCHEMA, preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, HELD_SCHEMA) as writer:
            writer.write_table(table)
        self.held.update((timer, sink.getvalue().to_pybytes()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before, kept = self._read()
        new = [pdf[pdf["kind"].isin(["started", "finished"])] for pdf in rows]
        new = [pdf[HELD].assign(start=pdf["kind"] == "started") for pdf in new if len(pdf)]
        if new:
            self._keep(_folded(pd.concat([kept, *new] if len(kept) else new, ignore_index=True)), before)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, kept = self._read()
        if not len(kept):
            return
        due = (_timers(kept) <= max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())).to_numpy()
        self._keep(kept[~due], None)  # the expired timer goes by itself
        over = kept[due]
        starts, ends = over[over["start"]], over[~over["start"]]
        starts = starts.assign(end=_deadlines(starts)).dropna(subset=["lease_seconds"])
        met = starts.merge(ends[["run_id", "attempt", "at"]], on=["run_id", "attempt"], suffixes=("", "_end"))
        met = met[(met["at"] <= met["at_end"]) & (met["at_end"] <= met["end"])]
        done = pd.MultiIndex.from_frame(starts[["run_id", "attempt"]]).isin(pd.MultiIndex.from_frame(met[["run_id", "attempt"]]))
        missed = starts[~done]
        if len(missed):
            yield pd.DataFrame({
                "run_id": missed["run_id"], "attempt": missed["attempt"].astype("int32"), "start": missed["at"], "end": missed["end"],
                "outcome": np.where(missed["attempt"] >= ATTEMPTS, "terminal", "retryable")})

    def close(self) -> None:
        pass


HELD_SCHEMA = pa.schema([("run_id", pa.string()), ("attempt", pa.int32()), ("at", pa.int64()), ("lease_seconds", pa.float64()), ("start", pa.bool_())])


def _folded(rows: pd.DataFrame) -> pd.DataFrame:
    """Each attempt's earliest start (then the shortest lease), and each finish once."""
    rows = rows.astype({"start": bool, "at": "int64", "lease_seconds": "float64"})
    starts = rows[rows["start"]].sort_values(["at", "lease_seconds"], na_position="first").drop_duplicates(["run_id", "attempt"])
    ends = rows[~rows["start"]].drop_duplicates(["run_id", "attempt", "at"])
    return pd.concat([starts, ends], ignore_index=True)


def _deadlines(starts: pd.DataFrame) -> pd.Series:
    """In microseconds; a start without a lease has none and stands for itself."""
    return starts["at"] + (starts["lease_seconds"].fillna(0) * 1e6).round().astype("int64")


def _timers(rows: pd.DataFrame) -> pd.Series:
    """When each row's attempt leaves, in milliseconds: at its deadline, or at its last finish, since an earlier start would come too late then."""
    ends = pd.Series(np.where(rows["start"], _deadlines(rows), rows["at"]), index=rows.index)
    of = [rows["run_id"], rows["attempt"]]
    started = ends.where(rows["start"]).groupby(of).transform("max")  # floats hold microseconds exactly until 2255
    last = ends.groupby(of).transform("max")
    return -(-started.fillna(last).astype("int64") // 1000)


def stream_expired_runs(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The attempts that missed their deadline, each once, when the watermark passes the deadline; its state goes then.

    Equal to ``expired_runs`` as of the watermark for events in any order, repeated or up to ``late`` behind. Needs the
    RocksDB state store.
    """
    # Times go to the state as microseconds, which no time zone changes.
    bucket = F.pmod(F.xxhash64("run_id", "attempt"), F.lit(BUCKETS)).cast("int")
    rows = events.withWatermark("ts", late).withColumns({"at": F.unix_micros("ts"), "bucket": bucket}).groupBy("bucket")
    found = rows.transformWithStateInPandas(_Deadlines(), "run_id string, attempt int, start long, end long, outcome string", "Append", "EventTime")
    return found.select("run_id", "attempt", F.timestamp_micros("start").alias("started_at"), F.timestamp_micros("end").alias("deadline"), "outcome")
