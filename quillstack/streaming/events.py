"""Job events as state: debounced status rows, rate limits, sessions. Each fold runs on batches and on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Statuses that are always written at once.
TERMINAL = ("done", "error", "paused", "cancelled")
SECOND = 1_000_000
OUT = "job long, ts timestamp_ntz, seq long, status string, progress double"
STATE = "status string, progress double, at long"


def step(state: tuple | None, at: int, status: str, progress: float | None, terminal: tuple[str, ...] = TERMINAL, wait: float = 3.0, least: float = 0.05) -> tuple[bool, tuple]:
    """Whether an event at this microsecond is written at once, and the state after: (status, progress, time) of the last one written.

    It is if it is the first, has a terminal status, changes the status, moves progress by ``least``, or comes ``wait`` seconds later.
    """
    progress = progress or 0.0
    if state is None or status in terminal or status != state[0] or at - state[2] >= wait * SECOND or abs(progress - state[1]) >= least:
        return True, (status, progress, at)
    return False, state


def take(state: tuple | None, at: int, most: float, period: float) -> tuple[bool, tuple]:
    """Whether a bucket gives a token, and the state after: (tokens, time). It is full at first and refilled evenly."""
    tokens = most if state is None else min(most, state[0] + (at - state[1]) / SECOND / period * most)
    return (True, (tokens - 1, at)) if tokens >= 1 else (False, (tokens, at))


def watch(state: tuple | None, at: int, active: bool, age: float | None, threshold: float, soft: float = 600.0, again: float = 300.0) -> tuple[bool, tuple | None]:
    """Whether a job is taken for dead at this look at it, and the state after: when it was first suspected.

    A job that runs is never suspected. One that was silent for ``soft`` seconds is; it is dead when it is seen silent for
    ``threshold`` seconds, ``again`` seconds or more after the first suspicion. A look without an age changes nothing.
    """
    if age is None:
        return False, state
    if active:
        return False, None
    if age < threshold:
        return False, state or ((at,) if age > soft else None)
    if state is None:
        return False, (at,)
    return (True, None) if at - state[0] >= again * SECOND else (False, state)


def _fold(events: DataFrame, values: tuple[str, ...], said: str, move: Callable) -> DataFrame:
    """Events with what ``move`` says of each, in the order of time and number in each job.

    A job's rows reach one task together and sorted, and the task keeps one state, so a job with most of the events is
    read batch by batch (the sort spills). Events without a time have no place in the order and are left out.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, state = None, None
        for batch in batches:
            out = []
            for key, at, *rest in zip(batch["job"].to_pylist(), batch["ts"].cast(pa.int64()).to_pylist(), *(batch[c].to_pylist() for c in values), strict=True):
                if key != job:
                    job, state = key, None
                ok, state = move(state, at, *rest)
                out.append(ok)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], names=[*batch.schema.names, said])

    rows = events.where("ts is not null").select("job", "ts", "seq", *values).repartition("job").sortWithinPartitions("job", "ts", "seq")
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{types}, {said} boolean")


def judged(events: DataFrame, terminal: tuple[str, ...] = TERMINAL, wait: float = 3.0, least: float = 0.05) -> DataFrame:
    """Each event and whether the status row of its job is written for it at once."""
    return _fold(events, ("status", "progress"), "written", lambda state, at, status, progress: step(state, at, status, progress, terminal, wait, least))


def debounced(events: DataFrame, terminal: tuple[str, ...] = TERMINAL, wait: float = 3.0, least: float = 0.05) -> DataFrame:
    """Batch: the events of each job that its status row is written for."""
    return judged(events, terminal, wait, least).where("written").drop("written")


def pending(events: DataFrame, terminal: tuple[str, ...] = TERMINAL, wait: float = 3.0, least: float = 0.05) -> DataFrame:
    """What a flush at the end writes: the last event of each job whose last event was held back."""
    row = F.struct("ts", "seq", "status", "progress", "written")
    last = judged(events, terminal, wait, least).groupBy("job").agg(F.max_by(row, F.struct("ts", "seq")).alias("e"))
    return last.where("not e.written").select("job", "e.ts", "e.seq", "e.status", "e.progress")


def debounce_stats(events: DataFrame, terminal: tuple[str, ...] = TERMINAL, wait: float = 3.0, least: float = 0.05) -> DataFrame:
    """(job, written, skipped): how many events of a job were written and held back."""
    return judged(events, terminal, wait, least).groupBy("job").agg(F.count_if("written").alias("written"), F.count_if(~F.col("written")).alias("skipped"))


def debounced_stream(events: DataFrame, terminal: tuple[str, ...] = TERMINAL, late: str = "1 hour", wait: float = 3.0, least: float = 0.05) -> DataFrame:
    """Stream: the same, with the last written row of each job as state.

    State goes when a terminal status is written, and when the watermark has passed a job's last event by ``wait``: the next
    event is written in either case, with or without it. Events later than the watermark are dropped; others are sorted
    within a micro-batch and otherwise judged as they arrive.
    """
    def fold(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        last, keep = tuple(state.get) if state.exists else None, []
        times = (rows.ts - pd.Timestamp("1970-01-01")) // pd.Timedelta(microseconds=1)
        for at, status, progress in zip(times, rows.status, rows.progress.fillna(0.0), strict=True):
            writes, last = step(last, at, status, progress, terminal, wait, least)
            keep.append(writes)
        if last[0] not in terminal:
            state.update(last)
            state.setTimeoutTimestamp(max(int(rows.ms.max() + wait * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield rows.loc[keep, ["job", "ts", "seq", "status", "progress"]]

    timed = events.where("ts is not null").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    rows = timed.select("job", "ts", "seq", "status", "progress", "at", F.unix_millis("at").alias("ms"))
    return rows.groupBy("job").applyInPandasWithState(fold, OUT, STATE, "append", "EventTimeTimeout")


def rate_limited(events: DataFrame, most: float = 2.0, period: float = 86_400.0) -> DataFrame:
    """(job, seq, passes): a bucket of tokens for each job, refilled evenly over the period."""
    return _fold(events, (), "passes", lambda state, at: take(state, at, most, period)).drop("ts")


def dead_jobs(looks: DataFrame, threshold: float, soft: float = 600.0, again: float = 300.0) -> DataFrame:
    """(job, seq, dead) of looks (job, ts, seq, active, age in seconds) at processing jobs."""
    return _fold(looks, ("active", "age"), "dead", lambda state, at, active, age: watch(state, at, active, age, threshold, soft, again)).select("job", "seq", "dead")


def failures_in_a_row(events: DataFrame, failed: Column) -> DataFrame:
    """Events with ``failures``: how many of a job's events up to here failed since its last success."""
    so_far = Window.partitionBy("job").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = events.withColumn("_failed", F.coalesce(failed, F.lit(False))).withColumn("_n", F.count_if("_failed").over(so_far))
    before = F.coalesce(F.max(F.when(~F.col("_failed"), F.col("_n"))).over(so_far), F.lit(0))
    return counted.withColumn("failures", F.col("_n") - before).drop("_failed", "_n")


def sync_retry(failures: Column, most: int = 10, slow_from: int = 5, delay: float = 3.0, slow: float = 30.0) -> Column:
    """(attempt, gave_up, delay): what follows so many failures in a row; attempts are counted anew after giving up."""
    attempt = (failures - 1) % most + 1
    fails, gave_up = failures > 0, (failures > 0) & (failures % most == 0)
    # each giving up ends a delay's cause but not the delay: only a success does
    wait = F.when(fails & ~gave_up, F.when(failures >= slow_from, F.lit(slow)).otherwise(F.lit(delay)))
    return F.struct(F.when(fails, attempt).alias("attempt"), gave_up.alias("gave_up"), wait.alias("delay"))


def latest(events: DataFrame) -> DataFrame:
    """A job's last status and progress; the same expression updates a stream."""
    return events.groupBy("job").agg(F.max_by("status", "seq").alias("status"), F.max_by("progress", "seq").alias("progress"), F.count("*").alias("n"))


def first_owner(events: DataFrame) -> DataFrame:
    return events.groupBy("job").agg(F.min_by("seq", F.struct("ts", "seq")).alias("owner"))


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Edits of a job with pauses shorter than the gap, as one write; with a watermark the same runs on a stream."""
    window = F.session_window("ts", gap)
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    out = timed.groupBy("job", window).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("edits"), F.max_by("progress", "seq").alias("progress"))
    return out.select("job", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), F.col("last_ts").cast("timestamp_ntz").alias("last_ts"), "edits", "progress")


def idle(events: DataFrame, limit: int) -> DataFrame:
    """Seconds since a job's event before, and whether they pass the limit."""
    before = F.lag("ts").over(Window.partitionBy("job").orderBy("ts", "seq"))
    gone = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("before").cast("timestamp"))) / 1_000_000)
    return events.withColumn("before", before).where("before is not null").select("job", "seq", gone.alias("idle"), (gone > limit).alias("suspect"))
