"""The job queue: order, neighbours, guards, patches and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstack.scratch import materialise

TERMINAL = ("done", "error", "partial", "cancelled")


def engine(value: Column) -> Column:
    """An engine's name as its backends know it; lmstudio for an empty or old name."""
    v = F.lower(F.trim(value))
    return F.when(v.isin("chandra", "qwen", "dummy", "lmstudio"), v).otherwise("lmstudio")


def neighbours(jobs: DataFrame, by: str | None = None) -> DataFrame:
    """Queued jobs with the ids before and after them in the order of priority and creation, in each queue ``by``.

    Queues are cut into ranges of that order, as one may hold most jobs. Only the first and last job of each range go
    on to find the neighbours across cuts: two rows for each range and queue in it.
    """
    queue = F.col(by) if by else F.lit(0)
    order = ("priority", "created_at", "id")
    queued = jobs.where("status = 'queued'").withColumn("_queue", queue).repartitionByRange("_queue", *order)
    placed = materialise(queued.withColumn("_range", F.spark_partition_id()), "queue")
    inside = Window.partitionBy("_queue", "_range").orderBy(*order)
    near = placed
    for name, column in (("before_id", F.lag("id")), ("after_id", F.lead("id")), ("before_priority", F.lag("priority")), ("after_priority", F.lead("priority"))):
        near = near.withColumn(name, column.over(inside))
    key, job = F.struct(*order), F.struct("id", "priority")
    ends = placed.groupBy("_queue", "_range").agg(F.min_by(job, key).alias("first"), F.max_by(job, key).alias("last"))
    across = Window.partitionBy("_queue").orderBy("_range")
    ends = ends.select(F.col("_queue").alias("_q"), F.col("_range").alias("_r"), F.lag("last").over(across).alias("_left"), F.lead("first").over(across).alias("_right"))
    out = near.join(ends, F.col("_queue").eqNullSafe(F.col("_q")) & (F.col("_range") == F.col("_r")))
    return out.select(*jobs.columns, *(F.coalesce(f"{side}_{what}", f"{edge}.{what}").alias(f"{side}_{what}")
                                       for what in ("id", "priority") for side, edge in (("before", "_left"), ("after", "_right"))))


def swapped(mine: Column, other: Column) -> Column:
    """Both priorities after a swap; equal ones are spread apart."""
    equal = mine == other
    return F.struct(F.when(equal, mine - 1).otherwise(other).alias("mine"), F.when(equal, other + 1).otherwise(mine).alias("other"))


def next_priority(jobs: DataFrame) -> DataFrame:
    return jobs.where("status = 'queued'").agg(F.coalesce(F.max("priority") + 1, F.lit(0)).alias("priority"))


def latest_done(jobs: DataFrame) -> DataFrame:
    """Each node's last finished job, unless one is still active there."""
    last = Window.partitionBy("node_id").orderBy(F.desc("created_at"), F.desc("id"))
    node = Window.partitionBy("node_id")
    marked = jobs.withColumn("_active", F.max(F.col("status").isin("queued", "processing").cast("int")).over(node))
    done = marked.where(F.col("status").isin("done", "partial") & (F.col("_active") == 0))
    return done.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_active")


def remaining(started: Column, now: Column, progress: Column) -> Column:
    """Seconds to go at the pace so far; null until one percent is done."""
    elapsed = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(started.cast("timestamp"))
    return F.when(progress > 0.01, elapsed / progress - elapsed)


def guard(status: Column, retries: Column, most: Column, hours: Column, limit: Column) -> Column:
    """Why a job must not run, in this order: terminal, retries, runtime, paused; null if it may."""
    return F.when(status.isin(*TERMINAL), "terminal").when(retries >= most, "retries").when(hours > limit, "runtime").when(status == "paused", "paused")


def patched(jobs: DataFrame, patches: DataFrame, columns: list[str]) -> DataFrame:
    """Jobs with the non-null fields of their patch; patches for unknown ids are ignored."""
    a, b = jobs.alias("a"), patches.alias("b")
    joined = a.join(b, F.col("a.id") == F.col("b.id"), "left")
    return joined.select(*(F.coalesce(f"b.{c}", f"a.{c}").alias(c) if c in columns else F.col(f"a.{c}") for c in jobs.columns))


def transition(status: Column, action: str) -> Column:
    """The status after pause, resume, cancel or restart; actions that don't apply leave it."""
    if action == "pause":
        return F.when(status.isin("queued", "processing"), "paused").otherwise(status)
    if action == "resume":
        return F.when(status == "paused", "queued").otherwise(status)
    if action == "cancel":
        return F.when(status.isin(*TERMINAL), status).otherwise("cancelled")
    return F.lit("queued")


def back_off(errors: Column, base: float = 15.0, most: float = 180.0) -> Column:
    """Seconds to the next poll after so many errors in a row."""
    return F.when(errors > 0, F.least(base * F.pow(F.lit(2.0), F.least(errors - 1, F.lit(3))), F.lit(most))).otherwise(F.lit(base))


def listed(jobs: DataFrame, statuses: tuple[str, ...] | None = None, node: str | None = None) -> DataFrame:
    """Jobs of these statuses and this node, the most urgent and then the newest first as their place says."""
    found = jobs.where(F.col("status").isin(*statuses)) if statuses else jobs
    found = found.where(F.col("node_id") == node) if node else found
    return found.orderBy("priority", F.desc("created_at"), F.desc("id"))


def without(jobs: DataFrame, files: DataFrame, settings: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Jobs, their files and their settings without those of the ids in ``gone`` (id)."""
    of_job = gone.select(F.col("id").alias("job_id"))
    return jobs.join(gone.select("id"), "id", "left_anti"), files.join(of_job, "job_id", "left_anti"), settings.join(of_job, "job_id", "left_anti")


def retried(jobs: DataFrame, ids: DataFrame, reset: bool = False) -> DataFrame:
    """Jobs with one more retry, or none, for the ids."""
    hit = jobs.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    count = F.lit(0) if reset else F.coalesce("retry_count", F.lit(0)) + 1
    return hit.withColumn("retry_count", F.when(F.col("_hit"), count).otherwise(F.col("retry_count"))).drop("_hit")


def started(jobs: DataFrame, at: Column) -> DataFrame:
    """Jobs that are processed, with a start if they had none."""
    return jobs.withColumn("started_at", F.when(F.col("status") == "processing", F.coalesce("started_at", at)).otherwise(F.col("started_at")))


def counts(jobs: DataFrame) -> DataFrame:
    """(status, n): how many jobs there are of each status."""
    return jobs.groupBy("status").agg(F.count("*").alias("n"))


def has_room(jobs: DataFrame, most: int = 100) -> DataFrame:
    """(active, room): queued and processed jobs, and whether the queue takes another; without a limit (0) it always does."""
    n = F.count_if(F.col("status").isin("queued", "processing"))
    return jobs.agg(n.alias("active"), ((n < most) | F.lit(most <= 0)).alias("room"))
