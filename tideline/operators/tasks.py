"""The task queue: what can be claimed, in which order, and the lineage of retried activities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.scalars import age_ms, moment
from tideline.sources.schemas import ACTIVE


def _claim_order() -> list[Column]:
    return [F.desc("priority"), F.asc("available_at"), F.asc("scheduled_at"), F.asc("id")]


def claimable(tasks: DataFrame, runs: DataFrame, as_of: str) -> DataFrame:
    """Available tasks under a live run lease, with the run's token. A task lease that ends now is not over yet;
    a run lease that does is."""
    now = moment(as_of)
    free = tasks.where((F.col("state") == "available") & (F.col("available_at") <= now) & (F.col("lease_owner").isNull() | (F.col("lease_expires_at") < now)))
    live = runs.where(F.col("state").isin(*ACTIVE) & F.col("lease_token").isNotNull() & (F.col("lease_expires_at") > now)).select(F.col("id").alias("run_id"), F.col("lease_token").alias("run_token"))
    return free.join(live, "run_id")


def claim(tasks: DataFrame, runs: DataFrame, as_of: str, queue: str | None = None, limit: int = 10) -> DataFrame:
    """The next tasks of a queue, or of all, in claim order."""
    out = claimable(tasks, runs, as_of)
    if queue is not None:
        out = out.where(F.col("queue") == queue)
    return out.withColumn("queue_age_ms", age_ms("scheduled_at", as_of)).orderBy(*_claim_order()).limit(limit).select("id", "run_id", "queue", "priority", "attempt", "run_token", "queue_age_ms")


def queue_summary(tasks: DataFrame, runs: DataFrame, as_of: str) -> DataFrame:
    """Queues with claimable tasks: top_priority, oldest_available_at, tasks."""
    return claimable(tasks, runs, as_of).groupBy("queue").agg(F.max("priority").alias("top_priority"), F.min("available_at").alias("oldest_available_at"), F.count(F.lit(1)).alias("tasks"))


def queue_order(summary: DataFrame) -> DataFrame:
    return summary.orderBy(F.desc("top_priority"), "oldest_available_at", "queue")


def in_use(tasks: DataFrame) -> DataFrame:
    return tasks.where("state = 'leased'").groupBy("queue").agg(F.count(F.lit(1)).alias("in_use"))


def pending_stats(tasks: DataFrame, as_of: str) -> DataFrame:
    """queue, pending, max_age_ms of due available tasks."""
    due = tasks.where((F.col("state") == "available") & (F.col("available_at") <= moment(as_of)))
    return due.groupBy("queue").agg(F.count(F.lit(1)).alias("pending"), F.coalesce(F.max(age_ms("scheduled_at", as_of)), F.lit(0).cast("long")).alias("max_age_ms"))


def claim_with_capacity(tasks: DataFrame, runs: DataFrame, as_of: str, slots: int, limit: int) -> DataFrame:
    """Claims over all queues: each queue up to its free slots, queues in their order, and `limit` in all. The
    ranks are taken per queue; only rows within a queue's slots reach the running total."""
    able = claimable(tasks, runs, as_of)
    order = queue_order(queue_summary(tasks, runs, as_of))
    ranked_queues = order.withColumn("queue_rank", F.row_number().over(Window.orderBy(F.desc("top_priority"), "oldest_available_at", "queue"))).select("queue", "queue_rank")
    free = F.greatest(F.lit(0), F.lit(slots) - F.coalesce("in_use", F.lit(0)))
    inside = able.withColumn("n", F.row_number().over(Window.partitionBy("queue").orderBy(*_claim_order()))).where(F.col("n") <= slots)
    inside = inside.join(in_use(tasks), "queue", "left").where(F.col("n") <= free).join(F.broadcast(ranked_queues), "queue")
    return inside.orderBy("queue_rank", "n").limit(limit).select("id", "queue", F.col("n").cast("long").alias("place"))


def lineage(tasks: DataFrame, attempts: DataFrame | None = None, operations: DataFrame | None = None) -> DataFrame:
    """lineage, kind, id, at: tasks (roots first), attempts and operations of each activity lineage."""
    key = F.coalesce("lineage_id", "id")
    retry = F.col("parent_task_id").isNotNull() if "parent_task_id" in tasks.columns else F.lit(False)
    out = tasks.select(key.alias("lineage"), F.when(retry, "retry").otherwise("root").alias("kind"), "id", F.col("scheduled_at").alias("at"))
    for kind, more in (("attempt", attempts), ("operation", operations)):
        if more is not None:
            out = out.unionByName(more.select(F.coalesce("lineage_id", "task_id").alias("lineage"), F.lit(kind).alias("kind"), "id", F.col("inserted_at").alias("at")))
    return out


def in_lineage_order(rows: DataFrame) -> DataFrame:
    """Rows of lineages for display: each lineage's root first, the others by time."""
    return rows.orderBy("lineage", F.col("kind") != "root", "at", "id")


def latest_classification(operations: DataFrame) -> DataFrame:
    """lineage_id, classification: the last that is not null."""
    return operations.where("classification IS NOT NULL").groupBy("lineage_id").agg(F.max_by("classification", F.struct("inserted_at", "id")).alias("classification"))


def context(tasks: DataFrame, runs: DataFrame, claims: DataFrame) -> DataFrame:
    """claims (id, run_id, owner, attempt) with a status: active; cancelled (the task is still theirs, but its run
    has ended, is gone or is asked to cancel); lease_lost (the task is not, or no longer, theirs)."""
    asked = F.col("cancel_requested_at").isNotNull() if "cancel_requested_at" in runs.columns else F.lit(False)
    live = runs.where(F.col("state").isin(*ACTIVE) & ~asked).select(F.col("id").alias("run_id"), F.lit(True).alias("_live"))
    held = tasks.where("state = 'leased'").select("id", F.struct("run_id", F.col("lease_owner").alias("owner"), "attempt").alias("_held"))
    theirs = F.coalesce((F.col("_held.run_id") == F.col("run_id")) & (F.col("_held.owner") == F.col("owner")) & (F.col("_held.attempt") == F.col("attempt")), F.lit(False))
    #: A task's id finds its row alone, and only what a status needs goes on to the runs.
    judged = claims.join(held, "id", "left").select("id", "run_id", theirs.alias("_theirs"))
    status = F.when(~F.col("_theirs"), "lease_lost").when(F.col("_live"), "active").otherwise("cancelled")
    return judged.join(live, "run_id", "left").select("id", "run_id", status.alias("status"))
