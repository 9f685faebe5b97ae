"""Operational health: what active runs wait for, what is overdue, expired, dead or lost, and one status.

Everything is compared with one reference time. A time at or before it has expired here; claims use another
boundary (see tasks and transitions)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.scalars import after, age_ms, fingerprint, moment
from tideline.sources.schemas import ACTIVE, NON_TERMINAL, WAIT_BY_EVENT


def latest_events(events: DataFrame) -> DataFrame:
    """run_id, event_type of each run's last event. One aggregate, no sort."""
    return events.groupBy("run_id").agg(F.max_by("event_type", F.struct("seq", "inserted_at")).alias("event_type"))


def _reason() -> Column:
    out = F.when(F.col("state") == "stuck_unknown_version", "unknown_version")
    for event, reason in WAIT_BY_EVENT.items():
        out = out.when(F.col("event_type") == event, reason)
    return out.when(F.col("state") == "running", "executing").otherwise(F.coalesce("event_type", F.lit("unknown")))


def wait_reasons(runs: DataFrame, events: DataFrame, as_of: str) -> DataFrame:
    """state, reason, runs, oldest_started_at, oldest_age_ms of runs that have not ended. Events of other runs
    are left out before they are summed."""
    active = runs.where(F.col("state").isin(*NON_TERMINAL)).select("id", "state", "started_at")
    mine = events.join(active.select(F.col("id").alias("run_id")), "run_id", "left_semi")
    joined = active.join(latest_events(mine).withColumnRenamed("run_id", "id"), "id", "left")
    grouped = joined.groupBy("state", _reason().alias("reason")).agg(F.count(F.lit(1)).alias("runs"), F.min("started_at").alias("oldest_started_at"))
    return grouped.withColumn("oldest_age_ms", age_ms("oldest_started_at", as_of))


def _live_lease(as_of: str) -> Column:
    return F.col("lease_owner").isNotNull() & F.col("lease_token").isNotNull() & (F.col("lease_expires_at") > moment(as_of))


def lost_wakes(runs: DataFrame, as_of: str, after_ms: int = 60_000) -> DataFrame:
    """Leased active runs that should have woken after_ms ago."""
    late = F.col("next_wakeup_at") <= after(moment(as_of), -max(0, after_ms))
    out = runs.where(F.col("state").isin(*ACTIVE) & _live_lease(as_of) & late)
    return out.select("id", "state", "lease_owner", "lease_token", "next_wakeup_at", age_ms("next_wakeup_at", as_of).alias("lag_ms"))


def overdue_timers(timers: DataFrame, runs: DataFrame, as_of: str) -> DataFrame:
    """Due timers of active runs that have not fired."""
    due = timers.where(~F.col("fired") & (F.col("fires_at") <= moment(as_of)))
    active = runs.where(F.col("state").isin(*ACTIVE)).select(F.col("id").alias("run_id"), "state")
    return due.join(active, "run_id").select("id", "run_id", "state", "fires_at", age_ms("fires_at", as_of).alias("lag_ms"))


def leases(runs: DataFrame, as_of: str) -> DataFrame:
    """Leases of active runs, live or expired."""
    held = runs.where(F.col("state").isin(*ACTIVE) & F.col("lease_owner").isNotNull())
    return held.select("id", "state", "lease_owner", "lease_token", "lease_expires_at", (F.col("lease_expires_at") <= moment(as_of)).alias("expired"))


def lease_counts(runs: DataFrame, as_of: str) -> DataFrame:
    return leases(runs, as_of).agg(F.count(F.lit(1)).alias("leases"), F.count_if("expired").alias("expired"))


def tasks_by_state(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("state").agg(F.count(F.lit(1)).alias("tasks"))


def tasks_by_queue(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("queue", "state").agg(F.count(F.lit(1)).alias("tasks"))


def queue_maps(tasks: DataFrame) -> DataFrame:
    """queue, states: a map from state to count."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("state", "tasks"))))
    return tasks_by_queue(tasks).groupBy("queue").agg(pairs.alias("states"))


def attempt_histogram(tasks: DataFrame) -> DataFrame:
    return tasks.where(F.col("state").isin("available", "leased")).groupBy("attempt").agg(F.count(F.lit(1)).alias("tasks"))


def oldest_pending(tasks: DataFrame, as_of: str) -> DataFrame:
    oldest = tasks.where("state = 'available'").agg(F.min("scheduled_at").alias("oldest_scheduled_at"))
    return oldest.withColumn("oldest_age_ms", age_ms("oldest_scheduled_at", as_of))


def expired_task_leases(tasks: DataFrame, as_of: str) -> DataFrame:
    held = tasks.where((F.col("state") == "leased") & (F.col("lease_expires_at") <= moment(as_of)))
    return held.select("id", "run_id", "queue", "attempt", "lease_owner", "lease_expires_at", age_ms("lease_expires_at", as_of).alias("lag_ms"))


def dead_letters(tasks: DataFrame, runs: DataFrame) -> DataFrame:
    """Discarded and dead-lettered tasks, but not those of cancelled runs; a task whose run is gone stays."""
    dead = tasks.where(F.col("state").isin("discarded", "dead_lettered"))
    owner = runs.select(F.col("id").alias("run_id"), F.col("state").alias("run_state"))
    joined = dead.join(owner, "run_id", "left").where(F.col("run_state").isNull() | (F.col("run_state") != "cancelled"))
    return joined.select("id", "run_id", "state", "run_state", "queue", "attempt")


def heartbeats(tasks: DataFrame, as_of: str, limit: int = 50) -> DataFrame:
    """Leased tasks that have given a sign of life, the newest first."""
    alive = tasks.where((F.col("state") == "leased") & F.col("last_heartbeat_at").isNotNull())
    return alive.select("id", "run_id", "last_heartbeat_at", age_ms("last_heartbeat_at", as_of).alias("age_ms")).orderBy(F.desc("last_heartbeat_at"), "id").limit(limit)


def task_alarm_counts(tasks: DataFrame, runs: DataFrame, as_of: str) -> DataFrame:
    """expired_leases, explicit_dead_letters, heartbeats, dead_letters in one row."""
    leased = F.col("state") == "leased"
    one = tasks.agg(
        F.count_if(leased & (F.col("lease_expires_at") <= moment(as_of))).alias("expired_leases"),
        F.count_if(F.col("state") == "dead_lettered").alias("explicit_dead_letters"),
        F.count_if(leased & F.col("last_heartbeat_at").isNotNull()).alias("heartbeats"),
    )
    return one.join(dead_letters(tasks, runs).agg(F.count(F.lit(1)).alias("dead_letters")))


def signal_backlog(signals: DataFrame, as_of: str) -> DataFrame:
    left = signals.where(~F.col("delivered")).agg(F.count(F.lit(1)).alias("signals"), F.min("inserted_at").alias("oldest_inserted_at"))
    return left.withColumn("lag_ms", age_ms("oldest_inserted_at", as_of))


def schedule_health(schedules: DataFrame, as_of: str) -> DataFrame:
    due = F.col("state").isin("scheduled", "starting") & (F.col("scheduled_at") <= moment(as_of))
    return schedules.agg(F.count_if(due).alias("due"), F.min(F.when(due, F.col("scheduled_at"))).alias("oldest_due_at"), F.count_if(F.col("state") == "failed").alias("failed"))


def overflow(events: DataFrame, first_month: str, end_month: str) -> DataFrame:
    """Rows outside the months that have a partition, first_month up to but not including end_month."""
    outside = ~((F.col("inserted_at") >= moment(first_month)) & (F.col("inserted_at") < moment(end_month)))
    return events.where(outside).agg(F.count(F.lit(1)).alias("rows"), F.min("inserted_at").alias("oldest_inserted_at"))


def _finding(kind: str, frame: DataFrame, subject: str, parts: list[str], order: str) -> DataFrame:
    return frame.select(F.lit(kind).alias("finding_type"), F.col(subject).cast("string").alias("subject_id"), fingerprint(*parts).alias("fingerprint"), F.col(order).alias("since"))


def findings(runs: DataFrame, tasks: DataFrame, timers: DataFrame, schedules: DataFrame, as_of: str) -> DataFrame:
    """finding_type, subject_id, fingerprint, since of everything that wants attention."""
    parts = [
        _finding("lost_wake", lost_wakes(runs, as_of), "id", ["lease_token", "next_wakeup_at"], "next_wakeup_at"),
        _finding("overdue_timer", overdue_timers(timers, runs, as_of), "id", ["fires_at"], "fires_at"),
        _finding("expired_lease", leases(runs, as_of).where("expired"), "id", ["lease_token", "lease_expires_at"], "lease_expires_at"),
        _finding("expired_activity_lease", expired_task_leases(tasks, as_of), "id", ["attempt", "lease_owner", "lease_expires_at"], "lease_expires_at"),
        _finding("dead_letter_activity", dead_letters(tasks, runs).withColumn("since", F.lit(None).cast("timestamp_ntz")), "id", ["state", "attempt"], "since"),
        _finding("failed_schedule", schedules.where("state = 'failed'"), "id", ["attempt"], "scheduled_at"),
    ]
    return reduce(DataFrame.unionByName, parts)


def reviewed(found: DataFrame, reviews: DataFrame) -> DataFrame:
    """Findings with whether they were acknowledged in their present form."""
    keys = ["finding_type", "subject_id", "fingerprint"]
    return found.join(reviews.select(*keys, F.lit(True).alias("reviewed")).distinct(), keys, "left").withColumn("reviewed", F.coalesce("reviewed", F.lit(False)))


def worst_first(found: DataFrame, limit: int = 50) -> DataFrame:
    """Unreviewed findings first, then by age; the order is total."""
    return found.orderBy("reviewed", F.asc_nulls_last("since"), "finding_type", "subject_id").limit(limit)


def leases_first(held: DataFrame, limit: int = 50) -> DataFrame:
    """Expired and unreviewed leases, then live ones, then expired ones that were reviewed."""
    rank = F.when(F.col("expired") & ~F.col("reviewed"), 0).when(~F.col("expired"), 1).otherwise(2)
    return held.orderBy(rank, "lease_expires_at", "id").limit(limit)


def status(found: DataFrame) -> DataFrame:
    """One row a category: findings, reviewed ones, and whether more are found than reviewed; degraded_overall
    is true if any category is."""
    by = found.groupBy("finding_type").agg(F.count(F.lit(1)).alias("findings"), F.count_if("reviewed").alias("reviewed"))
    by = by.withColumn("degraded", F.col("findings") > F.col("reviewed"))
    return by.join(by.agg(F.coalesce(F.bool_or("degraded"), F.lit(False)).alias("degraded_overall")))
