"""Repairs of what health reports. A request is fenced by what its sender saw, is only planned unless told to run,
and may come again. Nothing is written here: the caller merges the changed rows, as the only writer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.scalars import moment
from tideline.sources.schemas import ACTIVE

#: What a request may hold; what its action does not need is null.
REQUEST = "action string, subject_id string, lease_owner string, lease_token bigint, attempt bigint, finding_type string, fingerprint string, reviewed_by string, reason string"
_RUN = ("state", "lease_owner", "lease_token", "lease_expires_at", "next_wakeup_at")
_TASK = ("state", "lease_owner", "attempt", "lease_expires_at")


def _beside(requests: DataFrame, table: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Requests with the row that they are about; its columns begin with "_"."""
    row = table.select(F.col("id").alias("subject_id"), *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_there"))
    return requests.join(row, "subject_id", "left")


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def repair(runs: DataFrame, tasks: DataFrame, versions: DataFrame, requests: DataFrame, as_of: str, dry_run: bool = True) -> dict[str, DataFrame]:
    """requests (see REQUEST) of the actions

    - wake: an active run with this lease token is to wake now;
    - release_expired_lease: an active run gives up a lease of this owner and token that is over;
    - requeue_activity: a leased task of this owner and attempt, its lease over, becomes available again;
    - mark_reviewed: a finding is acknowledged in this form;
    - retry: the loaded versions of a workflow are to be registered again.

    status: every request with planned, repaired, already_applied, stale_or_inactive, stale_or_not_expired,
    workflow_not_loaded or unknown_action. runs, tasks, reviews, versions: the rows to merge, none in a dry run.
    Equal requests have equal outcomes and change a row once; one that is both woken and released is both."""
    now, done = moment(as_of), "planned" if dry_run else "repaired"
    asked = requests.select(*(c.split()[0] for c in REQUEST.split(", ")))
    of = lambda *actions: asked.where(F.col("action").isin(*actions))

    on_runs = _beside(of("wake", "release_expired_lease"), runs, _RUN)
    held = _sure(F.col("_state").isin(*ACTIVE) & (F.col("_lease_token") == F.col("lease_token")))
    over = held & _sure((F.col("_lease_owner") == F.col("lease_owner")) & (F.col("_lease_expires_at") <= now))
    given_up = F.lit(not dry_run) & _sure(F.col("_there")) & F.col("_lease_owner").isNull() & F.col("_lease_token").isNull()
    woken = F.when(held, done).otherwise("stale_or_inactive")
    released = F.when(over, done).when(given_up, "already_applied").otherwise("stale_or_inactive" if dry_run else "stale_or_not_expired")
    on_runs = on_runs.withColumn("status", F.when(F.col("action") == "wake", woken).otherwise(released))

    on_tasks = _beside(of("requeue_activity"), tasks, _TASK)
    over = _sure((F.col("_state") == "leased") & (F.col("_lease_owner") == F.col("lease_owner")) & (F.col("_attempt") == F.col("attempt")) & (F.col("_lease_expires_at") <= now))
    again = F.lit(not dry_run) & _sure((F.col("_state") == "available") & (F.col("_attempt") == F.col("attempt") + 1) & F.col("_lease_owner").isNull())
    on_tasks = on_tasks.withColumn("status", F.when(over, done).when(again, "already_applied").otherwise("stale_or_not_expired"))

    loaded = versions.where("entrypoint IS NOT NULL").select("workflow", "version_hash").distinct()
    names = loaded.select(F.col("workflow").alias("subject_id"), F.lit(True).alias("_there")).distinct()
    on_versions = of("retry").join(names, "subject_id", "left").withColumn("status", F.when(F.col("_there"), done).otherwise("workflow_not_loaded"))
    on_reviews = of("mark_reviewed").withColumn("status", F.lit(done))
    known = F.col("action").isin("wake", "release_expired_lease", "requeue_activity", "retry", "mark_reviewed")
    others = asked.where(~_sure(known)).withColumn("status", F.lit("unknown_action"))

    made = F.col("status") == "repaired"
    row = on_runs.where(made).groupBy(F.col("subject_id").alias("id")).agg(
        F.bool_or(F.col("action") == "wake").alias("_woken"), F.bool_or(F.col("action") != "wake").alias("_released"), *(F.any_value(f"_{c}").alias(f"_{c}") for c in _RUN)
    )
    kept = lambda c: F.when(~F.col("_released"), F.col(f"_{c}")).alias(c)
    return {
        "status": reduce(DataFrame.unionByName, [x.select(*asked.columns, "status") for x in (on_runs, on_tasks, on_versions, on_reviews, others)]),
        "runs": row.select(
            "id", F.when(F.col("_released") & (F.col("_state") == "running"), "suspended").otherwise(F.col("_state")).alias("state"), kept("lease_owner"), kept("lease_token"), kept("lease_expires_at"),
            F.when(F.col("_woken"), now).otherwise(F.coalesce("_next_wakeup_at", now)).alias("next_wakeup_at"),
        ),
        "tasks": on_tasks.where(made).select(
            F.col("subject_id").alias("id"), F.lit("available").alias("state"), (F.col("attempt") + 1).alias("attempt"), F.lit(None).cast("string").alias("lease_owner"),
            F.lit(None).cast("timestamp_ntz").alias("lease_expires_at"), now.alias("available_at"),
        ).distinct(),
        "reviews": on_reviews.where(made).groupBy("finding_type", "subject_id", "fingerprint").agg(F.max(F.struct("reviewed_by", "reason")).alias("_by")).select("finding_type", "subject_id", "fingerprint", "_by.*", now.alias("reviewed_at")),
        "versions": loaded.join(on_versions.where(made).select(F.col("subject_id").alias("workflow")).distinct(), "workflow", "left_semi"),
    }
