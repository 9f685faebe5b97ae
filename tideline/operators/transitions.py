"""State transitions as functions from tables to the rows they change. Nothing is written here: the caller
merges the changed rows (history.upsert) and appends the new ones, as the only writer of its tables.

Claims and recovery take a lease that ends at the reference time as still held (strictly before it is over);
"live" means strictly after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.scalars import after, age_ms, backoff_ms, derived_id, moment
from tideline.operators import graph, history
from tideline.sources.schemas import ACTIVE, NON_TERMINAL, TERMINAL


def _active(column: str = "state") -> Column:
    return F.col(column).isin(*ACTIVE)


# -- runs


def claim_runs(runs: DataFrame, as_of: str, owner: str, ttl_ms: int = 30_000, limit: int = 10, local: DataFrame | None = None) -> DataFrame:
    """Runs to be led by owner, with new tokens above all old ones. Runs that a local engine leads (ids in
    local) are left out."""
    now = moment(as_of)
    runnable = (F.col("state") == "running") | F.col("next_wakeup_at").isNull() | (F.col("next_wakeup_at") <= now)
    free = F.col("lease_owner").isNull() | (F.col("lease_expires_at") < now)
    able = runs.where(_active() & runnable & free)
    if local is not None:
        able = able.join(local.select("id"), "id", "left_anti")
    order = [F.asc_nulls_first("next_wakeup_at"), F.asc("started_at"), F.asc("id")]
    chosen = able.orderBy(*order).limit(limit).select("id", "state", "next_wakeup_at", "started_at")
    largest = runs.agg(F.coalesce(F.max("lease_token"), F.lit(0).cast("long")).alias("_last"))
    token = F.col("_last") + F.row_number().over(Window.orderBy(*order))  # over at most `limit` rows
    return chosen.join(largest).select("id", "state", F.lit(owner).alias("lease_owner"), token.alias("lease_token"), after(now, ttl_ms).alias("lease_expires_at"))


def renew_leases(runs: DataFrame, held: DataFrame, as_of: str, ttl_ms: int = 30_000, release: bool = False) -> DataFrame:
    """Leases (id, owner, token) extended or given back; only those whose owner and token still match and, to be
    extended, are not over."""
    mine = runs.join(held.select("id", F.col("owner").alias("_o"), F.col("token").alias("_t")), "id").where((F.col("lease_owner") == F.col("_o")) & (F.col("lease_token") == F.col("_t")))
    if release:
        return mine.select("id", F.lit(None).cast("string").alias("lease_owner"), "lease_token", F.lit(None).cast("timestamp_ntz").alias("lease_expires_at"))
    return mine.where(_active() & (F.col("lease_expires_at") > moment(as_of))).select("id", "lease_owner", "lease_token", after(moment(as_of), ttl_ms).alias("lease_expires_at"))


def recover_runs(runs: DataFrame, as_of: str) -> DataFrame:
    """Active runs whose lease is over: it is cleared, and a running run becomes suspended."""
    over = runs.where(_active() & F.col("lease_owner").isNotNull() & (F.col("lease_expires_at") < moment(as_of)))
    return over.select("id", F.col("state").alias("old_state"), F.lit("suspended").alias("state"), "lease_token")


def token_matches(token: Column, owner: Column, given: Column) -> Column:
    """Whether a write with the given token may go on; without one, only if neither token nor owner is set."""
    return F.when(given.isNotNull(), F.coalesce(token == given, F.lit(False))).otherwise(token.isNull() & owner.isNull())


def finish(runs: DataFrame, requests: DataFrame, versions: DataFrame, as_of: str) -> DataFrame:
    """requests (id, token, to_state) on active runs with a matching token: ended ones get their time and
    retention; suspended ones stay open."""
    r = runs.join(requests.select("id", F.col("token").alias("_t"), "to_state"), "id")
    ok = r.where(_active() & token_matches(F.col("lease_token"), F.col("lease_owner"), F.col("_t")) & F.col("to_state").isin("completed", "failed", "suspended"))
    ended = F.col("to_state").isin(*TERMINAL)
    out = ok.select("id", "workflow", "version_hash", F.col("to_state").alias("state"), F.when(ended, moment(as_of)).alias("completed_at"))
    return retention(out, versions, as_of).withColumn("retention_until", F.when(F.col("state").isin(*TERMINAL), F.col("retention_until")))


def retention(runs: DataFrame, versions: DataFrame, as_of: str) -> DataFrame:
    """runs with retention_until = as_of + retention_ms of their version; null where that is not known."""
    known = versions.select("workflow", "version_hash", "retention_ms")
    return runs.drop("retention_until").join(known, ["workflow", "version_hash"], "left").withColumn("retention_until", F.when(F.col("retention_ms").isNotNull(), after(moment(as_of), F.col("retention_ms")))).drop("retention_ms")


def promote_cancelled(runs: DataFrame) -> DataFrame:
    """Runs that failed by cancellation in the old way."""
    return runs.where("state = 'failed' AND error = '\"cancelled\"'").select("id", F.lit("cancelled").alias("state"))


def release_unknown(runs: DataFrame, known: DataFrame, as_of: str, wait_ms: int = 5_000) -> DataFrame:
    """Leased active runs of versions that are not known give up their lease and wait."""
    out = runs.where(_active() & F.col("lease_owner").isNotNull()).join(known.select("workflow", "version_hash"), ["workflow", "version_hash"], "left_anti")
    return out.select("id", F.lit("suspended").alias("state"), after(moment(as_of), wait_ms).alias("next_wakeup_at"))


def start_runs(runs: DataFrame, keys: DataFrame, requests: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(new runs, request_id and run_id of every request). Requests (request_id, namespace, workflow,
    version_hash, idempotency_key) with a known key, or one that an earlier request of the batch has, get that
    run; those without a key always start one."""
    ids = ["namespace", "workflow", "idempotency_key"]
    named = requests.where("idempotency_key IS NOT NULL")
    own = derived_id("namespace", "workflow", "idempotency_key")
    known = named.join(keys.select(*ids, F.col("run_id").alias("_known")), ids, "left")
    given = known.withColumn("run_id", F.coalesce("_known", own))
    free = requests.where("idempotency_key IS NULL").withColumn("run_id", derived_id("request_id")).withColumn("_known", F.lit(None).cast("string"))
    every = given.select("request_id", "namespace", "workflow", "version_hash", "run_id", "_known").unionByName(free.select("request_id", "namespace", "workflow", "version_hash", "run_id", "_known"))
    fresh = every.where("_known IS NULL").groupBy("run_id").agg(F.min(F.struct("request_id", "namespace", "workflow", "version_hash")).alias("r"))
    new = fresh.join(runs.select(F.col("id").alias("run_id")), "run_id", "left_anti").select(F.col("run_id").alias("id"), "r.namespace", "r.workflow", "r.version_hash", F.lit("running").alias("state"), moment(as_of).alias("started_at"))
    return new, every.select("request_id", "run_id")


def continue_as_new(runs: DataFrame, signals: DataFrame, requests: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """requests (id): active runs that go on as a new incarnation. closed: they end; created: their successors,
    with workflow, namespace, attributes, parent and correlation; reparented: their live children; moved: their
    undelivered signals."""
    ending = runs.where(_active()).join(requests.select("id"), "id", "left_semi").withColumn("next_id", derived_id(F.lit("continue"), "id"))
    step = ending.select(F.col("id").alias("old"), "next_id")
    created = ending.select(
        F.col("next_id").alias("id"), "workflow", "version_hash", "namespace", F.lit("running").alias("state"), "attributes", moment(as_of).alias("started_at"),
        "parent_run_id", F.coalesce("correlation_id", "id").alias("correlation_id"), F.col("id").alias("continued_from_run_id"),
    )
    children = runs.where(F.col("state").isin(*NON_TERMINAL)).join(step.withColumnRenamed("old", "parent_run_id"), "parent_run_id").select("id", F.col("next_id").alias("parent_run_id"))
    moved = signals.where(~F.col("delivered")).join(step.withColumnRenamed("old", "run_id"), "run_id").select("id", F.col("next_id").alias("run_id"))
    closed = ending.select("id", F.lit("completed").alias("state"), moment(as_of).alias("completed_at"))
    return {"closed": closed, "created": created, "reparented": children, "moved": moved}


def start_children(runs: DataFrame, requests: DataFrame, as_of: str, most_depth: int = 10) -> DataFrame:
    """requests (parent_run_id, command_id, workflow, version_hash): children with the parent's namespace and
    attributes, or an error where they would lie too deep."""
    depth = graph.ancestor_depth(runs).withColumnRenamed("id", "parent_run_id")
    parent = runs.select(F.col("id").alias("parent_run_id"), "namespace", "attributes")
    out = requests.join(parent, "parent_run_id").join(depth, "parent_run_id")
    deep = F.col("depth") + 1 > most_depth
    return out.select(
        F.when(~deep, derived_id("parent_run_id", "command_id")).alias("id"), "parent_run_id", "command_id", "workflow", "version_hash", "namespace", "attributes",
        moment(as_of).alias("started_at"), F.when(deep, "too_deep").alias("error"),
    )


def cancelled_runs(runs: DataFrame, roots: DataFrame, most_depth: int = 10) -> tuple[DataFrame, DataFrame]:
    """The runs of a cascade, which asks for no other table, and the roots with deeper descendants."""
    below, truncated = graph.descendants(runs, roots, most_depth)
    ids = roots.select("id").unionByName(below.select("id")).distinct()
    hit = runs.where(F.col("state").isin(*NON_TERMINAL)).join(ids, "id", "left_semi")
    return hit.select("id", F.col("state").alias("old_state"), F.lit("cancelled").alias("state")), truncated


def cancel_cascade(runs: DataFrame, tasks: DataFrame, timers: DataFrame, roots: DataFrame, most_depth: int = 10) -> dict[str, DataFrame]:
    """roots (id) and their descendants that have not ended: runs cancelled, open tasks discarded, timers
    resolved. truncated: roots with deeper descendants."""
    hit, truncated = cancelled_runs(runs, roots, most_depth)
    run_ids = hit.select(F.col("id").alias("run_id"))
    return {
        "runs": hit,
        "tasks": tasks.where("state IN ('available', 'leased')").join(run_ids, "run_id", "left_semi").select("id", "run_id", F.lit("discarded").alias("state")),
        "timers": timers.where(~F.col("fired")).join(run_ids, "run_id", "left_semi").select("id", "run_id", F.lit(True).alias("fired")),
        "truncated": truncated,
    }


def cancel_markers(runs: DataFrame, requests: DataFrame, reachable: DataFrame) -> DataFrame:
    """Requests (id) on leased active runs whose owner is not reachable (owner): the run is marked and woken."""
    out = runs.where(_active() & F.col("lease_owner").isNotNull()).join(requests.select("id"), "id", "left_semi")
    return out.join(reachable.select(F.col("owner").alias("lease_owner")), "lease_owner", "left_anti").select("id", "lease_owner", F.lit(True).alias("cancel_requested"))


# -- tasks


def requeue_expired(tasks: DataFrame, as_of: str) -> DataFrame:
    """Leased tasks whose lease is over become available again; that takes an attempt."""
    over = tasks.where((F.col("state") == "leased") & (F.col("lease_expires_at") < moment(as_of)))
    return over.select("id", "run_id", F.lit("available").alias("state"), (F.col("attempt") + 1).alias("attempt"))


def release_claims(tasks: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims (id, owner) that were not started: available again, with the same attempt."""
    mine = tasks.where("state = 'leased'").join(claims.select("id", F.col("owner").alias("lease_owner")), ["id", "lease_owner"], "left_semi")
    return mine.select("id", "run_id", F.lit("available").alias("state"), "attempt")


def claim_one(tasks: DataFrame, runs: DataFrame, requests: DataFrame, as_of: str) -> DataFrame:
    """requests (id, attempt) with the outcome claimed, stale (another attempt, or gone) or not_available."""
    from tideline.operators.tasks import claimable

    able = claimable(tasks, runs, as_of).select("id", F.lit(True).alias("able"))
    now = tasks.select("id", F.col("attempt").alias("_now"))
    out = requests.join(now, "id", "left").join(able, "id", "left")
    outcome = F.when(F.col("_now").isNull() | (F.col("_now") != F.col("attempt")), "stale").when(F.col("able"), "claimed").otherwise("not_available")
    return out.select("id", "attempt", outcome.alias("outcome"))


def task_lease_errors(tasks: DataFrame, writes: DataFrame, as_of: str) -> DataFrame:
    """writes (id, run_id, lease_owner, attempt) with the first reason against them, null for none."""
    held = tasks.select("id", *(F.col(c).alias(f"_{c}") for c in ("run_id", "state", "lease_owner", "attempt", "lease_expires_at")), F.lit(True).alias("_there"))
    j = writes.join(held, "id", "left")
    reason = (
        F.when(F.col("_there").isNull(), "not_found").when(~F.col("_run_id").eqNullSafe(F.col("run_id")), "run_mismatch").when(F.col("_state") != "leased", "not_leased")
        .when(~F.col("_lease_owner").eqNullSafe(F.col("lease_owner")), "lease_mismatch").when(F.col("_attempt") != F.col("attempt"), "attempt_mismatch")
        .when(F.col("_lease_expires_at").isNull(), "missing_expiry").when(F.col("_lease_expires_at") < moment(as_of), "lease_expired")
    )
    return j.select("id", "run_id", "lease_owner", "attempt", reason.alias("reason"))


#: What a worker does after a refused write. Requeued: the task is still its own, or the run has a new leader that
#: needs it. Dropped: the task is somebody else's. Discarded: there is no run that could take the result.
FENCED = {
    "lease_expired": "requeue", "missing_expiry": "requeue", "run_lease_lost": "requeue",
    "lease_mismatch": "drop", "attempt_mismatch": "drop", "not_leased": "drop", "not_found": "drop", "run_mismatch": "drop",
    "run_not_found": "discard", "run_not_active": "discard",
}


def fenced_write(error: str) -> str:
    """requeue, discard, drop or, for any other error, reraise."""
    return FENCED.get(error, "reraise")


def fenced_writes(errors: DataFrame) -> DataFrame:
    """Refused writes (reason) with their action."""
    known = F.create_map(*[F.lit(x) for pair in FENCED.items() for x in pair])
    return errors.where("reason IS NOT NULL").withColumn("action", F.coalesce(known[F.col("reason")], F.lit("reraise")))


def activity_outcomes(tasks: DataFrame, outcomes: DataFrame, as_of: str, most_attempts: int = 3, base_ms: int = 1000, cap_ms: int = 60_000, runs: DataFrame | None = None) -> dict[str, DataFrame]:
    """outcomes (id, ok): tasks (their new state, attempt and time), attempts (the log), events (right behind the
    task's own, where the activity ended) and woken (runs to go on with).

    Outcomes may also say run_id, lease_owner and attempt: those whose lease the task does not bear out are
    refused. With runs, so are those of tasks whose run is gone or has ended."""
    j = tasks.where("state = 'leased'").join(outcomes.select("id", "ok"), "id")
    refused = None
    if {"run_id", "lease_owner", "attempt"} <= set(outcomes.columns):
        refused = task_lease_errors(tasks, outcomes, as_of).where("reason IS NOT NULL").select("id", "reason")
    if runs is not None:
        state = runs.select(F.col("id").alias("run_id"), F.col("state").alias("_run"))
        reason = F.when(F.col("_run").isNull(), "run_not_found").when(~F.col("_run").isin(*ACTIVE), "run_not_active")
        ended = tasks.join(outcomes.select("id"), "id", "left_semi").join(state, "run_id", "left").select("id", reason.alias("reason")).where("reason IS NOT NULL")
        refused = ended if refused is None else refused.unionByName(ended.join(refused, "id", "left_anti"))
    if refused is not None:
        j = j.join(refused, "id", "left_anti")
    again = ~F.col("ok") & (F.col("attempt") < most_attempts)
    state = F.when(F.col("ok"), "completed").when(again, "available").otherwise("discarded")
    changed = j.select(
        "id", "run_id", state.alias("state"), F.when(again, F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt"),
        F.when(again, after(moment(as_of), backoff_ms("attempt", base_ms, cap_ms))).otherwise(F.col("available_at")).alias("available_at"),
    )
    log = j.select(F.col("id").alias("task_id"), F.coalesce("lineage_id", "id").alias("lineage_id"), "attempt", F.when(F.col("ok"), "completed").when(again, "retrying").otherwise("discarded").alias("outcome"))
    over = j.where(~again)
    written = over.select("run_id", (F.col("seq") + 1).alias("seq"), F.when(F.col("ok"), "activity_completed").otherwise("activity_failed").alias("event_type"), moment(as_of).alias("inserted_at"))
    woken = over.select(F.col("run_id").alias("id"), moment(as_of).alias("next_wakeup_at")).distinct()
    none = tasks.select("id", F.lit(None).cast("string").alias("reason")).limit(0)
    return {"tasks": changed, "attempts": log, "events": written, "woken": woken, "refused": none if refused is None else refused}


def heartbeat(tasks: DataFrame, runs: DataFrame, beats: DataFrame, as_of: str, ttl_ms: int = 30_000) -> DataFrame:
    """beats (id, owner, attempt) extend leases that are theirs and not over, of tasks whose run is led."""
    now = moment(as_of)
    mine = tasks.where((F.col("state") == "leased") & (F.col("lease_expires_at") > now)).join(beats.select("id", F.col("owner").alias("lease_owner"), "attempt"), ["id", "lease_owner", "attempt"], "left_semi")
    led = runs.where(_active() & (F.col("lease_expires_at") > now)).select(F.col("id").alias("run_id"))
    return mine.join(led, "run_id", "left_semi").select("id", "run_id", now.alias("last_heartbeat_at"), after(now, ttl_ms).alias("lease_expires_at"))


def manual_retry(runs: DataFrame, tasks: DataFrame, events: DataFrame, snapshots: DataFrame, requests: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """requests (id, operator, reason) on discarded or dead-lettered activities whose failure is the last event of a
    failed run: a successor task, the retry event, the operation and the reopened run; snapshots that reach
    the activity go. Refused: activity_task_not_found, not_discarded, already_retried, run_not_found,
    run_not_failed, child_run_retry_not_supported, failure_not_replay_tail, compensation_retry_not_supported."""
    asked = requests.groupBy("id").agg(F.min(F.struct("operator", "reason")).alias("_r")).select("id", "_r.*")
    mine = asked.join(tasks, "id")
    touched = events.join(mine.select("run_id").distinct(), "run_id", "left_semi")
    owner = runs.select(F.col("id").alias("run_id"), F.col("state").alias("_run"), F.col("parent_run_id").alias("_parent"), F.lit(True).alias("_known"))
    order = Window.partitionBy("run_id").orderBy("seq")
    ends = touched.select(
        "run_id", F.struct("seq", "event_type").alias("_tail"), F.lead("seq").over(order).isNull().alias("_last"), *(F.lag(c).over(order).alias(n) for c, n in (("seq", "_at"), ("event_type", "_opener"), ("command_id", "_command")))
    )
    tail = ends.where("_last").drop("_last")  # a failure's opener is the event right before it
    successor = tasks.where("parent_task_id IS NOT NULL").select(F.col("parent_task_id").alias("id"), F.lit(True).alias("_retried")).distinct()
    j = mine.join(successor, "id", "left").join(owner, "run_id", "left").join(tail, "run_id", "left")
    j = j.withColumns({c: F.when(F.col("_at") == F.col("seq"), F.col(c)) for c in ("_opener", "_command")})
    at_tail = F.coalesce((F.col("_tail.seq") == F.col("seq") + 1) & (F.col("_tail.event_type") == "activity_failed"), F.lit(False))
    refusal = (
        F.when(~F.col("state").isin("discarded", "dead_lettered"), "not_discarded").when(F.col("_retried"), "already_retried")
        .when(F.col("_known").isNull(), "run_not_found").when(F.col("_run") != "failed", "run_not_failed").when(F.col("_parent").isNotNull(), "child_run_retry_not_supported")
        .when(~at_tail, "failure_not_replay_tail").when(F.col("_opener") == "compensation_scheduled", "compensation_retry_not_supported")
    )
    j = j.withColumn("refusal", refusal)
    missing = asked.join(tasks.select("id"), "id", "left_anti").select("id", F.lit("activity_task_not_found").alias("refusal"))
    lineage, next_id, now = F.coalesce("lineage_id", "id"), derived_id(F.lit("retry"), "id"), moment(as_of)
    ok = j.where("refusal IS NULL").select("*", lineage.alias("_lineage"), next_id.alias("_next"), (F.col("seq") + 2).alias("_seq"))
    created = ok.select(
        F.col("_next").alias("id"), "run_id", F.col("_lineage").alias("lineage_id"), F.col("id").alias("parent_task_id"), F.col("_seq").alias("seq"), F.lit("available").alias("state"),
        "queue", "priority", F.lit(1).cast("long").alias("attempt"), now.alias("scheduled_at"), now.alias("available_at"),
    )
    written = ok.select("run_id", F.col("_seq").alias("seq"), F.lit("activity_retry_scheduled").alias("event_type"), F.col("_command").alias("command_id"), F.col("_next").alias("task_id"), F.col("id").alias("parent_task_id"), "operator", "reason", now.alias("inserted_at"))
    log = ok.select(F.col("id").alias("task_id"), F.col("_next").alias("successor_task_id"), F.col("_lineage").alias("lineage_id"), F.lit("manual_retry").alias("action"), F.lit("retryable").alias("classification"), "operator", "reason", now.alias("inserted_at"))
    reopened = ok.select(F.col("run_id").alias("id"), F.lit("suspended").alias("state"), *(F.lit(None).cast(t).alias(c) for c, t in (("error", "string"), ("lease_owner", "string"), ("lease_token", "long"), ("completed_at", "timestamp_ntz"), ("lease_expires_at", "timestamp_ntz"), ("next_wakeup_at", "timestamp_ntz"), ("retention_until", "timestamp_ntz"))))
    covering = snapshots.join(ok.select("run_id", F.col("seq").alias("_from")), "run_id").where(F.col("through_seq") >= F.col("_from")).select("run_id", "through_seq")
    return {"tasks": created, "events": written, "operations": log, "runs": reopened, "dropped_snapshots": covering, "refused": j.where("refusal IS NOT NULL").select("id", "refusal").unionByName(missing)}


def schedule_compensations(runs: DataFrame, events: DataFrame, tasks: DataFrame, requests: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """requests (run_id, token, seq, command_id, payload, task_id, lineage_id, queue, priority): the compensations
    of a run, each an event and a task. A run's batch is taken as a whole or not at all. Refused: lease_lost
    (no such run, one that has ended, another token), seq_taken, task_exists; a number or task that the requests
    themselves name twice counts as taken."""
    lease = runs.select(F.col("id").alias("run_id"), F.col("state").alias("_state"), F.col("lease_owner").alias("_owner"), F.col("lease_token").alias("_token"))
    held = F.coalesce(_active("_state") & token_matches(F.col("_token"), F.col("_owner"), F.col("token")), F.lit(False))
    batch = requests.join(lease, "run_id", "left").groupBy("run_id").agg(F.bool_and(held).alias("_held"), F.collect_set("seq").alias("_seqs"), (F.count_distinct("seq") < F.count(F.lit(1))).alias("_twice"))
    #: What is taken is told by run, not by run and number: histories are then met where they lie.
    written = events.join(batch.select("run_id", "_seqs"), "run_id").where(F.array_contains("_seqs", F.col("seq"))).select("run_id").distinct().withColumn("_written", F.lit(True))
    known = tasks.select(F.col("id").alias("task_id"), F.lit(True).alias("_known"))
    named = requests.where("task_id IS NOT NULL").select("run_id", "task_id").join(known, "task_id", "left").withColumn("_named", F.count(F.lit(1)).over(Window.partitionBy("task_id")))
    clash = named.where("_known OR _named > 1").select("run_id").distinct().withColumn("_exists", F.lit(True))
    by = batch.join(written, "run_id", "left").join(clash, "run_id", "left").withColumn("_taken", F.col("_twice") | F.coalesce("_written", F.lit(False)))
    judged = by.select("run_id", F.when(~F.col("_held"), "lease_lost").when(F.col("_taken"), "seq_taken").when(F.col("_exists"), "task_exists").alias("reason"))
    ok, now = requests.join(judged.where("reason IS NULL").select("run_id"), "run_id", "left_semi"), moment(as_of)
    made = ok.select(
        F.col("task_id").alias("id"), "run_id", F.coalesce("lineage_id", "task_id").alias("lineage_id"), F.lit(None).cast("string").alias("parent_task_id"), "seq", F.lit("available").alias("state"),
        F.coalesce("queue", F.lit("default")).alias("queue"), F.coalesce("priority", F.lit(0)).cast("long").alias("priority"), F.lit(1).cast("long").alias("attempt"), now.alias("scheduled_at"), now.alias("available_at"),
    )
    return {"events": ok.select("run_id", "seq", F.lit("compensation_scheduled").alias("event_type"), "command_id", "payload", now.alias("inserted_at")), "tasks": made, "refused": judged.where("reason IS NOT NULL")}


def operate(tasks: DataFrame, requests: DataFrame, as_of: str, dry_run: bool = True) -> tuple[DataFrame, DataFrame]:
    """(tasks changed, operations logged) of requests (id, action: classify or dead_letter, classification,
    operator) on discarded or dead-lettered tasks. A dry run changes and logs nothing but says planned."""
    j = tasks.where("state IN ('discarded', 'dead_lettered')").join(requests, "id")
    log = j.select(F.col("id").alias("task_id"), F.coalesce("lineage_id", "id").alias("lineage_id"), "action", "classification", "operator", moment(as_of).alias("inserted_at"), F.lit("planned" if dry_run else "executed").alias("status"))
    changed = j.where("action = 'dead_letter' AND state = 'discarded'").select("id", F.lit("dead_lettered").alias("state"))
    return (changed.limit(0) if dry_run else changed), log


# -- timers and signals


def arm_runs(timers: DataFrame, runs: DataFrame, as_of: str) -> DataFrame:
    """Suspended runs with a due timer wake now, unless they wake before."""
    due = timers.where(~F.col("fired") & (F.col("fires_at") <= moment(as_of))).select(F.col("run_id").alias("id"))
    later = F.col("next_wakeup_at").isNull() | (F.col("next_wakeup_at") > moment(as_of))
    return runs.where((F.col("state") == "suspended") & later).join(due, "id", "left_semi").select("id", moment(as_of).alias("next_wakeup_at"))


def fire_timers(timers: DataFrame, runs: DataFrame, as_of: str, limit: int = 100) -> DataFrame:
    """Due timers of suspended runs under a live lease, in order of their time."""
    led = runs.where((F.col("state") == "suspended") & F.col("lease_owner").isNotNull() & (F.col("lease_expires_at") > moment(as_of))).select(F.col("id").alias("run_id"), "lease_token")
    due = timers.where(~F.col("fired") & (F.col("fires_at") <= moment(as_of))).join(led, "run_id")
    return due.orderBy("fires_at", "id").limit(limit).select("id", "run_id", "fires_at", "lease_token")


def timer_winners(events: DataFrame) -> DataFrame:
    """run_id, seq, winner of each timer or await: what stands right behind it (timer_fired, signal_received,
    other), or pending."""
    order = Window.partitionBy("run_id").orderBy("seq")
    w = events.withColumns({"_next": F.lead("event_type").over(order), "_at": F.lead("seq").over(order)})
    winner = F.when(F.col("_at").isNull() | (F.col("_at") != F.col("seq") + 1), "pending").when(F.col("_next").isin("timer_fired", "signal_received"), F.col("_next")).otherwise("other")
    return w.where("event_type IN ('timer_started', 'signal_awaited')").select("run_id", "seq", "event_type", winner.alias("winner"))


def mailbox_heads(signals: DataFrame) -> DataFrame:
    """run_id, name, id of the first undelivered signal of each mailbox."""
    first = signals.where(~F.col("delivered")).groupBy("run_id", "name").agg(F.min(F.struct("inserted_at", "id")).alias("h"))
    return first.select("run_id", "name", F.col("h.id").alias("signal_id"))


def signal_race(awaits: DataFrame, signals: DataFrame, events: DataFrame, as_of: str) -> DataFrame:
    """awaits (run_id, seq, name, timeout_at) with the winner: what the history has behind them, else a waiting
    signal (even past the deadline), else timeout from the deadline on, else pending."""
    written = timer_winners(events).where("winner IN ('timer_fired', 'signal_received')").select("run_id", "seq", F.col("winner").alias("_written"))
    j = awaits.join(written, ["run_id", "seq"], "left").join(mailbox_heads(signals), ["run_id", "name"], "left")
    winner = F.coalesce("_written", F.when(F.col("signal_id").isNotNull(), "signal").when(F.col("timeout_at") <= moment(as_of), "timeout").otherwise("pending"))
    return j.select("run_id", "seq", "name", "signal_id", winner.alias("winner"))


def deliver(runs: DataFrame, signals: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signals to add, id and outcome of each new signal): delivered goes to the live tip of the run's chain;
    terminal and missing runs refuse; a known delivery is a duplicate."""
    tips = graph.chain_tips(runs).select(F.col("id").alias("run_id"), "tip_id")
    state = runs.select(F.col("id").alias("tip_id"), F.col("state").alias("_state"))
    j = new.join(tips, "run_id", "left").join(state, "tip_id", "left")
    j = j.withColumn("outcome", F.when(F.col("tip_id").isNull(), "missing").when(F.col("_state").isin(*TERMINAL), "terminal"))
    open_ones = j.where("outcome IS NULL").withColumn("run_id", F.col("tip_id")).select(*new.columns)
    added = history.insert_signals(signals, open_ones)
    fresh = added.select("id", F.lit("delivered").alias("_fresh"))
    outcome = j.join(fresh, "id", "left").select("id", F.coalesce("outcome", "_fresh", F.lit("duplicate")).alias("outcome"))
    return added, outcome


def wake_evidence(runs: DataFrame, signals: DataFrame, as_of: str) -> DataFrame:
    """run_id, evidence_at, oldest_wake_age_ms of led runs that a signal or their time should have woken."""
    led = runs.where(_active() & F.col("lease_owner").isNotNull() & F.col("lease_token").isNotNull() & (F.col("lease_expires_at") > moment(as_of)))
    ids = led.select(F.col("id").alias("run_id"))
    by_signal = signals.where(~F.col("delivered")).join(ids, "run_id", "left_semi").select("run_id", F.col("inserted_at").alias("evidence_at"))
    by_time = led.where(F.col("next_wakeup_at") <= moment(as_of)).select(F.col("id").alias("run_id"), F.col("next_wakeup_at").alias("evidence_at"))
    least = by_signal.unionByName(by_time).groupBy("run_id").agg(F.min("evidence_at").alias("evidence_at"))
    return least.withColumn("oldest_wake_age_ms", age_ms("evidence_at", as_of))


def wake_totals(evidence: DataFrame) -> DataFrame:
    return evidence.agg(F.count(F.lit(1)).alias("runs"), F.coalesce(F.max("oldest_wake_age_ms"), F.lit(0).cast("long")).alias("oldest_wake_age_ms"))


def child_events(runs: DataFrame, awaits: DataFrame, as_of: str) -> DataFrame:
    """awaits (run_id, child_run_id) whose child has ended: the event for the parent's history."""
    ended = graph.children_outcomes(runs).where("outcome != 'pending'").select("child_run_id", "outcome", "tip_id")
    return awaits.join(ended, "child_run_id").select("run_id", "child_run_id", F.concat(F.lit("child_"), "outcome").alias("event_type"), moment(as_of).alias("inserted_at"))


# -- schedules


def claim_schedules(schedules: DataFrame, as_of: str, limit: int = 50, stale_ms: int = 30_000) -> DataFrame:
    """Due schedules that wait, or that were claimed so long ago that the claim is stale; that takes an attempt."""
    now = moment(as_of)
    stale = (F.col("state") == "starting") & (F.col("claimed_at") < after(now, -stale_ms))
    due = schedules.where((F.col("scheduled_at") <= now) & ((F.col("state") == "scheduled") | stale))
    return due.orderBy("scheduled_at", "id").limit(limit).select("id", "run_id", "scheduled_at", F.col("state").alias("old_state"), (F.col("attempt") + 1).alias("attempt"))


def schedule_outcomes(claimed: DataFrame, outcomes: DataFrame, as_of: str, most_attempts: int = 12, base_ms: int = 1000, cap_ms: int = 60_000) -> DataFrame:
    """outcomes (id, ok): started, waiting again with backoff, or failed at the last attempt."""
    j = claimed.join(outcomes.select("id", "ok"), "id")
    state = F.when(F.col("ok"), "started").when(F.col("attempt") >= most_attempts, "failed").otherwise("scheduled")
    at = F.when(state == "scheduled", after(moment(as_of), backoff_ms("attempt", base_ms, cap_ms))).otherwise(F.col("scheduled_at"))
    return j.select("id", state.alias("state"), "attempt", at.alias("scheduled_at"))


def create_schedules(schedules: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (id, run_id, workflow, version_hash, namespace, scheduled_at) as schedules that wait; ids that exist
    are left out, and of equal ones the first run counts."""
    new = history.insert_if_absent(schedules, requests, ["id"], ["scheduled_at", "run_id"])
    waiting = {"namespace": F.coalesce("namespace", F.lit("default")), "state": F.lit("scheduled"), "attempt": F.lit(0).cast("long"), "claimed_at": F.lit(None).cast("timestamp_ntz")}
    return new.withColumns(waiting).select("id", "run_id", "workflow", "version_hash", "namespace", "scheduled_at", "state", "attempt", "claimed_at")


def cancel_schedules(schedules: DataFrame, requests: DataFrame) -> DataFrame:
    return schedules.where("state = 'scheduled'").join(requests.select("id"), "id", "left_semi").select("id", F.lit("cancelled").alias("state"))


# -- repairs


def repairs(findings: DataFrame, requests: DataFrame, dry_run: bool = True) -> DataFrame:
    """requests (action, finding_type, subject_id, fingerprint) with a status: planned or repaired where the
    finding is still there as it was seen, stale where it changed, and already_resolved where it is gone."""
    keys = ["finding_type", "subject_id"]
    now = findings.select(*keys, F.col("fingerprint").alias("_now"))
    j = requests.join(now, keys, "left")
    status = F.when(F.col("_now").isNull(), "already_resolved").when(F.col("_now") != F.col("fingerprint"), "stale").otherwise("planned" if dry_run else "repaired")
    return j.select("action", *keys, "fingerprint", status.alias("status"))
