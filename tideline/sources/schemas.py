"""Column types of the workflow tables, and the values that their state columns take."""

from __future__ import annotations

#: As DDL, which readers take without a session being there.
TABLES = {
    "runs": "id string, workflow string, version_hash string, namespace string, state string, attributes string, input string, result string, error string,"
    " started_at timestamp_ntz, completed_at timestamp_ntz, retention_until timestamp_ntz, lease_owner string, lease_token bigint, lease_expires_at timestamp_ntz,"
    " next_wakeup_at timestamp_ntz, parent_run_id string, correlation_id string, continued_from_run_id string, cancel_requested_at timestamp_ntz",
    "events": "run_id string, seq bigint, event_type string, command_id string, payload string, inserted_at timestamp_ntz",
    "tasks": "id string, run_id string, lineage_id string, parent_task_id string, seq bigint, state string, queue string, priority bigint, attempt bigint,"
    " scheduled_at timestamp_ntz, available_at timestamp_ntz, lease_owner string, lease_expires_at timestamp_ntz, last_heartbeat_at timestamp_ntz",
    "attempts": "id string, task_id string, lineage_id string, attempt bigint, outcome string, inserted_at timestamp_ntz",
    "operations": "id string, task_id string, lineage_id string, action string, classification string, operator string, reason string, inserted_at timestamp_ntz",
    "results": "activity_module string, idempotency_key string, run_id string, seq bigint, payload string, completed_at timestamp_ntz",
    "ingress_keys": "namespace string, workflow string, idempotency_key string, run_id string, inserted_at timestamp_ntz",
    "signals": "id string, run_id string, correlation_id string, name string, delivery_id string, payload string, delivered boolean, inserted_at timestamp_ntz",
    "timers": "id string, run_id string, fires_at timestamp_ntz, fired boolean",
    "schedules": "id string, run_id string, workflow string, version_hash string, namespace string, scheduled_at timestamp_ntz, state string, attempt bigint, claimed_at timestamp_ntz",
    "snapshots": "run_id string, through_seq bigint, format_version bigint, version_hash string, steps string, inserted_at timestamp_ntz",
    "versions": "workflow string, version_hash string, entrypoint string",
    "reviews": "finding_type string, subject_id string, fingerprint string, reviewed_at timestamp_ntz",
}

#: States and other enumerations.
ACTIVE = ("running", "suspended")
NON_TERMINAL = ("running", "suspended", "stuck_unknown_version")
TERMINAL = ("completed", "failed", "cancelled")
TASK_STATES = ("available", "leased", "completed", "discarded", "dead_lettered")
ATTEMPT_OUTCOMES = ("completed", "discarded", "retrying")
OPERATION_ACTIONS = ("classify", "dead_letter", "manual_retry")
SCHEDULE_STATES = ("scheduled", "starting", "started", "cancelled", "failed")
FINDING_TYPES = ("lost_wake", "overdue_timer", "expired_lease", "expired_activity_lease", "dead_letter_activity", "failed_schedule")
WAIT_BY_EVENT = {
    "activity_scheduled": "activity",
    "compensation_scheduled": "compensation",
    "timer_started": "timer",
    "signal_awaited": "signal",
    "child_started": "child",
}
EVENT_TYPES = (
    "side_effect", "workflow_log", "activity_scheduled", "activity_completed", "activity_failed", "activity_retry_scheduled",
    "signal_awaited", "signal_received", "timer_started", "timer_fired", "compensation_scheduled", "compensation_completed",
    "compensation_failed", "child_started", "child_completed", "child_failed", "child_cancelled", "run_continued_as_new", "patched",
)
