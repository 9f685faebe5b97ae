"""The registered queries over the derived workflow tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import scalars
from tideline.operators import folds, graph, health, history, repairs, retention, tasks, transitions, versions
from tideline.operators.query import ALL_NAMESPACES, RunQuery, encode_cursor
from tideline.sources.fixtures import AS_OF, with_tables, workflow_tables
from tideline.streaming import signals

NOW = f"TIMESTAMP '{AS_OF}'"
NON_TERMINAL = "('running','suspended','stuck_unknown_version')"
ACTIVE = "('running','suspended')"
TERMINAL = "('completed','failed','cancelled')"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f: Callable[[dict[str, DataFrame]], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(workflow_tables(spark, sf_dir))
        ORACLES[f.__name__] = with_tables(sql)
        return f

    return add


def age(since: str) -> str:
    return f"CASE WHEN {since} IS NOT NULL THEN CAST(greatest(0, epoch_ms({NOW}) - epoch_ms({since})) AS BIGINT) END"


# -- structured run query

_RUN = ["id", "workflow", "namespace", "state", "started_at"]
_RUN_SQL = "SELECT id, workflow, namespace, state, started_at FROM wf_runs WHERE "


@query(_RUN_SQL + "namespace = 'default' AND state = 'running'")
def run_query_state(t):
    return RunQuery(state="RUNNING").filtered(t["runs"]).select(*_RUN)


@query(_RUN_SQL + "state IN ('failed','cancelled') AND namespace = 'tenant-a'")
def run_query_in(t):
    return RunQuery(where=[("in", "state", ["failed", "cancelled"])], namespace="tenant-a").filtered(t["runs"]).select(*_RUN)


@query(_RUN_SQL + "started_at >= TIMESTAMP '1996-01-01' AND started_at < TIMESTAMP '1996-07-01' AND completed_at IS NOT NULL AND completed_at <> TIMESTAMP '1996-03-01'")
def run_query_range(t):
    where = [("gte", "started_at", "1996-01-01"), ("lt", "started_at", "1996-07-01"), ("neq", "completed_at", "1996-03-01")]
    return RunQuery(where=where, namespace=ALL_NAMESPACES).filtered(t["runs"]).select(*_RUN)


@query(_RUN_SQL + "namespace = 'default' AND json_extract(attributes, '$.profile.tier') = '\"3\"'")
def run_query_attr_eq(t):
    return RunQuery(where=[("eq", ("attributes", "profile", "tier"), "3")]).filtered(t["runs"]).select(*_RUN)


@query(_RUN_SQL + "json_extract(attributes, '$.tier') = '4'")
def run_query_attr_number(t):
    return RunQuery(where=[("eq", ("attributes", "tier"), 4)], namespace=ALL_NAMESPACES).filtered(t["runs"]).select(*_RUN)


@query(_RUN_SQL + "namespace = 'default' AND json_extract(attributes, '$.region') IS NOT NULL AND json_extract(attributes, '$.region') <> '\"BUILDING\"'")
def run_query_attr_neq(t):
    return RunQuery(where=[("neq", ("attributes", "region"), "BUILDING"), ]).filtered(t["runs"]).select(*_RUN)


@query(_RUN_SQL + "json_extract(attributes, '$.profile.tier') = '2' AND json_extract(attributes, '$.tier') = '2'")
def run_query_attr_object(t):
    return RunQuery(where=[("eq", ("attributes", "profile"), {"tier": 2})], namespace=ALL_NAMESPACES).filtered(t["runs"]).select(*_RUN)


@query(_RUN_SQL + "namespace = 'default' AND (id ILIKE '%urg%' OR workflow ILIKE '%urg%')")
def run_query_search(t):
    return RunQuery(search="urg").filtered(t["runs"]).select(*_RUN)


@query(_RUN_SQL + "namespace = 'default' AND workflow ILIKE '%h_gh%'")
def run_query_workflow(t):
    return RunQuery(workflow="h_gh").filtered(t["runs"]).select(*_RUN)


@query(_RUN_SQL + "namespace = 'default' ORDER BY started_at DESC NULLS LAST, id DESC LIMIT 26")
def run_page_first(t):
    return RunQuery().page_frame(t["runs"]).select(*_RUN)


@query(_RUN_SQL + "namespace = 'default' AND (completed_at > TIMESTAMP '1998-01-01' OR completed_at IS NULL OR (completed_at = TIMESTAMP '1998-01-01' AND id > '000000100')) ORDER BY completed_at NULLS LAST, id LIMIT 41")
def run_page_next_nonnull(t):
    cursor = encode_cursor("asc", "completed_at", "1998-01-01 00:00:00", "000000100")
    return RunQuery(order_by=("asc", "completed_at"), per_page=40, cursor=cursor).page_frame(t["runs"]).select(*_RUN)


@query(_RUN_SQL + "namespace = 'default' AND completed_at IS NULL AND id < '000003000' ORDER BY completed_at DESC NULLS LAST, id DESC LIMIT 101")
def run_page_next_null(t):
    cursor = encode_cursor("desc", "completed_at", None, "000003000")
    return RunQuery(order_by=("desc", "completed_at"), per_page=500, cursor=cursor).page_frame(t["runs"]).select(*_RUN)


@query("SELECT id, CASE WHEN strlen(attributes) > 60 THEN '{\"omitted\":true,\"encoded_bytes\":' || strlen(attributes) || '}' ELSE attributes END AS attributes, coalesce(namespace, 'default') AS namespace FROM wf_runs")
def run_payload_cap(t):
    return t["runs"].select("id", scalars.capped("attributes", 60).alias("attributes"), F.coalesce("namespace", F.lit("default")).alias("namespace"))


# -- health


@query(f"""
    WITH latest AS (SELECT run_id, arg_max(event_type, seq) AS e FROM wf_events GROUP BY run_id),
    a AS (SELECT r.state, r.started_at, CASE WHEN r.state = 'stuck_unknown_version' THEN 'unknown_version' WHEN e = 'activity_scheduled' THEN 'activity'
            WHEN e = 'compensation_scheduled' THEN 'compensation' WHEN e = 'timer_started' THEN 'timer' WHEN e = 'signal_awaited' THEN 'signal'
            WHEN e = 'child_started' THEN 'child' WHEN r.state = 'running' THEN 'executing' ELSE coalesce(e, 'unknown') END AS reason
          FROM wf_runs r LEFT JOIN latest ON latest.run_id = r.id WHERE r.state IN {NON_TERMINAL})
    SELECT state, reason, count(*) AS runs, min(started_at) AS oldest_started_at, {age('min(started_at)')} AS oldest_age_ms FROM a GROUP BY state, reason""")
def wait_reasons(t):
    return health.wait_reasons(t["runs"], t["events"], AS_OF)


@query(f"SELECT id, state, lease_owner, lease_token, next_wakeup_at, {age('next_wakeup_at')} AS lag_ms FROM wf_runs WHERE state IN {ACTIVE} AND lease_owner IS NOT NULL AND lease_token IS NOT NULL AND lease_expires_at > {NOW} AND next_wakeup_at <= {NOW} - INTERVAL '60' SECOND")
def lost_wakes(t):
    return health.lost_wakes(t["runs"], AS_OF)


@query(f"SELECT t.id, t.run_id, r.state, t.fires_at, {age('t.fires_at')} AS lag_ms FROM wf_timers t JOIN wf_runs r ON r.id = t.run_id WHERE NOT fired AND fires_at <= {NOW} AND r.state IN {ACTIVE}")
def overdue_timers(t):
    return health.overdue_timers(t["timers"], t["runs"], AS_OF)


@query(f"SELECT id, state, lease_owner, lease_token, lease_expires_at, lease_expires_at <= {NOW} AS expired FROM wf_runs WHERE state IN {ACTIVE} AND lease_owner IS NOT NULL AND lease_expires_at <= {NOW}")
def expired_leases(t):
    return health.leases(t["runs"], AS_OF).where("expired")


@query(f"SELECT count(*) AS leases, count(*) FILTER (WHERE lease_expires_at <= {NOW}) AS expired FROM wf_runs WHERE state IN {ACTIVE} AND lease_owner IS NOT NULL")
def lease_counts(t):
    return health.lease_counts(t["runs"], AS_OF)


@query("SELECT state, count(*) AS tasks FROM wf_tasks GROUP BY state")
def task_counts_by_state(t):
    return health.tasks_by_state(t["tasks"])


@query("SELECT queue, state, count(*) AS tasks FROM wf_tasks GROUP BY queue, state")
def task_counts_by_queue(t):
    return health.tasks_by_queue(t["tasks"])


@query("SELECT attempt, count(*) AS tasks FROM wf_tasks WHERE state IN ('available','leased') GROUP BY attempt")
def attempt_histogram(t):
    return health.attempt_histogram(t["tasks"])


@query(f"SELECT min(scheduled_at) AS oldest_scheduled_at, {age('min(scheduled_at)')} AS oldest_age_ms FROM wf_tasks WHERE state = 'available'")
def oldest_pending_task(t):
    return health.oldest_pending(t["tasks"], AS_OF)


@query(f"SELECT id, run_id, queue, attempt, lease_owner, lease_expires_at, {age('lease_expires_at')} AS lag_ms FROM wf_tasks WHERE state = 'leased' AND lease_expires_at <= {NOW}")
def expired_task_leases(t):
    return health.expired_task_leases(t["tasks"], AS_OF)


@query("SELECT t.id, t.run_id, t.state, r.state AS run_state, t.queue, t.attempt FROM wf_tasks t LEFT JOIN wf_runs r ON r.id = t.run_id WHERE t.state IN ('discarded','dead_lettered') AND (r.state IS NULL OR r.state <> 'cancelled')")
def dead_letters(t):
    return health.dead_letters(t["tasks"], t["runs"])


@query(f"SELECT id, run_id, last_heartbeat_at, {age('last_heartbeat_at')} AS age_ms FROM wf_tasks WHERE state = 'leased' AND last_heartbeat_at IS NOT NULL ORDER BY last_heartbeat_at DESC, id LIMIT 50")
def heartbeats(t):
    return health.heartbeats(t["tasks"], AS_OF)


@query(f"""SELECT count(*) FILTER (WHERE t.state = 'leased' AND t.lease_expires_at <= {NOW}) AS expired_leases, count(*) FILTER (WHERE t.state = 'dead_lettered') AS explicit_dead_letters,
    count(*) FILTER (WHERE t.state = 'leased' AND t.last_heartbeat_at IS NOT NULL) AS heartbeats,
    count(*) FILTER (WHERE t.state IN ('discarded','dead_lettered') AND (r.state IS NULL OR r.state <> 'cancelled')) AS dead_letters FROM wf_tasks t LEFT JOIN wf_runs r ON r.id = t.run_id""")
def task_alarm_counts(t):
    return health.task_alarm_counts(t["tasks"], t["runs"], AS_OF)


@query(f"SELECT count(*) AS signals, min(inserted_at) AS oldest_inserted_at, {age('min(inserted_at)')} AS lag_ms FROM wf_signals WHERE NOT delivered")
def signal_backlog(t):
    return health.signal_backlog(t["signals"], AS_OF)


@query(f"SELECT count(*) FILTER (WHERE state IN ('scheduled','starting') AND scheduled_at <= {NOW}) AS due, min(scheduled_at) FILTER (WHERE state IN ('scheduled','starting') AND scheduled_at <= {NOW}) AS oldest_due_at, count(*) FILTER (WHERE state = 'failed') AS failed FROM wf_schedules")
def due_schedules(t):
    return health.schedule_health(t["schedules"], AS_OF)


@query("SELECT count(*) AS rows, min(inserted_at) AS oldest_inserted_at FROM wf_events WHERE NOT (inserted_at >= TIMESTAMP '1993-01-01' AND inserted_at < TIMESTAMP '1998-01-01')")
def overflow_partition(t):
    return health.overflow(t["events"], "1993-01-01", "1998-01-01")


_FOUND = f"""
    found AS (
      SELECT 'lost_wake' AS finding_type, id AS subject_id, next_wakeup_at AS since FROM wf_runs WHERE state IN {ACTIVE} AND lease_owner IS NOT NULL AND lease_token IS NOT NULL AND lease_expires_at > {NOW} AND next_wakeup_at <= {NOW} - INTERVAL '60' SECOND
      UNION ALL SELECT 'overdue_timer', t.id, t.fires_at FROM wf_timers t JOIN wf_runs r ON r.id = t.run_id WHERE NOT fired AND fires_at <= {NOW} AND r.state IN {ACTIVE}
      UNION ALL SELECT 'expired_lease', id, lease_expires_at FROM wf_runs WHERE state IN {ACTIVE} AND lease_owner IS NOT NULL AND lease_expires_at <= {NOW}
      UNION ALL SELECT 'expired_activity_lease', id, lease_expires_at FROM wf_tasks WHERE state = 'leased' AND lease_expires_at <= {NOW}
      UNION ALL SELECT 'dead_letter_activity', t.id, NULL FROM wf_tasks t LEFT JOIN wf_runs r ON r.id = t.run_id WHERE t.state IN ('discarded','dead_lettered') AND (r.state IS NULL OR r.state <> 'cancelled')
      UNION ALL SELECT 'failed_schedule', id, scheduled_at FROM wf_schedules WHERE state = 'failed')"""


def _all_findings(t):
    return health.findings(t["runs"], t["tasks"], t["timers"], t["schedules"], AS_OF)


@query(f"WITH {_FOUND} SELECT finding_type, subject_id, since FROM found")
def health_findings(t):
    return _all_findings(t).select("finding_type", "subject_id", "since")


def _reviews(t):
    """Every finding of a schedule is acknowledged, and each tenth other one; taken from the findings themselves."""
    return _all_findings(t).where("finding_type = 'failed_schedule' OR subject_id LIKE '%0'")


@query(f"WITH {_FOUND}, s AS (SELECT finding_type, count(*) AS findings, count(*) FILTER (WHERE finding_type = 'failed_schedule' OR subject_id LIKE '%0') AS reviewed FROM found GROUP BY finding_type) SELECT *, findings > reviewed AS degraded, (SELECT bool_or(findings > reviewed) FROM s) AS degraded_overall FROM s")
def health_status(t):
    return health.status(health.reviewed(_all_findings(t), _reviews(t)))


@query(f"WITH {_FOUND} SELECT finding_type, subject_id, since, (finding_type = 'failed_schedule' OR subject_id LIKE '%0') AS reviewed FROM found ORDER BY reviewed, since NULLS LAST, finding_type, subject_id LIMIT 50")
def health_worst(t):
    return health.worst_first(health.reviewed(_all_findings(t), _reviews(t))).select("finding_type", "subject_id", "since", "reviewed")


# -- graph


@query("""WITH RECURSIVE walk AS (SELECT id, id AS node, 0 AS depth FROM wf_runs UNION ALL SELECT w.id, r.id, w.depth + 1 FROM walk w JOIN wf_runs r ON r.continued_from_run_id = w.node)
    SELECT id, arg_max(node, depth) AS tip_id, CAST(max(depth) AS BIGINT) AS depth FROM walk GROUP BY id""")
def chain_tip(t):
    return graph.chain_tips(t["runs"])


@query("SELECT r.correlation_id, r.id FROM wf_runs r WHERE NOT EXISTS (SELECT 1 FROM wf_runs s WHERE s.continued_from_run_id = r.id) AND r.correlation_id IS NOT NULL")
def group_tips(t):
    return graph.group_tips(t["runs"])


@query("""WITH RECURSIVE up AS (SELECT id, parent_run_id, 0 AS depth FROM wf_runs UNION ALL SELECT u.id, r.parent_run_id, u.depth + 1 FROM up u JOIN wf_runs r ON r.id = u.parent_run_id)
    SELECT id, CAST(max(depth) AS BIGINT) AS depth FROM up GROUP BY id""")
def ancestor_depth(t):
    return graph.ancestor_depth(t["runs"])


def _roots(t):
    return t["runs"].where("parent_run_id IS NULL AND continued_from_run_id IS NULL").select("id")


_DOWN = "WITH RECURSIVE down AS (SELECT id AS root_id, id, 0 AS depth FROM wf_runs WHERE parent_run_id IS NULL AND continued_from_run_id IS NULL UNION ALL SELECT d.root_id, r.id, d.depth + 1 FROM down d JOIN wf_runs r ON r.parent_run_id = d.id WHERE d.depth < 10)"


@query(_DOWN + " SELECT root_id, id, CAST(depth AS BIGINT) AS depth FROM down WHERE depth > 0")
def descendants(t):
    return graph.descendants(t["runs"], _roots(t))[0]


@query(f"""WITH RECURSIVE walk AS (SELECT id, id AS node, 0 AS depth FROM wf_runs UNION ALL SELECT w.id, r.id, w.depth + 1 FROM walk w JOIN wf_runs r ON r.continued_from_run_id = w.node),
    tips AS (SELECT id, arg_max(node, depth) AS tip_id FROM walk GROUP BY id)
    SELECT c.parent_run_id, c.id AS child_run_id, tips.tip_id, CASE WHEN r.state IN {TERMINAL} THEN r.state ELSE 'pending' END AS outcome
    FROM wf_runs c JOIN tips ON tips.id = c.id JOIN wf_runs r ON r.id = tips.tip_id WHERE c.parent_run_id IS NOT NULL AND c.continued_from_run_id IS NULL""")
def children_outcomes(t):
    return graph.children_outcomes(t["runs"])


# -- retention

_STATS = f"""stats AS (SELECT coalesce(correlation_id, id) AS logical_id, string_agg(id, ',' ORDER BY started_at, id) AS run_ids, min(completed_at) AS oldest_completed_at, max(completed_at) AS newest_completed_at,
    bool_and(state IN {TERMINAL}) AS terminal, bool_and(completed_at IS NOT NULL) AS completed, bool_and(retention_until IS NOT NULL AND retention_until < {NOW}) AS expired, bool_and(completed_at < {NOW}) AS older FROM wf_runs GROUP BY 1)"""
_PRUNABLE = f"""{_STATS}, prunable AS (SELECT logical_id, run_ids, oldest_completed_at, newest_completed_at FROM stats WHERE terminal AND completed AND expired AND older AND logical_id NOT IN
    (SELECT coalesce(p.correlation_id, p.id) FROM wf_runs c JOIN wf_runs p ON p.id = c.parent_run_id))"""


def _joined(frame):
    return frame.withColumn("run_ids", F.array_join("run_ids", ","))


@query(f"WITH {_STATS} SELECT * FROM stats")
def chain_stats(t):
    return _joined(retention.chain_stats(t["runs"], AS_OF))


@query(f"WITH {_PRUNABLE} SELECT * FROM prunable")
def prunable_chains(t):
    return _joined(retention.prunable(t["runs"], AS_OF, batch=None))


@query(f"WITH {_PRUNABLE} SELECT * FROM prunable ORDER BY oldest_completed_at, logical_id LIMIT 100")
def prune_batch(t):
    return _joined(retention.prunable(t["runs"], AS_OF))


@query(f"""WITH {_PRUNABLE}, ids AS (SELECT r.id FROM wf_runs r JOIN prunable ON logical_id = coalesce(r.correlation_id, r.id))
    SELECT 'events' AS table_name, count(*) AS rows FROM wf_events WHERE run_id IN (SELECT id FROM ids) UNION ALL SELECT 'tasks', count(*) FROM wf_tasks WHERE run_id IN (SELECT id FROM ids)
    UNION ALL SELECT 'signals', count(*) FROM wf_signals WHERE run_id IN (SELECT id FROM ids) UNION ALL SELECT 'timers', count(*) FROM wf_timers WHERE run_id IN (SELECT id FROM ids)""")
def prune_dependents(t):
    return retention.dependents(retention.prunable(t["runs"], AS_OF, batch=None), {n: t[n] for n in ("events", "tasks", "signals", "timers")})


@query(f"""SELECT r.id, r.correlation_id, r.completed_at FROM wf_runs r WHERE r.state = 'completed' AND r.completed_at < {NOW} - INTERVAL '30' DAY AND r.retention_until < {NOW}
    AND EXISTS (SELECT 1 FROM wf_runs s WHERE s.continued_from_run_id = r.id)
    AND NOT EXISTS (SELECT 1 FROM wf_runs c JOIN wf_runs p ON p.id = c.parent_run_id WHERE c.correlation_id = r.correlation_id AND p.state IN {NON_TERMINAL})""")
def archive_candidates(t):
    return retention.archivable(t["runs"], AS_OF, 30)


@query("SELECT strftime(inserted_at, '%Y-%m') AS month, count(*) AS rows FROM wf_events GROUP BY 1")
def partition_counts(t):
    return retention.partition_counts(t["events"])


@query(f"""SELECT strftime(e.inserted_at, '%Y-%m') AS month, count(*) AS rows, NOT bool_or(r.id IS NOT NULL AND (r.retention_until IS NULL OR r.retention_until >= {NOW})) AS droppable
    FROM wf_events e LEFT JOIN wf_runs r ON r.id = e.run_id GROUP BY 1""")
def partition_droppable(t):
    return retention.droppable_partitions(t["events"], t["runs"], AS_OF)


# -- versions


@query(f"SELECT workflow, version_hash, count(*) AS runs, min(started_at) AS oldest_started_at FROM wf_runs WHERE state IN {NON_TERMINAL} GROUP BY 1, 2")
def required_versions(t):
    return versions.required(t["runs"])


@query(f"SELECT r.workflow, r.version_hash, count(*) AS runs, min(r.started_at) AS oldest_started_at, CASE WHEN bool_or(v.entrypoint IS NOT NULL) THEN 'loaded' ELSE 'missing' END AS status FROM wf_runs r LEFT JOIN wf_versions v USING (workflow, version_hash) WHERE r.state IN {NON_TERMINAL} GROUP BY 1, 2")
def version_preflight(t):
    return versions.preflight(t["runs"], t["versions"])


@query("""WITH a AS (SELECT workflow, version_hash FROM wf_versions WHERE workflow <> 'Flow.URGENT'), b AS (SELECT DISTINCT workflow, version_hash FROM wf_runs)
    SELECT *, 'loaded_only' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'durable_only' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def version_differences(t):
    return versions.differences(t["versions"].where("workflow != 'Flow.URGENT'"), t["runs"])


@query(f"""WITH known AS (SELECT workflow, version_hash FROM wf_versions UNION ALL SELECT DISTINCT workflow, 'v9' FROM wf_versions), loaded AS (SELECT * FROM wf_versions WHERE version_hash = 'v0' AND workflow <> 'Flow.HIGH')
    SELECT workflow, version_hash FROM known WHERE workflow IN (SELECT workflow FROM loaded) AND (workflow, version_hash) NOT IN (SELECT workflow, version_hash FROM loaded)
    AND (workflow, version_hash) NOT IN (SELECT workflow, version_hash FROM wf_runs WHERE state IN {NON_TERMINAL})""")
def version_gc(t):
    """With a version of each workflow that no run has."""
    known = t["versions"].select("workflow", "version_hash").unionByName(t["versions"].select("workflow", F.lit("v9").alias("version_hash")).distinct())
    loaded = t["versions"].where("version_hash = 'v0' AND workflow != 'Flow.HIGH'")
    return versions.collectable(known, loaded, t["runs"])


_SITES = "sites AS (SELECT workflow, version_hash, 'retry' AS name, 'c1' AS command_base FROM wf_versions), marks AS (SELECT run_id, seq, 'patched' AS event_type, command_id || '/0' AS command_id, inserted_at FROM wf_events WHERE event_type = 'timer_started')"


@query(f"""WITH {_SITES}, open AS (SELECT s.*, r.id AS run_id, (SELECT min(m.inserted_at) FROM marks m WHERE m.run_id = r.id AND m.command_id = s.command_base || '/0') AS seen
      FROM sites s LEFT JOIN wf_runs r ON r.workflow = s.workflow AND r.version_hash = s.version_hash AND r.state IN {NON_TERMINAL})
    SELECT workflow, version_hash, name, count(*) FILTER (WHERE run_id IS NOT NULL AND seen IS NULL) AS in_flight_pre_patch, min(seen) AS first_seen_at,
      CASE WHEN count(*) FILTER (WHERE run_id IS NOT NULL AND seen IS NULL) = 0 THEN 'safe-to-remove' ELSE 'still-in-use' END AS verdict FROM open GROUP BY 1, 2, 3""")
def patch_audit(t):
    marks = t["events"].where("event_type = 'timer_started'").withColumns({"event_type": F.lit("patched"), "command_id": F.concat("command_id", F.lit("/0"))})
    return versions.patch_audit(t["runs"], marks, t["versions"].select("workflow", "version_hash", F.lit("retry").alias("name"), F.lit("c1").alias("command_base")))


@query("SELECT count(*) AS stuck_runs FROM wf_runs WHERE state = 'stuck_unknown_version'")
def stuck_runs(t):
    return versions.stuck(t["runs"])


@query("SELECT r.id, r.workflow, r.version_hash FROM wf_runs r JOIN wf_versions v USING (workflow, version_hash) WHERE r.state = 'stuck_unknown_version'")
def stuck_recoverable(t):
    return versions.recoverable(t["runs"], t["versions"])


# -- tasks

_ABLE = f"""able AS (SELECT t.*, r.lease_token AS run_token FROM wf_tasks t JOIN wf_runs r ON r.id = t.run_id WHERE t.state = 'available' AND t.available_at <= {NOW} AND (t.lease_owner IS NULL OR t.lease_expires_at < {NOW})
    AND r.state IN {ACTIVE} AND r.lease_token IS NOT NULL AND r.lease_expires_at > {NOW})"""


@query(f"WITH {_ABLE} SELECT id, run_id, queue, priority, attempt, run_token, {age('scheduled_at')} AS queue_age_ms FROM able WHERE queue = 'q1' ORDER BY priority DESC, available_at, scheduled_at, id LIMIT 10")
def claim_tasks(t):
    return tasks.claim(t["tasks"], t["runs"], AS_OF, "q1")


@query(f"WITH {_ABLE} SELECT queue, max(priority) AS top_priority, min(available_at) AS oldest_available_at, count(*) AS tasks FROM able GROUP BY queue")
def queue_summary(t):
    return tasks.queue_summary(t["tasks"], t["runs"], AS_OF)


@query(f"""WITH {_ABLE}, q AS (SELECT queue, row_number() OVER (ORDER BY max(priority) DESC, min(available_at), queue) AS qr FROM able GROUP BY queue),
    n AS (SELECT able.*, row_number() OVER (PARTITION BY queue ORDER BY priority DESC, available_at, scheduled_at, id) AS place FROM able),
    u AS (SELECT queue, count(*) AS in_use FROM wf_tasks WHERE state = 'leased' GROUP BY queue)
    SELECT n.id, n.queue, n.place FROM n JOIN q USING (queue) LEFT JOIN u USING (queue) WHERE n.place <= greatest(0, 800 - coalesce(u.in_use, 0)) AND n.place <= 800 ORDER BY qr, place LIMIT 50""")
def claim_with_capacity(t):
    return tasks.claim_with_capacity(t["tasks"], t["runs"], AS_OF, slots=800, limit=50)


@query(f"SELECT queue, count(*) AS pending, coalesce(max({age('scheduled_at')}), 0) AS max_age_ms FROM wf_tasks WHERE state = 'available' AND available_at <= {NOW} GROUP BY queue")
def pending_queue_stats(t):
    return tasks.pending_stats(t["tasks"], AS_OF)


@query("SELECT queue, count(*) AS in_use FROM wf_tasks WHERE state = 'leased' GROUP BY queue")
def in_use_slots(t):
    return tasks.in_use(t["tasks"])


@query("SELECT coalesce(lineage_id, id) AS lineage, 'root' AS kind, id, scheduled_at AS at FROM wf_tasks")
def activity_lineage(t):
    return tasks.lineage(t["tasks"])


_CLAIMS = "claims AS (SELECT id, run_id, coalesce(lease_owner, 'worker-0') AS owner, CASE WHEN seq % 8 = 2 THEN attempt + 1 ELSE attempt END AS attempt FROM wf_tasks)"


def _claims(t):
    """Every task as some worker claimed it, an attempt too late now and then."""
    attempt = F.when(F.col("seq") % 8 == 2, F.col("attempt") + 1).otherwise(F.col("attempt"))
    return t["tasks"].select("id", "run_id", F.coalesce("lease_owner", F.lit("worker-0")).alias("owner"), attempt.alias("attempt"))


@query(f"""WITH {_CLAIMS} SELECT c.id, c.run_id, CASE WHEN t.id IS NULL THEN 'lease_lost' WHEN r.state IN {ACTIVE} AND r.id NOT LIKE '%4' THEN 'active' ELSE 'cancelled' END AS status
    FROM claims c LEFT JOIN wf_tasks t ON t.id = c.id AND t.state = 'leased' AND t.lease_owner = c.owner AND t.attempt = c.attempt LEFT JOIN wf_runs r ON r.id = c.run_id""")
def activity_context(t):
    asked = F.when(F.col("id").like("%4"), F.lit(AS_OF).cast("timestamp_ntz"))
    return tasks.context(t["tasks"], t["runs"].withColumn("cancel_requested_at", asked), _claims(t))


# -- transitions


@query(f"""WITH c AS (SELECT id, state, next_wakeup_at, started_at FROM wf_runs WHERE state IN {ACTIVE} AND (state = 'running' OR next_wakeup_at IS NULL OR next_wakeup_at <= {NOW}) AND (lease_owner IS NULL OR lease_expires_at < {NOW})
      ORDER BY next_wakeup_at NULLS FIRST, started_at, id LIMIT 20)
    SELECT id, state, 'node-x' AS lease_owner, (SELECT max(lease_token) FROM wf_runs) + row_number() OVER (ORDER BY next_wakeup_at NULLS FIRST, started_at, id) AS lease_token, {NOW} + INTERVAL '30' SECOND AS lease_expires_at FROM c""")
def claim_runs(t):
    return transitions.claim_runs(t["runs"], AS_OF, "node-x", limit=20)


@query(f"SELECT id, state AS old_state, 'suspended' AS state, lease_token FROM wf_runs WHERE state IN {ACTIVE} AND lease_owner IS NOT NULL AND lease_expires_at < {NOW}")
def recover_runs(t):
    return transitions.recover_runs(t["runs"], AS_OF)


@query(f"SELECT id, run_id, 'available' AS state, attempt + 1 AS attempt FROM wf_tasks WHERE state = 'leased' AND lease_expires_at < {NOW}")
def requeue_expired(t):
    return transitions.requeue_expired(t["tasks"], AS_OF)


@query(f"SELECT id, {NOW} AS next_wakeup_at FROM wf_runs WHERE state = 'suspended' AND (next_wakeup_at IS NULL OR next_wakeup_at > {NOW}) AND id IN (SELECT run_id FROM wf_timers WHERE NOT fired AND fires_at <= {NOW})")
def arm_runs(t):
    return transitions.arm_runs(t["timers"], t["runs"], AS_OF)


@query(f"SELECT t.id, t.run_id, t.fires_at, r.lease_token FROM wf_timers t JOIN wf_runs r ON r.id = t.run_id WHERE NOT t.fired AND t.fires_at <= {NOW} AND r.state = 'suspended' AND r.lease_owner IS NOT NULL AND r.lease_expires_at > {NOW} ORDER BY t.fires_at, t.id LIMIT 100")
def fire_timers(t):
    return transitions.fire_timers(t["timers"], t["runs"], AS_OF)


@query("""WITH w AS (SELECT *, lead(event_type) OVER (PARTITION BY run_id ORDER BY seq) AS nt, lead(seq) OVER (PARTITION BY run_id ORDER BY seq) AS ns FROM wf_events)
    SELECT run_id, seq, event_type, CASE WHEN ns IS NULL OR ns <> seq + 1 THEN 'pending' WHEN nt IN ('timer_fired','signal_received') THEN nt ELSE 'other' END AS winner FROM w WHERE event_type IN ('timer_started','signal_awaited')""")
def timer_winners(t):
    return transitions.timer_winners(t["events"])


def _awaits(t):
    name = F.element_at(F.array(F.lit("approval"), F.lit("payment"), F.lit("ship")), (F.col("seq") % 3 + 1).cast("int"))
    return t["events"].where("event_type = 'signal_awaited'").select("run_id", "seq", name.alias("name"), scalars.after(F.col("inserted_at"), 86_400_000 * 2000).alias("timeout_at"))


@query(f"""WITH a AS (SELECT run_id, seq, CASE seq % 3 WHEN 0 THEN 'approval' WHEN 1 THEN 'payment' ELSE 'ship' END AS name, inserted_at + INTERVAL '2000' DAY AS timeout_at FROM wf_events WHERE event_type = 'signal_awaited'),
    h AS (SELECT run_id, name, arg_min(id, (inserted_at, id)) AS signal_id FROM wf_signals WHERE NOT delivered GROUP BY 1, 2),
    w AS (SELECT a.*, n.event_type AS nt FROM a LEFT JOIN wf_events n ON n.run_id = a.run_id AND n.seq = a.seq + 1 AND n.event_type IN ('timer_fired','signal_received'))
    SELECT w.run_id, w.seq, w.name, h.signal_id, CASE WHEN nt IS NOT NULL THEN nt WHEN h.signal_id IS NOT NULL THEN 'signal' WHEN timeout_at <= {NOW} THEN 'timeout' ELSE 'pending' END AS winner FROM w LEFT JOIN h ON h.run_id = w.run_id AND h.name = w.name""")
def signal_race(t):
    return transitions.signal_race(_awaits(t), t["signals"], t["events"], AS_OF)


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY correlation_id, name, delivery_id ORDER BY inserted_at, id) AS k FROM wf_signals WHERE delivery_id IS NOT NULL AND NOT delivered)
    SELECT id, correlation_id, name, delivery_id FROM n WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM wf_signals e WHERE e.delivered AND e.correlation_id = n.correlation_id AND e.name = n.name AND e.delivery_id = n.delivery_id)
    UNION ALL SELECT id, correlation_id, name, delivery_id FROM wf_signals WHERE delivery_id IS NULL AND NOT delivered""")
def signal_dedupe(t):
    """What is delivered is there already; the rest arrives."""
    return history.insert_signals(t["signals"].where("delivered"), t["signals"].where("NOT delivered")).select("id", "correlation_id", "name", "delivery_id")


@query("""WITH r AS (SELECT queue AS activity_module, 'k' || CAST(CAST(split_part(id, '-', 1) AS BIGINT) % 500 AS VARCHAR) AS idempotency_key, available_at AS completed_at, run_id, seq FROM wf_tasks WHERE state = 'completed')
    SELECT activity_module, idempotency_key, completed_at, run_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY activity_module, idempotency_key ORDER BY completed_at, run_id, seq) AS n FROM r) WHERE n = 1""")
def idempotency_winner(t):
    key = F.concat(F.lit("k"), (F.split("id", "-")[0].cast("long") % 500).cast("string"))
    done = t["tasks"].where("state = 'completed'").select(F.col("queue").alias("activity_module"), key.alias("idempotency_key"), F.col("available_at").alias("completed_at"), "run_id", "seq")
    return history.first_results(done)


@query(f"""WITH led AS (SELECT id, next_wakeup_at FROM wf_runs WHERE state IN {ACTIVE} AND lease_owner IS NOT NULL AND lease_token IS NOT NULL AND lease_expires_at > {NOW}),
    e AS (SELECT s.run_id, s.inserted_at AS since FROM wf_signals s JOIN led ON led.id = s.run_id WHERE NOT s.delivered UNION ALL SELECT id, next_wakeup_at FROM led WHERE next_wakeup_at <= {NOW})
    SELECT run_id, min(since) AS evidence_at, {age('min(since)')} AS oldest_wake_age_ms FROM e GROUP BY run_id""")
def wake_evidence(t):
    return transitions.wake_evidence(t["runs"], t["signals"], AS_OF)


@query(f"SELECT id, workflow, version_hash, CASE WHEN version_hash = 'v0' THEN {NOW} + INTERVAL '30' DAY WHEN workflow = 'Flow.HIGH' THEN {NOW} + INTERVAL '1' DAY END AS retention_until FROM wf_runs WHERE state = 'running'")
def retention_stamp(t):
    known = t["versions"].withColumn("retention_ms", F.when(F.col("version_hash") == "v0", 30 * 86_400_000).when(F.col("workflow") == "Flow.HIGH", 86_400_000).cast("long"))
    return transitions.retention(t["runs"].where("state = 'running'").select("id", "workflow", "version_hash"), known, AS_OF).select("id", "workflow", "version_hash", "retention_until")


_CASCADE = _DOWN + f", hit AS (SELECT DISTINCT r.id, r.state FROM down d JOIN wf_runs r ON r.id = d.id WHERE r.state IN {NON_TERMINAL})"


def _cascade(t):
    return transitions.cancel_cascade(t["runs"], t["tasks"], t["timers"], _roots(t))


@query(_CASCADE + " SELECT id, state AS old_state, 'cancelled' AS state FROM hit")
def cancel_cascade(t):
    return transitions.cancelled_runs(t["runs"], _roots(t))[0]


@query(_CASCADE + " SELECT id, run_id, 'discarded' AS state FROM wf_tasks WHERE state IN ('available','leased') AND run_id IN (SELECT id FROM hit)")
def cancel_cascade_tasks(t):
    return _cascade(t)["tasks"]


@query(_CASCADE + " SELECT id, run_id, true AS fired FROM wf_timers WHERE NOT fired AND run_id IN (SELECT id FROM hit)")
def cancel_cascade_timers(t):
    return _cascade(t)["timers"]


def _continued(t):
    return transitions.continue_as_new(t["runs"], t["signals"], t["runs"].select("id"), AS_OF)


@query(f"SELECT id AS continued_from_run_id, workflow, version_hash, namespace, 'running' AS state, attributes, {NOW} AS started_at, parent_run_id, coalesce(correlation_id, id) AS correlation_id FROM wf_runs WHERE state IN {ACTIVE}")
def continue_as_new(t):
    return _continued(t)["created"].drop("id")


@query(f"SELECT s.id, s.run_id AS old_run_id FROM wf_signals s JOIN wf_runs r ON r.id = s.run_id WHERE NOT s.delivered AND r.state IN {ACTIVE}")
def continue_as_new_signals(t):
    moved, created = _continued(t)["moved"], _continued(t)["created"]
    return moved.join(created.select(F.col("id").alias("run_id"), F.col("continued_from_run_id").alias("old_run_id")), "run_id").select("id", "old_run_id")


@query(f"SELECT id, run_id, scheduled_at, state AS old_state, attempt + 1 AS attempt FROM wf_schedules WHERE scheduled_at <= {NOW} AND (state = 'scheduled' OR (state = 'starting' AND claimed_at < {NOW} - INTERVAL '30' SECOND)) ORDER BY scheduled_at, id LIMIT 50")
def claim_schedules(t):
    return transitions.claim_schedules(t["schedules"], AS_OF)


@query(f"""SELECT id, CASE WHEN CAST(run_id AS BIGINT) % 2 = 0 THEN 'started' WHEN attempt >= 12 THEN 'failed' ELSE 'scheduled' END AS state, attempt,
    CASE WHEN CAST(run_id AS BIGINT) % 2 = 0 OR attempt >= 12 THEN scheduled_at ELSE {NOW} + to_milliseconds(CAST(least(1000 * pow(2, attempt - 1), 60000) AS BIGINT)) END AS scheduled_at FROM wf_schedules""")
def schedule_outcomes(t):
    return transitions.schedule_outcomes(t["schedules"], t["schedules"].select("id", (F.col("run_id").cast("long") % 2 == 0).alias("ok")), AS_OF)


@query(f"""WITH w AS (SELECT id, CASE WHEN seq % 4 = 0 THEN 'other' ELSE run_id END AS run_id, coalesce(lease_owner, 'worker-0') AS lease_owner, CASE WHEN seq % 8 = 2 THEN attempt + 1 ELSE attempt END AS attempt FROM wf_tasks)
    SELECT w.*, CASE WHEN t.run_id <> w.run_id THEN 'run_mismatch' WHEN t.state <> 'leased' THEN 'not_leased' WHEN t.lease_owner IS DISTINCT FROM w.lease_owner THEN 'lease_mismatch' WHEN t.attempt <> w.attempt THEN 'attempt_mismatch'
      WHEN t.lease_expires_at IS NULL THEN 'missing_expiry' WHEN t.lease_expires_at < {NOW} THEN 'lease_expired' END AS reason FROM w JOIN wf_tasks t ON t.id = w.id""")
def task_lease_validation(t):
    run, attempt = F.when(F.col("seq") % 4 == 0, "other").otherwise(F.col("run_id")), F.when(F.col("seq") % 8 == 2, F.col("attempt") + 1).otherwise(F.col("attempt"))
    writes = t["tasks"].select("id", run.alias("run_id"), F.coalesce("lease_owner", F.lit("worker-0")).alias("lease_owner"), attempt.alias("attempt"))
    return transitions.task_lease_errors(t["tasks"], writes, AS_OF)


@query(f"""WITH {_CLAIMS}, e AS (SELECT w.id, w.run_id, CASE WHEN t.state <> 'leased' THEN 'not_leased' WHEN t.lease_owner IS DISTINCT FROM w.owner THEN 'lease_mismatch' WHEN t.attempt <> w.attempt THEN 'attempt_mismatch'
      WHEN t.lease_expires_at IS NULL THEN 'missing_expiry' WHEN t.lease_expires_at < {NOW} THEN 'lease_expired' END AS reason FROM claims w JOIN wf_tasks t ON t.id = w.id)
    SELECT id, run_id, reason, CASE WHEN reason IN ('lease_expired', 'missing_expiry') THEN 'requeue' ELSE 'drop' END AS action FROM e WHERE reason IS NOT NULL""")
def fenced_writes(t):
    return transitions.fenced_writes(transitions.task_lease_errors(t["tasks"], _claims(t).withColumnRenamed("owner", "lease_owner"), AS_OF)).select("id", "run_id", "reason", "action")


@query(f"""WITH tail AS (SELECT run_id, max(seq) AS seq, arg_max(event_type, seq) AS event_type FROM wf_events GROUP BY 1)
    SELECT t.id, CASE WHEN t.state NOT IN ('discarded','dead_lettered') THEN 'not_discarded' WHEN r.id IS NULL THEN 'run_not_found' WHEN r.state <> 'failed' THEN 'run_not_failed' WHEN r.parent_run_id IS NOT NULL THEN 'child_run_retry_not_supported'
      WHEN coalesce(l.seq <> t.seq + 1 OR l.event_type <> 'activity_failed', true) THEN 'failure_not_replay_tail' ELSE 'retried' END AS outcome, CASE WHEN outcome = 'retried' THEN t.seq + 2 END AS retry_seq
    FROM wf_tasks t LEFT JOIN wf_runs r ON r.id = t.run_id LEFT JOIN tail l ON l.run_id = t.run_id""")
def manual_retries(t):
    """A retry of every task is asked for."""
    asked = t["tasks"].select("id", F.lit("me").alias("operator"), F.lit("why").alias("reason"))
    own = t["tasks"].withColumn("parent_task_id", F.lit(None).cast("string"))
    snapshots = t["events"].select("run_id", F.col("seq").alias("through_seq"))
    out = transitions.manual_retry(t["runs"], own, t["events"], snapshots, asked, AS_OF)
    done = out["tasks"].select(F.col("parent_task_id").alias("id"), F.lit("retried").alias("outcome"), F.col("seq").alias("retry_seq"))
    return done.unionByName(out["refused"].select("id", F.col("refusal").alias("outcome"), F.lit(None).cast("long").alias("retry_seq")))


@query(f"""SELECT t.id, t.run_id, {NOW} AS last_heartbeat_at, {NOW} + INTERVAL '30' SECOND AS lease_expires_at FROM wf_tasks t JOIN wf_runs r ON r.id = t.run_id
    WHERE t.state = 'leased' AND t.lease_expires_at > {NOW} AND r.state IN {ACTIVE} AND r.lease_expires_at > {NOW}""")
def task_heartbeats(t):
    return transitions.heartbeat(t["tasks"], t["runs"], t["tasks"].select("id", F.col("lease_owner").alias("owner"), "attempt"), AS_OF)


@query(f"""WITH n AS (SELECT run_id, max(seq) + 1 AS n FROM wf_events GROUP BY 1), q AS (SELECT run_id, n AS seq, 'u1' AS command_id FROM n UNION ALL SELECT run_id, CASE WHEN run_id LIKE '%4' THEN n - 1 ELSE n + 1 END, 'u2' FROM n)
    SELECT q.run_id, seq, command_id FROM q JOIN wf_runs r ON r.id = q.run_id WHERE r.state IN {ACTIVE} AND (lease_token IS NOT NULL OR lease_owner IS NULL) AND r.id NOT LIKE '%4'""")
def compensation_batches(t):
    """Every run asks for two compensations under its own lease; those of some claim a number that is taken."""
    n = t["events"].groupBy("run_id").agg((F.max("seq") + 1).alias("n")).join(t["runs"].select(F.col("id").alias("run_id"), F.col("lease_token").alias("token")), "run_id", "left")
    two = n.select("*", F.explode(F.array(F.lit("u1"), F.lit("u2"))).alias("command_id"))
    seq = F.when(F.col("command_id") == "u1", F.col("n")).when(F.col("run_id").like("%4"), F.col("n") - 1).otherwise(F.col("n") + 1)
    none = {c: F.lit(None).cast("string") for c in ("payload", "lineage_id", "queue")} | {"priority": F.lit(None).cast("long")}
    asked = two.withColumns({"seq": seq, "task_id": F.concat("run_id", F.lit("/"), "command_id"), **none})
    return transitions.schedule_compensations(t["runs"], t["events"], t["tasks"], asked, AS_OF)["events"].select("run_id", "seq", "command_id")


@query(f"""WITH w AS (SELECT id, 'wake' AS action, CASE WHEN state = 'running' AND lease_token IS NOT NULL THEN 'repaired' WHEN state = 'suspended' AND lease_token IS NOT NULL THEN 'repaired' ELSE 'stale_or_inactive' END AS status FROM wf_runs),
    l AS (SELECT id, 'release_expired_lease', CASE WHEN state IN {ACTIVE} AND lease_token IS NOT NULL AND lease_owner IS NOT NULL AND lease_expires_at <= {NOW} THEN 'repaired' WHEN lease_owner IS NULL AND lease_token IS NULL THEN 'already_applied' ELSE 'stale_or_not_expired' END FROM wf_runs),
    q AS (SELECT id, 'requeue_activity', CASE WHEN state = 'leased' AND lease_owner IS NOT NULL AND seq % 8 <> 2 AND lease_expires_at <= {NOW} THEN 'repaired' ELSE 'stale_or_not_expired' END FROM wf_tasks)
    SELECT id AS subject_id, action, status FROM (SELECT * FROM w UNION ALL SELECT * FROM l UNION ALL SELECT * FROM q)""")
def repair_statuses(t):
    """Every run is to wake and to give up its lease, every task to be requeued, as their senders saw them."""
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    rest = none("finding_type", "fingerprint", "reviewed_by", "reason")
    run = t["runs"].select(F.explode(F.array(F.lit("wake"), F.lit("release_expired_lease"))).alias("action"), F.col("id").alias("subject_id"), "lease_owner", "lease_token", F.lit(None).cast("long").alias("attempt"), *rest)
    seen = F.when(F.col("seq") % 8 == 2, F.col("attempt") + 1).otherwise(F.col("attempt"))
    task = t["tasks"].select(F.lit("requeue_activity").alias("action"), F.col("id").alias("subject_id"), "lease_owner", F.lit(None).cast("long").alias("lease_token"), seen.alias("attempt"), *rest)
    return repairs.repair(t["runs"], t["tasks"], t["versions"], run.unionByName(task), AS_OF, dry_run=False)["status"].select("subject_id", "action", "status")


@query(f"""WITH able AS (SELECT t.id FROM wf_timers t JOIN wf_runs r ON r.id = t.run_id WHERE NOT t.fired AND t.fires_at <= {NOW} AND r.state = 'suspended' AND r.lease_owner IS NOT NULL AND r.lease_expires_at > {NOW} ORDER BY t.fires_at, t.id LIMIT 1000000)
    SELECT id, run_id, CASE WHEN (SELECT count(*) FROM able) < 1000000 THEN {NOW} + INTERVAL '60' SECOND ELSE {NOW} END AS retry_at FROM wf_timers WHERE NOT fired AND fires_at <= {NOW} AND id NOT IN (SELECT id FROM able)""")
def timer_retries(t):
    return signals.timer_retries(t["timers"], t["runs"], AS_OF, batch=1_000_000)


# -- folds


@query("SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) - 1 AS seq, event_type, command_id FROM wf_events")
def event_sequence(t):
    return history.sequenced(t["events"].withColumn("_r", -F.col("seq")), ["_r"]).select("run_id", "seq", "event_type", "command_id")


@query("SELECT r.id AS run_id, coalesce(max(e.seq) + 1, 0) AS next_seq FROM wf_runs r LEFT JOIN wf_events e ON e.run_id = r.id GROUP BY 1")
def next_sequence(t):
    return history.next_seq(t["events"], t["runs"])


@query("SELECT run_id, seq, event_type, command_id, inserted_at FROM wf_events WHERE run_id = (SELECT max(run_id) FROM wf_events WHERE seq > 6) AND seq > 1 ORDER BY seq LIMIT 4")
def event_page(t):
    last = t["events"].where("seq > 6").agg(F.max("run_id")).first()[0]
    return history.event_page(t["events"], last or "", 1, 3)


_OPEN = "('activity_scheduled','timer_started','signal_awaited','compensation_scheduled')"


@query(f"""WITH w AS (SELECT *, lead(event_type) OVER o AS nt, lead(seq) OVER o AS ns, lead(command_id) OVER o AS nc FROM wf_events WINDOW o AS (PARTITION BY run_id ORDER BY seq))
    SELECT run_id, seq, event_type, nt AS next_type, CASE WHEN ns IS NULL THEN 'pending' WHEN ns <> seq + 1 THEN 'gap' WHEN nc = command_id AND ((event_type = 'activity_scheduled' AND nt IN ('activity_completed','activity_failed'))
      OR (event_type = 'signal_awaited' AND nt IN ('signal_received','timer_fired')) OR (event_type = 'timer_started' AND nt = 'timer_fired')) THEN 'paired' ELSE 'mismatch' END AS outcome FROM w WHERE event_type IN {_OPEN}""")
def event_pairs(t):
    return folds.pairs(t["events"])


_STEPS = """p AS (SELECT a.run_id, a.seq, CASE a.event_type WHEN 'activity_scheduled' THEN 'activity' WHEN 'timer_started' THEN 'timer' ELSE 'await_signal' END AS effect_type, a.command_id, b.event_type AS result_type, CAST(2 AS BIGINT) AS advance_by
    FROM wf_events a JOIN wf_events b ON b.run_id = a.run_id AND b.seq = a.seq + 1 AND a.seq % 2 = 0)"""


@query(f"WITH {_STEPS} SELECT * FROM p")
def snapshot_steps(t):
    return folds.compacted(t["events"])


@query(f"WITH {_STEPS} SELECT run_id, max(seq) + 1 AS through_seq, count(*) AS step_count FROM p GROUP BY run_id HAVING sum(advance_by) >= 6")
def snapshot_trigger(t):
    return folds.snapshots(t["events"], threshold=6).select("run_id", "through_seq", "step_count")


@query(f"WITH {_STEPS} SELECT run_id, max(seq) + 1 AS through_seq, count(*) AS step_count FROM p GROUP BY run_id HAVING max(seq) >= 4")
def snapshot_extended(t):
    """Snapshots of the first four events are the base, and whole histories go on from there."""
    return folds.extended(folds.snapshots(t["events"].where("seq < 4")), t["events"]).select("run_id", "through_seq", "step_count")


@query(f"""WITH e AS (SELECT a.*, b.seq AS closed, b.event_type AS closer, (CAST(a.run_id AS BIGINT) + a.seq) % 11 = 0 AS changed FROM wf_events a LEFT JOIN wf_events b ON b.run_id = a.run_id AND b.seq = a.seq + 1 WHERE a.event_type IN {_OPEN})
    SELECT run_id, seq, CASE WHEN changed THEN 'mismatch' WHEN closed IS NULL THEN 'pending' ELSE 'ok' END AS verdict, CASE WHEN NOT changed THEN closer END AS result_type, CASE WHEN NOT changed AND closed IS NOT NULL THEN CAST(2 AS BIGINT) END AS advance_by FROM e""")
def replay_matches(t):
    """Every command as its program would give it, with the place it stands at, one in eleven changed."""
    effect = F.create_map(*[F.lit(x) for name, (_, e) in folds.PAIRS.items() for x in (name, e)])[F.col("event_type")]
    place = (F.col("seq") % 8).cast("string")
    asked = _expected(t).where(F.col("event_type").isin(*folds.PAIRS)).select("run_id", "seq", effect.alias("effect_type"), "command_id", F.create_map(F.lit("place"), place).alias("identity"))
    return folds.matched(asked, t["events"].withColumn("payload", F.to_json(F.struct(place.alias("place"))))).select("run_id", "seq", "verdict", "result_type", "advance_by")


@query(f"WITH {_STEPS}, u AS (SELECT run_id, sum(advance_by) AS n FROM p GROUP BY 1) SELECT e.run_id, count(*) AS events, CAST(coalesce(max(u.n), 0) AS BIGINT) AS consumed, count(*) = coalesce(max(u.n), 0) AS complete FROM wf_events e LEFT JOIN u ON u.run_id = e.run_id GROUP BY 1")
def history_consumption(t):
    return folds.consumption(t["events"])


@query(f"WITH l AS (SELECT run_id, max(seq) AS seq FROM wf_events GROUP BY 1) SELECT e.run_id, e.seq, e.event_type, CASE e.event_type WHEN 'activity_scheduled' THEN 'activity' WHEN 'timer_started' THEN 'timer' ELSE 'await_signal' END AS reason FROM l JOIN wf_events e ON e.run_id = l.run_id AND e.seq = l.seq WHERE e.event_type IN {_OPEN}")
def pending_effects(t):
    return folds.pending_effects(t["events"])


def _expected(t):
    """The history as it was commanded, with one command in eleven changed."""
    changed = F.when((F.col("run_id").cast("long") + F.col("seq")) % 11 == 0, "changed").otherwise(F.col("command_id"))
    return t["events"].select("run_id", "seq", "event_type", changed.alias("command_id"))


@query("SELECT run_id, min(seq) AS seq FROM wf_events WHERE (CAST(run_id AS BIGINT) + seq) % 11 = 0 GROUP BY run_id")
def drift_points(t):
    return folds.drift(_expected(t), t["events"])


@query(f"WITH c AS (SELECT run_id, seq, event_type || '@' || CAST(seq % 8 AS VARCHAR) AS base FROM wf_events WHERE event_type IN {_OPEN}) SELECT run_id, seq, base, row_number() OVER (PARTITION BY run_id, base ORDER BY seq) - 1 AS ordinal FROM c")
def command_ordinals(t):
    """As if each kind of command stood at four places of its program, in turn."""
    base = F.concat("event_type", F.lit("@"), (F.col("seq") % 8).cast("string"))
    return folds.command_ordinals(t["events"].where(F.col("event_type").isin(*folds.PAIRS)).select("run_id", "seq", base.alias("base")))


@query("""SELECT d.run_id, d.seq, row_number() OVER (PARTITION BY d.run_id ORDER BY d.seq DESC) - 1 AS place FROM wf_events d JOIN wf_events s ON s.run_id = d.run_id AND s.command_id = d.command_id AND s.event_type = 'activity_scheduled'
    WHERE d.event_type = 'activity_completed' AND s.seq % 4 = 0 AND (CAST(d.run_id AS BIGINT) + d.seq) % 5 <> 1""")
def compensation_lifo(t):
    """Every other activity has a compensation, and a fifth of them were compensated."""
    able = F.when((F.col("event_type") == "activity_scheduled") & (F.col("seq") % 4 == 0), '{"compensate":"undo"}')
    done = t["events"].where("event_type = 'activity_completed' AND (CAST(run_id AS BIGINT) + seq) % 5 = 1")
    undone = done.select("run_id", (F.col("seq") + 1000).alias("seq"), F.lit("compensation_completed").alias("event_type"), F.concat(F.lit("undo-"), "command_id").alias("command_id"), "inserted_at", F.to_json(F.struct(F.col("command_id").alias("target_activity_id"))).alias("payload"))
    return folds.compensation_order(t["events"].withColumn("payload", able).unionByName(undone))


@query("SELECT run_id, max(seq) AS seq FROM wf_events s WHERE event_type = 'timer_started' AND NOT EXISTS (SELECT 1 FROM wf_events f WHERE f.run_id = s.run_id AND f.event_type = 'timer_fired' AND f.command_id = s.command_id) GROUP BY run_id")
def latest_pending_timer(t):
    return folds.latest_pending_timer(t["events"])


@query("WITH s AS (SELECT run_id, max(seq) AS through_seq FROM wf_events WHERE seq % 4 = 3 GROUP BY 1) SELECT e.run_id, e.seq, s.through_seq FROM wf_events e LEFT JOIN s ON s.run_id = e.run_id WHERE e.seq > coalesce(s.through_seq, -1)")
def snapshot_tail(t):
    made = t["events"].where("seq % 4 = 3").groupBy("run_id").agg(F.max("seq").alias("through_seq"))
    made = made.select("run_id", "through_seq", F.lit(1).cast("long").alias("format_version"), F.lit("v").alias("version_hash"), F.lit("[]").alias("steps"))
    return history.snapshot_and_tail(t["events"], made).select("run_id", "seq", "through_seq")


@query("SELECT event_type, CASE WHEN event_type LIKE 'activity%' THEN 'activity' WHEN event_type LIKE 'timer%' THEN 'timer' ELSE 'signal' END AS kind, count(*) AS events FROM wf_events GROUP BY 1, 2")
def event_kinds(t):
    return history.timeline(t["events"]).groupBy("event_type", "kind").agg(F.count(F.lit(1)).alias("events"))
