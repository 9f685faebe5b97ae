"""Repairs, batches of compensations, schedules, replay matches, snapshots on a base, timers that wait, missed wakes, task leases."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tests.test_rules import NOW, T, events, one, runs
from tests.test_streams import arriving, drained
from tideline.operators import folds, history, repairs, retention, transitions
from tideline.operators import tasks as queue
from tideline.sources.schemas import TABLES
from tideline.streaming import signals


def tasks(spark, *rows):
    names = [c.split()[0] for c in TABLES["tasks"].split(",")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], TABLES["tasks"])


def asked(spark, *rows):
    names = [c.split()[0] for c in repairs.REQUEST.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], repairs.REQUEST)


def test_repairs_are_fenced_planned_first_and_may_come_again(spark):
    led = {"lease_owner": "o", "lease_token": 7}
    r = runs(spark, {"id": "a", "lease_expires_at": T(9), **led}, {"id": "b", "lease_expires_at": T(11), **led}, {"id": "c", "state": "completed", **led}, {"id": "free"})
    t = tasks(spark, {"id": "t", "state": "leased", "lease_owner": "o", "attempt": 1, "lease_expires_at": T(9)}, {"id": "u", "state": "available", "attempt": 2}, {"id": "v", "state": "leased", "lease_owner": "o", "attempt": 1, "lease_expires_at": T(11)})
    v = spark.createDataFrame([("W", "v1", "e"), ("gone", "v1", None)], TABLES["versions"])
    rel, wake, req = (lambda action: lambda i, **k: {"action": action, "subject_id": i, **k})("release_expired_lease"), lambda i, n: {"action": "wake", "subject_id": i, "lease_token": n}, lambda i: {"action": "requeue_activity", "subject_id": i, "lease_owner": "o", "attempt": 1}
    q = asked(
        spark, wake("a", 7), rel("a", **led), rel("a", **led), wake("b", 8), rel("b", **led), wake("c", 7), rel("free", **led), rel("none", **led), req("t"), req("u"), req("v"),
        {"action": "retry", "subject_id": "W"}, {"action": "retry", "subject_id": "gone"}, {"action": "mark_reviewed", "subject_id": "s", "finding_type": "f", "fingerprint": "p"}, {"action": "dance"}, {"action": None},
    )
    got = repairs.repair(r, t, v, q, NOW, dry_run=False)
    stale = "stale_or_not_expired"
    assert one(got["status"], "action", "subject_id", "status") == sorted([
        ("wake", "a", "repaired"), ("release_expired_lease", "a", "repaired"), ("release_expired_lease", "a", "repaired"), ("wake", "b", "stale_or_inactive"), ("release_expired_lease", "b", stale), ("wake", "c", "stale_or_inactive"),
        ("release_expired_lease", "free", "already_applied"), ("release_expired_lease", "none", stale), ("requeue_activity", "t", "repaired"), ("requeue_activity", "u", "already_applied"), ("requeue_activity", "v", stale),
        ("retry", "W", "repaired"), ("retry", "gone", "workflow_not_loaded"), ("mark_reviewed", "s", "repaired"), ("dance", None, "unknown_action"), (None, None, "unknown_action"),
    ], key=str)
    assert one(got["runs"], "id", "state", "lease_owner", "lease_token", "lease_expires_at", "next_wakeup_at") == [("a", "suspended", None, None, None, T(10))]
    assert one(got["tasks"], "id", "state", "attempt", "lease_owner", "available_at") == [("t", "available", 2, None, T(10))]
    assert one(got["reviews"], "finding_type", "subject_id", "fingerprint", "reviewed_at") == [("f", "s", "p", T(10))] and one(got["versions"], "workflow", "version_hash") == [("W", "v1")]
    plan = repairs.repair(r, t, v, q, NOW)
    assert all(plan[k].count() == 0 for k in ("runs", "tasks", "reviews", "versions"))
    assert {s for _, s in one(plan["status"], "action", "status")} == {"planned", "stale_or_inactive", stale, "workflow_not_loaded", "unknown_action"}
    # what was repaired comes again
    r2 = history.upsert(r.select(*got["runs"].columns), got["runs"], ["id"])
    t2 = history.upsert(t.select(*got["tasks"].columns), got["tasks"], ["id"])
    again = repairs.repair(r2, t2, v, asked(spark, rel("a", **led), req("t")), NOW, dry_run=False)
    assert {s for (s,) in one(again["status"], "status")} == {"already_applied"}


def test_a_batch_of_compensations_is_taken_whole_or_not_at_all(spark):
    r = runs(spark, *({"id": i, "lease_owner": "o", "lease_token": 1} for i in "abcde"), {"id": "f", "state": "failed", "lease_owner": "o", "lease_token": 1})
    e = events(spark, [("activity_scheduled",), ("activity_completed",)], "b")
    t = tasks(spark, {"id": "old", "run_id": "c", "state": "completed"})
    schema = "run_id string, token bigint, seq bigint, command_id string, payload string, task_id string, lineage_id string, queue string, priority bigint"
    row = lambda run, seq, task, token=1: (run, token, seq, f"c{task}", None, task, None, None, None)
    q = spark.createDataFrame([row("a", 2, "1"), row("a", 3, "2"), row("b", 1, "3"), row("b", 2, "4"), row("c", 0, "old"), row("d", 0, "5", 2), row("e", 0, "6"), row("e", 0, "7"), row("f", 0, "8"), row("none", 0, "9")], schema)
    got = transitions.schedule_compensations(r, e, t, q, NOW)
    assert one(got["events"], "run_id", "seq", "event_type", "command_id") == [("a", 2, "compensation_scheduled", "c1"), ("a", 3, "compensation_scheduled", "c2")]
    assert one(got["tasks"], "id", "run_id", "lineage_id", "queue", "priority", "state") == [("1", "a", "1", "default", 0, "available"), ("2", "a", "2", "default", 0, "available")]
    assert one(got["refused"], "run_id", "reason") == [("b", "seq_taken"), ("c", "task_exists"), ("d", "lease_lost"), ("e", "seq_taken"), ("f", "lease_lost"), ("none", "lease_lost")]


def test_schedules_are_created_once(spark):
    have = spark.createDataFrame([("s", "r", "W", "v", "n", T(1), "started", 3, None)], TABLES["schedules"])
    new = spark.createDataFrame([("s", "x", "W", "v", None, T(2)), ("n", "x", "W", "v", None, T(2)), ("n", "x", "W", "v", None, T(2))], "id string, run_id string, workflow string, version_hash string, namespace string, scheduled_at timestamp_ntz")
    assert one(transitions.create_schedules(have, new), "id", "namespace", "state", "attempt") == [("n", "default", "scheduled", 0)]


def test_replay_matches_whole_steps(spark):
    rows = [
        (0, "activity_scheduled", "a", None), (1, "activity_failed", "a", None), (2, "activity_retry_scheduled", "a", None), (3, "activity_completed", "a", None), (4, "side_effect", None, '{"kind":"now"}'),
        (5, "timer_started", "t", '{"timer_id":"x"}'), (6, "timer_fired", "other", None), (7, "child_started", "k", '{"workflow":"W","input_hash":"h"}'), (8, "signal_awaited", "s", '{"name":"n"}'),
    ]
    history_ = spark.createDataFrame([("r", s, e, c, p, T(1)) for s, e, c, p in rows], TABLES["events"])
    want = [(0, "activity", "a", None), (3, "activity", "a", None), (4, "side_effect", "any", {"kind": "now"}), (4, "side_effect", "any", {"kind": "uuid"}), (5, "timer", "t", None), (7, "start_child", "k", {"workflow": "W", "input_hash": "h"}),
            (7, "start_child", "k", {"workflow": "W", "input_hash": "i"}), (7, "timer", "k", {}), (8, "await_signal", "s", {"name": "n"}), (8, "await_signal", "z", {"name": "n"}), (9, "timer", "t", None)]
    q = spark.createDataFrame([("r", *w) for w in want], "run_id string, seq bigint, effect_type string, command_id string, identity map<string,string>")
    got = one(folds.matched(q, history_), "seq", "effect_type", "command_id", "verdict", "result_type", "advance_by")
    ok = lambda s, e, c, r, n: (s, e, c, "ok", r, n)
    bad = lambda s, e, c, v="mismatch": (s, e, c, v, None, None)
    assert got == sorted([
        ok(0, "activity", "a", "activity_completed", 4), bad(3, "activity", "a"), ok(4, "side_effect", "any", "side_effect", 1), bad(4, "side_effect", "any"), bad(5, "timer", "t"), ok(7, "start_child", "k", "child_started", 1),
        bad(7, "start_child", "k"), bad(7, "timer", "k"), bad(8, "await_signal", "s", "pending"), bad(8, "await_signal", "z"), bad(9, "timer", "t", "pending"),
    ], key=str)


def test_snapshots_go_on_from_their_base(spark):
    pair = [("activity_scheduled",), ("activity_completed",)]
    whole = events(spark, pair + [("side_effect",)] + pair + [("timer_started",)]).unionByName(events(spark, pair, "done")).unionByName(events(spark, pair, "new"))
    base = folds.snapshots(whole.where("seq < 3 AND run_id != 'new'"))
    got = folds.extended(base, whole)
    assert one(got, "run_id", "through_seq", "step_count") == [("new", 1, 1), ("r", 4, 3)]
    steps = {r["run_id"]: r["steps"] for r in got.collect()}
    assert json.loads(steps["r"]) == json.loads(folds.snapshots(whole).where("run_id = 'r'").first()["steps"])


def test_timers_that_nobody_can_claim_wait_for_the_refresh(spark):
    r = runs(spark, {"id": "led", "state": "suspended", "lease_owner": "o", "lease_token": 1, "lease_expires_at": T(11)}, {"id": "free", "state": "suspended"})
    timers = spark.createDataFrame([("1", "led", T(2), False), ("2", "led", T(3), False), ("3", "free", T(4), False), ("4", "free", T(12), False), ("5", "free", T(4), True)], TABLES["timers"])
    assert one(signals.timer_retries(timers, r, NOW), "id", "retry_at") == [("3", T(10) + timedelta(minutes=1))]
    assert one(signals.timer_retries(timers, r, NOW, batch=1), "id", "retry_at") == [("2", T(10)), ("3", T(10))]
    assert signals.timer_retries(timers.limit(0), r, NOW).count() == 0


def test_missed_wakes_are_caught_up_a_batch_at_a_time(spark, tmp_path):
    led = {"lease_owner": "o", "lease_token": 1, "lease_expires_at": T(11)}
    r = runs(spark, {"id": "late", "next_wakeup_at": T(9), **led}, {"id": "sig", **led}, {"id": "idle", **led}, {"id": "other", "next_wakeup_at": T(9), **led})
    s = spark.createDataFrame([("1", "sig", None, "n", None, None, False, T(8))], TABLES["signals"])
    found, totals = signals.catch_up(spark.createDataFrame([("late",), ("sig",), ("sig",), ("idle",)], "id string"), r, s, NOW, page=2)
    assert one(found, "run_id") == [("late",), ("sig",)] and one(totals, "scanned", "pages", "matched", "oldest_wake_age_ms") == [(3, 2, 2, 2 * 86_400_000)]
    seen = []
    ids = arriving(spark, tmp_path, [[("late",), ("idle",)], [("sig",)]], "id string")
    tables = {"runs": r, "signals": s}
    stream = signals.catching_up(ids, tables.__getitem__, lambda: NOW, lambda f, t: seen.append((one(f, "run_id"), t.first()["scanned"])))
    stream.option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(seen) == [([("late",)], 2), ([("sig",)], 1)]


def test_a_miss_ends_a_task_lease_and_an_error_does_not(spark, tmp_path):
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    batches = [[("a", at(0), "ok"), ("a", at(10), "error"), ("b", at(0), "ok"), ("b", at(5), "miss"), ("b", at(6), "ok")], [("a", at(13), "ok"), ("b", at(14), "ok")], [("z", at(100), "ok")], [("z", at(110), "ok")]]
    stream = arriving(spark, tmp_path, batches, "task_id string, at timestamp, result string").withWatermark("at", "1 second")
    got = [(r["task_id"], r["status"], r["at"]) for r in drained(signals.task_leases(stream), tmp_path, "task_leases")]
    assert sorted(x[:2] for x in got if x[0] == "b") == [("b", "held"), ("b", "lost")]
    assert [x[1:] for x in sorted((x for x in got if x[0] == "a"), key=lambda x: x[2])] == [("held", at(0)), ("retry", at(10)), ("held", at(13)), ("expired", at(43))]


def test_orders_for_display(spark):
    rows = spark.createDataFrame([("l", "retry", "b", T(1)), ("l", "root", "a", T(2)), ("l", "attempt", "c", T(1)), ("k", "root", "d", T(3))], "lineage string, kind string, id string, at timestamp_ntz")
    assert [r["id"] for r in queue.in_lineage_order(rows).collect()] == ["d", "a", "b", "c"]
    runs_ = spark.createDataFrame([("a", "y", T(1)), ("b", "x", T(2)), ("c", "x", T(1)), ("d", "x", T(1))], "id string, correlation_id string, completed_at timestamp_ntz")
    assert [r["id"] for r in retention.in_archive_order(runs_).collect()] == ["c", "d", "b", "a"]


def test_nothing_to_repair_or_schedule(spark):
    r, t = runs(spark, {"id": "a"}), tasks(spark, {"id": "t"})
    out = repairs.repair(r.limit(0), t.limit(0), spark.createDataFrame([], TABLES["versions"]), asked(spark).where(F.lit(True)), NOW, dry_run=False)
    assert all(x.count() == 0 for x in out.values())
