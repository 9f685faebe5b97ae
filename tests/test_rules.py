"""Rules that the derived tables do not cover, on literal frames."""

import json
import random
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline.functions import contracts, jsonx, scalars
from tideline.operators import folds, graph, health, history, retention, tasks, transitions, versions
from tideline.operators.query import ALL_NAMESPACES, QueryError, RunQuery, decode_cursor, encode_cursor, get_run, set_attributes
from tideline.sources import store
from tideline.sources.schemas import TABLES

NOW = "2024-01-10 00:00:00"
T = lambda day, hour=0: datetime(2024, 1, day, hour)


def runs(spark, *rows):
    names = [c.split()[0] for c in TABLES["runs"].split(",")]
    full = [tuple({"workflow": "W", "version_hash": "v1", "namespace": "default", "state": "running", "started_at": T(1)} .get(n) if n not in r else r[n] for n in names) for r in rows]
    return spark.createDataFrame(full, TABLES["runs"])


def events(spark, history_, run="r"):
    rows = [(run, k, e[0], e[1] if len(e) > 1 else "c", None, T(1)) for k, e in enumerate(history_)]
    return spark.createDataFrame(rows, TABLES["events"])


def one(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


# -- structured query


def test_conditions_are_checked_before_anything_runs():
    for where in ([("eq", "nope", 1)], [("like", "state", "x")], [("eq", "state")], [("lt", ("attributes", "a"), 1)], [("eq", ("input", "a"), 1)]):
        with pytest.raises(QueryError):
            RunQuery(where=where).conditions()


def test_state_and_namespace(spark):
    df = runs(spark, {"id": "a", "state": "running"}, {"id": "b", "state": "failed", "namespace": "x"}, {"id": "c", "state": "completed", "namespace": None})
    ids = lambda **k: one(RunQuery(**k).filtered(df), "id")
    assert ids() == [("a",)] and ids(namespace=ALL_NAMESPACES) == [("a",), ("b",), ("c",)]
    assert ids(where=[("eq", "state", "RUNNING")]) == [("a",)] and ids(where=[("neq", "state", "RUNNING")]) == [("a",)]
    assert ids(where=[("eq", "state", "")]) == ids(where=[("eq", "state", None)]) == [("a",)]
    assert one(get_run(df, "b"), "id") == [("b",)] and one(get_run(df, "b", "default"), "id") == [] and one(get_run(df, "c", "default"), "id") == [("c",)]


@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_pages_reach_every_row_once(spark, direction):
    df = runs(spark, *({"id": f"r{k}", "completed_at": T(1 + k % 3) if k % 4 else None} for k in range(11)))
    seen, cursor = [], None
    while True:
        page = RunQuery(order_by=(direction, "completed_at"), per_page=3, cursor=cursor).page(df)
        seen += [r["id"] for r in page.entries.collect()]
        cursor = page.next_cursor
        if cursor is None:
            break
    assert sorted(seen) == sorted(f"r{k}" for k in range(11)) and len(set(seen)) == 11
    assert set(seen[-3:]) == {"r0", "r4", "r8"}  # without a time: last either way


def test_order_page_size_and_cursor_fall_backs():
    assert RunQuery(order_by="x").order_by == ("desc", "started_at") == RunQuery(order_by=("up", "id")).order_by
    assert RunQuery(per_page=0).per_page == 25 and RunQuery(per_page="9").per_page == 25 and RunQuery(per_page=1000).per_page == 100
    cursor = encode_cursor("asc", "completed_at", None, "r1")
    assert decode_cursor(cursor, "asc", "completed_at") == (None, "r1")
    for bad in ("%%", "a" * 2000, cursor[:-4], encode_cursor("desc", "completed_at", None, "r1")):
        with pytest.raises(QueryError):
            decode_cursor(bad, "asc", "completed_at")


def test_projection(spark):
    df = runs(spark, {"id": "a", "state": "failed", "error": '"cancelled"', "input": "x" * 50, "namespace": None})
    row = RunQuery(payload_cap=16).project(df).first()
    assert (row["state"], row["attributes"], row["namespace"]) == ("cancelled", "{}", "default")
    assert json.loads(row["input"]) == {"omitted": True, "encoded_bytes": 50}
    assert RunQuery(include_payloads=False).project(df).first()["input"] is None
    assert RunQuery(redact=lambda c: F.regexp_replace(c, "x", "*")).project(df).first()["input"] == "*" * 50


# -- JSON

DOCS = ['{"a":4,"b":"4","t":["y","x"],"o":{"p":{"q":1}},"n":null,"f":4.0,"z":true}', '{"t":[["x"]]}', "{}", None, "not json"]


@pytest.mark.parametrize(
    "keys,value,want",
    [(["a"], 4, 1), (["a"], 4.0, 1), (["f"], 4, 1), (["a"], "4", 0), (["b"], "4", 1), (["t"], ["x"], 1), (["t"], ["x", "x"], 1), (["o"], {}, 1), (["o"], {"p": {"q": 1}}, 1),
     (["o", "p", "q"], 1, 1), (["n"], None, 1), (["z"], True, 1), (["a"], True, 0), (["missing"], None, 0), (["t", "0"], "y", 0)],
)
def test_containment(spark, keys, value, want):
    df = spark.createDataFrame([(d,) for d in DOCS[:4]], "d string")
    assert df.where(jsonx.json_contains("d", keys, value)).count() == want


def test_presence_and_merge(spark):
    df = spark.createDataFrame([(DOCS[0],)], "d string")
    got = df.select(*(jsonx.json_present("d", k).alias(f"p{i}") for i, k in enumerate([["n"], ["a"], ["x"], ["t", "0"], ["t", "7"]]))).first()
    assert list(got) == [True, True, False, True, False]
    merged = spark.createDataFrame([('{"a":1,"o":{"x":1}}', '{"o":{"y":2},"b":"s"}'), (None, '{"b":1}')], "l string, r string").select(jsonx.json_merge("l", "r").alias("m")).collect()
    assert [json.loads(r["m"]) for r in merged] == [{"a": 1, "o": {"y": 2}, "b": "s"}, {"b": 1}]
    changed = set_attributes(runs(spark, {"id": "a", "attributes": '{"x":1}'}, {"id": "b"}), "a", {"y": 2})
    assert {r["id"]: r["attributes"] for r in changed.collect()} == {"a": '{"x":1,"y":2}', "b": None}


# -- scalars


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.base64url(F.lit(b"\xfb\xff\xfe").cast("binary")).alias("b64"), scalars.age_ms(F.lit("2024-01-11").cast("timestamp_ntz"), NOW).alias("future"),
        scalars.age_ms(F.lit(None).cast("timestamp_ntz"), NOW).alias("none"), scalars.prefix_bytes(F.lit("aé漢x"), 5).alias("cut"), scalars.partition_name(F.lit(NOW).cast("timestamp_ntz")).alias("part"),
        scalars.backoff_ms(F.lit(4)).alias("w4"), scalars.backoff_ms(F.lit(400)).alias("w400"), scalars.retry_horizon_ms(F.lit(4), 100, 1000, 3000).alias("h"), scalars.retry_horizon_ms(F.lit(1), 100).alias("h1"),
        scalars.split_notification(F.lit("r1|2024|x")).alias("n"), scalars.derived_id(F.lit("a")).alias("u"), scalars.public_error(F.lit('{"error":"e","stacktrace":"s"}')).alias("e"),
        scalars.month_label(scalars.month_start(F.lit(NOW).cast("timestamp_ntz"), -1)).alias("m"), scalars.base16(F.lit(b"\xab").cast("binary")).alias("b16"),
    ).first()
    assert (row["b64"], row["future"], row["none"], row["cut"], row["part"]) == ("-__-", 0, None, "aé", "events_y2024_m01")
    assert (row["w4"], row["w400"], row["h"], row["h1"], tuple(row["n"]), row["m"], row["b16"]) == (8000, 60000, 400 + 1000 + 2000 + 3000, 100, ("r1", "2024|x"), "2023-12", "ab")
    assert row["u"][14] == "5" and len(row["u"]) == 36 and row["u"][19] in "89ab" and tuple(row["e"]) == ("e", "s")
    long = spark.createDataFrame([("é" * 3000, ["f"] * 30), ("x", ["y" * 5000])], "t string, s array<string>").select(scalars.bounded_text("t").alias("t"), scalars.bounded_frames("s").alias("s")).collect()
    assert long[0]["t"] == "é" * 2048 + "..." and len(long[0]["s"]) == 20 and long[1]["t"] == "x" and long[1]["s"] == ["y" * 4096 + "..."]
    exact = spark.createDataFrame([('{"n":4.00000000001}',), ('{"n":4}',), ('{"n":4.0}',), ('{"n":9007199254740993}',)], "d string")
    assert exact.where(jsonx.json_contains("d", ["n"], 4)).count() == 2 and exact.where(jsonx.json_contains("d", ["n"], 9007199254740992)).count() == 0
    assert scalars.days_of("30d") == 30 and scalars.duration_ms(2, "hours") == 7_200_000
    with pytest.raises(ValueError):
        scalars.days_of("30h")


def test_contracts(spark):
    df = spark.createDataFrame([("1",), ("1.5",), ('"s"',), ("true",), ("null",), ("[1]",), ('{"a":1}',), ("oops",), (None,)], "p string")
    count = lambda kind: df.where(contracts.payload_is("p", kind)).count()
    assert [count(k) for k in ("any", "integer", "number", "string", "boolean", "null", "list", "object")] == [7, 1, 2, 1, 1, 1, 1, 1]
    assert contracts.ActivityPolicy(max_attempts=3, timeout_ms=10, base_ms=100).horizon_ms() == 330
    for bad in ({"max_attempts": 0}, {"backoff": "random"}, {"jitter_ms": -1}, {"max_retry_horizon_ms": 10}):
        with pytest.raises(ValueError):
            contracts.ActivityPolicy(**bad)
    assert folds.durable({"a": [1, {"b": object()}]}) == ("$.a[1].b", "object") and folds.durable({"a": [1, "x", None]}) is None


# -- boundaries and health


def test_expiry_boundaries_differ(spark):
    df = runs(spark, {"id": "a", "lease_owner": "n", "lease_token": 1, "lease_expires_at": T(10)})
    assert health.leases(df, NOW).first()["expired"] and transitions.recover_runs(df, NOW).count() == 0
    assert transitions.claim_runs(df, NOW, "x").count() == 0 and transitions.claim_runs(df, "2024-01-10 00:00:01", "x").first()["lease_token"] == 2


def test_claim_order_takes_runs_without_a_time_first(spark):
    df = runs(spark, {"id": "a", "next_wakeup_at": T(1)}, {"id": "b"}, {"id": "c", "state": "suspended", "next_wakeup_at": T(20)}, {"id": "d", "state": "running", "next_wakeup_at": T(20)})
    assert [r["id"] for r in transitions.claim_runs(df, NOW, "x", limit=2).orderBy("lease_token").collect()] == ["b", "a"]
    assert {r["id"] for r in transitions.claim_runs(df, NOW, "x", local=spark.createDataFrame([("b",)], "id string")).collect()} == {"a", "d"}


def test_reviews_and_order(spark):
    found = spark.createDataFrame([("lost_wake", f"r{k}", f"f{k}", T(k + 1)) for k in range(4)], "finding_type string, subject_id string, fingerprint string, since timestamp_ntz")
    seen = spark.createDataFrame([("lost_wake", "r0", "f0", T(1)), ("lost_wake", "r1", "old", T(1))], TABLES["reviews"])
    marked = health.reviewed(found, seen)
    assert [r["subject_id"] for r in health.worst_first(marked, 3).collect()] == ["r1", "r2", "r3"]
    assert one(health.status(marked), "findings", "reviewed", "degraded", "degraded_overall") == [(4, 1, True, True)]
    held = spark.createDataFrame([("a", False, False), ("b", True, True), ("c", True, False)], "id string, expired boolean, reviewed boolean").withColumn("lease_expires_at", F.lit(1))
    assert [r["id"] for r in health.leases_first(held).collect()] == ["c", "a", "b"]
    req = spark.createDataFrame([("wake", "lost_wake", "r0", "f0"), ("wake", "lost_wake", "r1", "x"), ("wake", "lost_wake", "r9", "f")], "action string, finding_type string, subject_id string, fingerprint string")
    assert one(transitions.repairs(found, req, dry_run=False), "subject_id", "status") == [("r0", "repaired"), ("r1", "stale"), ("r9", "already_resolved")]


# -- graph and retention


def test_tip_prefers_rooted_then_deep_then_large(spark):
    df = runs(spark, {"id": "a"}, {"id": "b", "continued_from_run_id": "a"}, {"id": "c", "continued_from_run_id": "b"}, {"id": "z", "correlation_id": "gone"}, {"id": "y", "correlation_id": "gone"})
    assert one(graph.tip_of(df, "a"), "id") == [("c",)] and one(graph.tip_of(df, "gone"), "id") == [("z",)] and one(graph.tip_of(df, "nope"), "id") == []
    assert one(graph.guarded_tip(df, "a", "default"), "id") == [("c",)] and graph.guarded_tip(df, "a", "other").count() == 0


def test_chains_of_hundreds_are_followed_to_their_ends(spark):
    name = lambda k: f"r{k:03}"
    chain = [{"id": name(k), "continued_from_run_id": name(k - 1) if k else None, "parent_run_id": "p", "state": "running" if k == 300 else "completed"} for k in range(301)]
    df = runs(spark, {"id": "p"}, *chain, {"id": "s"}, {"id": "t", "continued_from_run_id": "s"})
    want = [("p", "p", 0), ("s", "t", 1), ("t", "t", 0), *((name(k), name(300), 300 - k) for k in range(301))]
    assert one(graph.chain_tips(df), "id", "tip_id", "depth") == sorted(want, key=str)
    assert one(graph.children_outcomes(df), "child_run_id", "tip_id", "outcome") == [(name(0), name(300), "pending")]
    assert one(graph.tip_of(df, name(0)), "id") == [(name(300),)]
    new = spark.createDataFrame([("s1", name(0), None, "n", "d", None, False, T(1))], TABLES["signals"])
    added, outcome = transitions.deliver(df, new.limit(0), new)
    assert one(added, "id", "run_id") == [("s1", name(300))] and one(outcome, "outcome") == [("delivered",)]


def test_branches_lead_to_their_deepest_tip(spark):
    link = {"b": "a", "c": "b", "z": "a", "p": "c", "q": "c", "x": "q", "y": "p", "w": "z", "l": "k", "m": "k"}
    df = runs(spark, {"id": "a"}, {"id": "k"}, *({"id": i, "continued_from_run_id": f} for i, f in link.items()))
    want = {"a": ("y", 4), "b": ("y", 3), "c": ("y", 2), "p": ("y", 1), "q": ("x", 1), "x": ("x", 0), "y": ("y", 0), "z": ("w", 1), "w": ("w", 0), "k": ("m", 1), "l": ("l", 0), "m": ("m", 0)}
    assert {r["id"]: (r["tip_id"], r["depth"]) for r in graph.chain_tips(df).collect()} == want
    assert one(graph.tip_of(df, "a"), "id") == [("y",)]
    deep = runs(spark, *({"id": f"d{k:02}", "parent_run_id": f"d{k - 1:02}" if k else None} for k in range(40)))
    assert max(r["depth"] for r in graph.ancestor_depth(deep).collect()) == 39


def test_continuations_in_a_circle_are_an_error(spark):
    with pytest.raises(ValueError):
        graph.chain_tips(runs(spark, {"id": "a", "continued_from_run_id": "c"}, {"id": "b", "continued_from_run_id": "a"}, {"id": "c", "continued_from_run_id": "b"}, {"id": "d"}))


def test_deep_trees_are_reported_as_cut(spark):
    df = runs(spark, {"id": "r0"}, *({"id": f"r{k}", "parent_run_id": f"r{k - 1}"} for k in range(1, 6)))
    roots = spark.createDataFrame([("r0",)], "id string")
    found, cut = graph.descendants(df, roots, 3)
    assert one(found, "id", "depth") == [("r1", 1), ("r2", 2), ("r3", 3)] and one(cut, "root_id") == [("r0",)]
    request = spark.createDataFrame([("r5", "c", "W", "v1")], "parent_run_id string, command_id string, workflow string, version_hash string")
    assert transitions.start_children(df, request, NOW, most_depth=5).first()["error"] == "too_deep" and transitions.start_children(df, request, NOW).first()["error"] is None


def _chain(**more):
    return {"state": "completed", "completed_at": T(2), "retention_until": T(3)} | more


def test_members_are_gathered_for_the_batch_only(spark):
    open_ones = [_chain(id=f"o{k:02}", correlation_id="open", state="running" if k == 7 else "completed") for k in range(40)]
    done = [_chain(id=f"{c}{k}", correlation_id=c, completed_at=T(1, hour), started_at=T(1, 3 - k)) for c, hour in (("x", 2), ("y", 1), ("z", 3)) for k in range(2)]
    plan = retention.prunable(runs(spark, *open_ones, *done), NOW, batch=2)
    assert [(r["logical_id"], r["run_ids"]) for r in plan.collect()] == [("y", ["y1", "y0"]), ("x", ["x1", "x0"])]
    lines = plan._jdf.queryExecution().optimizedPlan().toString().splitlines()
    gathers = next(k for k, x in enumerate(lines) if "collect_list" in x)
    assert any("LeftSemi" in x for x in lines[gathers:])  # the batch is joined below, so before members are gathered


def test_prune_needs_every_member(spark):
    df = runs(spark, _chain(id="a"), _chain(id="b", continued_from_run_id="a", correlation_id="a", retention_until=None), _chain(id="c"), _chain(id="d", parent_run_id="c"), _chain(id="e", retention_until=T(10)))
    assert one(retention.prunable(df, NOW), "logical_id") == [("d",)]  # the child first, its parent in a later pass
    plan = retention.prunable(df, NOW)
    left, tables, outcome = retention.prune(df, {"events": events(spark, [("timer_started",)], "d")}, plan, NOW)
    assert one(left, "id") == [("a",), ("b",), ("c",), ("e",)] and tables["events"].count() == 0 and one(outcome, "logical_id", "outcome") == [("d", "pruned")]
    assert one(retention.prunable(left, NOW), "logical_id") == [("c",)]
    newer = left.unionByName(runs(spark, _chain(id="d"), {"id": "x", "parent_run_id": "d"}))
    assert one(retention.prune(newer, {}, plan, NOW)[2], "outcome") == [("child_lineage_changed",)]


def test_archive_without_correlation(spark):
    df = runs(spark, {"id": "p"}, _chain(id="a", correlation_id="g"), _chain(id="b", correlation_id="g", continued_from_run_id="a", parent_run_id="p"), _chain(id="c", parent_run_id="p"), _chain(id="d", continued_from_run_id="c"))
    assert one(retention.archivable(df, NOW), "id") == [("c",)]


def test_version_gc_skips_unloaded_workflows(spark):
    v = spark.createDataFrame([("A", "1"), ("A", "2"), ("B", "1")], "workflow string, version_hash string")
    loaded = v.where("workflow = 'A' AND version_hash = '2'")
    assert one(versions.collectable(v, loaded, runs(spark)), "workflow", "version_hash") == [("A", "1")]
    assert versions.collectable(v, loaded, runs(spark, {"id": "r", "workflow": "A", "version_hash": "1"})).count() == 0


# -- keys, tasks, signals


def test_insert_if_absent_and_append(spark):
    have = spark.createDataFrame([("n", "w", "k1", "r1", T(1))], TABLES["ingress_keys"])
    new = spark.createDataFrame([("n", "w", "k1", "r2", T(2)), ("n", "w", "k2", "r4", T(3)), ("n", "w", "k2", "r3", T(3))], TABLES["ingress_keys"])
    assert one(history.insert_if_absent(have, new, ["namespace", "workflow", "idempotency_key"], ["inserted_at", "run_id"]), "run_id") == [("r3",)]
    more = spark.createDataFrame([("r", None, "patched", "p", None, T(3)), ("q", None, "patched", "p", None, T(3))], TABLES["events"])
    assert one(history.append(events(spark, [("timer_started",), ("timer_fired",)]), more, ["inserted_at"]), "run_id", "seq") == [("q", 0), ("r", 2)]
    mixed = spark.createDataFrame([("r", None, "patched", "p", None, T(3)), ("r", 2, "patched", "p", None, T(4)), ("r", None, "patched", "p", None, T(5))], TABLES["events"])
    assert one(history.append(events(spark, [("timer_started",), ("timer_fired",)]), mixed, ["inserted_at"]), "inserted_at", "seq") == [(T(3), 3), (T(4), 2), (T(5), 4)]
    req = spark.createDataFrame([("q1", "n", "w", "v", "k1"), ("q2", "n", "w", "v", "k9"), ("q3", "n", "w", "v", "k9"), ("q4", "n", "w", "v", None)], "request_id string, namespace string, workflow string, version_hash string, idempotency_key string")
    made, ids = transitions.start_runs(runs(spark), have, req, NOW)
    by = dict(one(ids, "request_id", "run_id"))
    assert made.count() == 2 and by["q1"] == "r1" and by["q2"] == by["q3"] != by["q4"]


def test_latest_snapshot(spark):
    rows = [("r", 3, 1, "v", "[1]", T(1)), ("r", 9, 2, "v", "[2]", T(2)), ("r", 5, 1, "v", "[3]", T(1)), ("s", 1, 1, "v", "{broken", T(1))]
    assert one(history.latest_snapshots(spark.createDataFrame(rows, TABLES["snapshots"])), "run_id", "through_seq") == [("r", 5)]


def _task(spark, **more):
    names = [c.split()[0] for c in TABLES["tasks"].split(",")]
    base = {"id": "t", "run_id": "r", "seq": 0, "state": "leased", "queue": "q", "priority": 0, "attempt": 1, "lease_owner": "w", "lease_expires_at": T(11), "scheduled_at": T(1), "available_at": T(1)} | more
    return spark.createDataFrame([tuple(base.get(n) for n in names)], TABLES["tasks"])


def test_task_transitions(spark):
    led = runs(spark, {"id": "r", "lease_owner": "n", "lease_token": 1, "lease_expires_at": T(11)})
    over = _task(spark, lease_expires_at=T(9), attempt=2)
    assert one(transitions.requeue_expired(over, NOW), "attempt", "state") == [(3, "available")]
    assert one(transitions.release_claims(over, spark.createDataFrame([("t", "w")], "id string, owner string")), "attempt") == [(2,)]
    bad = spark.createDataFrame([("t", False)], "id string, ok boolean")
    out = transitions.activity_outcomes(_task(spark), bad, NOW, base_ms=1000)
    assert one(out["tasks"], "state", "attempt") == [("available", 2)] and out["events"].count() == 0 and one(out["attempts"], "outcome") == [("retrying",)]
    out = transitions.activity_outcomes(_task(spark, attempt=3), bad, NOW)
    assert one(out["tasks"], "state") == [("discarded",)] and one(out["events"], "event_type") == [("activity_failed",)]
    asked = spark.createDataFrame([("t", 1), ("t", 2), ("u", 1)], "id string, attempt long")
    assert one(transitions.claim_one(_task(spark, state="available", lease_owner=None), led, asked, NOW), "id", "attempt", "outcome") == [("t", 1, "claimed"), ("t", 2, "stale"), ("u", 1, "stale")]
    claim = spark.createDataFrame([("t", "r", "w", 1)], "id string, run_id string, owner string, attempt long")
    status = lambda runs_, **more: tasks.context(_task(spark, **more), runs_, claim).first()["status"]
    assert status(led) == "active" and status(led, attempt=2) == status(led, lease_owner="x") == status(led, state="available") == status(led, run_id="s") == "lease_lost"
    stuck, asked_, ended = ({"id": "r", "state": "stuck_unknown_version"}, {"id": "r", "cancel_requested_at": T(1)}, {"id": "r", "state": "completed"})
    assert [status(runs(spark, r)) for r in (stuck, asked_, ended, {"id": "other"})] == ["cancelled"] * 4
    assert {x: transitions.fenced_write(x) for x in ("lease_expired", "missing_expiry", "run_lease_lost", "lease_mismatch", "attempt_mismatch", "not_leased", "not_found", "run_mismatch", "run_not_found", "run_not_active", "?")} == {
        "lease_expired": "requeue", "missing_expiry": "requeue", "run_lease_lost": "requeue", "lease_mismatch": "drop", "attempt_mismatch": "drop", "not_leased": "drop", "not_found": "drop", "run_mismatch": "drop",
        "run_not_found": "discard", "run_not_active": "discard", "?": "reraise",
    }


def test_outcomes_are_fenced_and_stand_behind_their_task(spark):
    led, done = runs(spark, {"id": "r"}), "id string, ok boolean, run_id string, lease_owner string, attempt long"
    own = transitions.activity_outcomes(_task(spark, seq=4), spark.createDataFrame([("t", True, "r", "w", 1)], done), NOW, runs=led)
    assert one(own["events"], "run_id", "seq", "event_type") == [("r", 5, "activity_completed")] and one(own["woken"], "id") == [("r",)] and own["refused"].count() == 0
    late = transitions.activity_outcomes(_task(spark, attempt=2), spark.createDataFrame([("t", True, "r", "w", 1)], done), NOW, runs=led)
    assert late["tasks"].count() == late["events"].count() == 0 and one(late["refused"], "reason") == [("attempt_mismatch",)]
    ended = transitions.activity_outcomes(_task(spark), spark.createDataFrame([("t", True)], "id string, ok boolean"), NOW, runs=runs(spark, {"id": "r", "state": "cancelled"}))
    assert ended["tasks"].count() == 0 and one(ended["refused"], "reason") == [("run_not_active",)]


def test_manual_retry_and_classification(spark):
    snaps = spark.createDataFrame([("r", 5, 1, "v", "[]", T(1)), ("r", 1, 1, "v", "[]", T(1))], TABLES["snapshots"])
    asked = spark.createDataFrame([("t", "me", "why")], "id string, operator string, reason string")
    failed, past = runs(spark, {"id": "r", "state": "failed"}), [("side_effect",)] * 3 + [("activity_scheduled", "k"), ("activity_failed", "k")]
    out = transitions.manual_retry(failed, _task(spark, state="dead_lettered", seq=3), events(spark, past), snaps, asked, NOW)
    assert one(out["tasks"], "parent_task_id", "lineage_id", "seq", "attempt") == [("t", "t", 5, 1)] and one(out["runs"], "id", "state") == [("r", "suspended")] and one(out["dropped_snapshots"], "through_seq") == [(5,)]
    assert one(out["events"], "seq", "command_id", "event_type") == [(5, "k", "activity_retry_scheduled")] and one(out["operations"], "action", "classification") == [("manual_retry", "retryable")] and out["refused"].count() == 0
    why = lambda runs_=failed, past_=past, task=None, ask=asked: one(transitions.manual_retry(runs_, task or _task(spark, state="discarded", seq=3), events(spark, past_), snaps, ask, NOW)["refused"], "refusal")[0][0]
    assert why(runs(spark, {"id": "r", "state": "completed"})) == why(runs(spark, {"id": "r"})) == "run_not_failed" and why(runs(spark)) == "run_not_found"
    assert why(runs(spark, {"id": "r", "state": "failed", "parent_run_id": "p"})) == "child_run_retry_not_supported" and why(task=_task(spark)) == "not_discarded"
    assert why(past_=[*past, ("side_effect",)]) == why(past_=[*past[:4], ("activity_completed", "k")]) == "failure_not_replay_tail"
    assert why(past_=[*past[:3], ("compensation_scheduled", "k"), ("activity_failed", "k")]) == "compensation_retry_not_supported"
    assert why(task=_task(spark, state="discarded", seq=3).unionByName(_task(spark, id="u", parent_task_id="t"))) == "already_retried"
    assert why(ask=spark.createDataFrame([("gone", "me", "why")], "id string, operator string, reason string")) == "activity_task_not_found"
    ops = spark.createDataFrame([("1", "t", "L", "classify", "a", "x", "y", T(1)), ("2", "t", "L", "classify", None, "x", "y", T(3)), ("3", "t", "L", "classify", "b", "x", "y", T(2))], TABLES["operations"])
    assert one(tasks.latest_classification(ops), "classification") == [("b",)]
    ask = spark.createDataFrame([("t", "dead_letter", "poison", "me")], "id string, action string, classification string, operator string")
    changed, log = transitions.operate(_task(spark, state="discarded"), ask, NOW)
    assert changed.count() == 0 and log.first()["status"] == "planned"
    assert transitions.operate(_task(spark, state="discarded"), ask, NOW, dry_run=False)[0].first()["state"] == "dead_lettered"


def test_tokens(spark):
    df = spark.createDataFrame([(1, "o", 1), (1, "o", 2), (None, None, None), (None, "o", None), (1, "o", None)], "token long, owner string, given long")
    assert [r[0] for r in df.select(transitions.token_matches(F.col("token"), F.col("owner"), F.col("given"))).collect()] == [True, False, True, False, False]


def test_signal_wins_late_but_not_over_a_written_timeout(spark):
    awaits = spark.createDataFrame([("r", 0, "a", T(5)), ("r", 1, "b", T(5)), ("r", 2, "c", T(20)), ("w", 0, "a", T(5))], "run_id string, seq long, name string, timeout_at timestamp_ntz")
    signals = spark.createDataFrame([("s2", "r", "g", "a", None, None, False, T(9)), ("s1", "r", "g", "a", None, None, False, T(8)), ("s3", "w", "g", "a", None, None, False, T(1))], TABLES["signals"])
    got = transitions.signal_race(awaits, signals, events(spark, [("signal_awaited",), ("timer_fired",)], "w"), NOW)
    assert one(got, "run_id", "seq", "winner", "signal_id") == [("r", 0, "signal", "s1"), ("r", 1, "timeout", None), ("r", 2, "pending", None), ("w", 0, "timer_fired", "s3")]


def test_delivery(spark):
    df = runs(spark, {"id": "a", "state": "completed"}, {"id": "b", "continued_from_run_id": "a"}, {"id": "e", "state": "failed"})
    have = spark.createDataFrame([("s0", "b", "g", "n", "d1", None, True, T(1))], TABLES["signals"])
    new = spark.createDataFrame([("s1", "a", "g", "n", "d1", None, False, T(2)), ("s2", "a", "g", "n", None, None, False, T(2)), ("s3", "e", "h", "n", None, None, False, T(2)), ("s4", "x", "h", "n", None, None, False, T(2))], TABLES["signals"])
    added, outcome = transitions.deliver(df, have, new)
    assert one(added, "id", "run_id") == [("s2", "b")] and one(outcome, "id", "outcome") == [("s1", "duplicate"), ("s2", "delivered"), ("s3", "terminal"), ("s4", "missing")]


# -- folds

PAIR = [("activity_scheduled",), ("activity_completed",)]


def test_retry_chain_is_one_step(spark):
    h = [("activity_scheduled",), ("activity_failed",), ("activity_retry_scheduled",), ("activity_completed",), ("side_effect", "d")]
    assert one(folds.compacted(events(spark, h)), "seq", "effect_type", "result_type", "advance_by") == [(0, "activity", "activity_completed", 4), (4, "side_effect", "side_effect", 1)]


def test_stops(spark):
    stop = lambda h: [r["stop"] for r in folds.steps(events(spark, h)).orderBy("seq").collect()]
    assert stop([*PAIR, ("timer_started", "t")]) == [None, "incomplete"]
    assert stop([("compensation_scheduled", "a"), ("compensation_scheduled", "b")])[0] == "parallel"
    assert stop([("timer_started", "t"), ("timer_fired", "u")]) == ["mismatch"] and stop([("timer_started", "t"), ("side_effect", "t")])[0] == "mismatch"
    assert stop([("side_effect", None)]) == ["missing_command"] and stop([("odd", "x")]) == ["unsupported"]
    assert folds.compacted(events(spark, [("side_effect", "a"), ("timer_started", "t"), ("timer_fired", "u")])).count() == 0


def test_windows_equal_the_loop(spark):
    rng, rows = random.Random(7), []
    for run in range(300):
        seq = 0
        for k in range(rng.randint(0, 6)):
            opener = rng.choice(list(folds.PAIRS))
            kinds = [rng.choice(list(folds.SINGLE))] if rng.random() < 0.3 else [opener, rng.choice(folds.PAIRS[opener][0])]
            if kinds[-1] == "activity_failed" and len(kinds) == 2 and rng.random() < 0.5:
                kinds += ["activity_retry_scheduled", rng.choice(["activity_completed", "activity_failed"])]
            for kind in kinds:
                if rng.random() > 0.03:
                    rows.append((f"r{run}", seq, kind, None if rng.random() < 0.01 else f"c{k}" if rng.random() > 0.02 else "odd", None, T(1)))
                    seq += 1 + (rng.random() < 0.01)
    df = spark.createDataFrame(rows, TABLES["events"])
    columns = ("run_id", "seq", "effect_type", "command_id", "result_type", "advance_by")
    assert one(folds.compacted(df), *columns) == one(folds.folded_in_python(df), *columns)


def test_replay(spark):
    h = events(spark, [("side_effect", None), ("timer_started", "t")])
    want = spark.createDataFrame([("r", 0, "side_effect", "any"), ("r", 1, "timer_started", "u"), ("r", 2, "patched", "p")], "run_id string, seq long, event_type string, command_id string")
    assert one(folds.replayed(want, h), "seq", "verdict") == [(0, "ok"), (1, "mismatch"), (2, "pending")] and one(folds.drift(want, h), "seq") == [(1,)]
    uses = spark.createDataFrame([("r", "p", 0), ("r", "q", 1)], "run_id string, patch_name string, seq long")
    assert one(folds.patch_decisions(uses, events(spark, [("patched", "p")])), "patch_name", "value") == [("p", True), ("q", False)]
    batch = events(spark, [("compensation_scheduled", "a"), ("compensation_scheduled", "b"), ("compensation_failed", "b"), ("compensation_completed", "a")])
    assert one(folds.parallel_batches(batch), "scheduled", "finished", "complete") == [(2, 2, True)]
    told = lambda k, kind, command, payload=None: ("r", k, kind, command, payload, T(1))
    undo = '{"compensate":"undo"}'
    past = [told(0, "activity_scheduled", "a", undo), told(1, "activity_completed", "a"), told(2, "activity_scheduled", "b"), told(3, "activity_completed", "b"), told(4, "activity_scheduled", "c", undo), told(5, "activity_completed", "c")]
    past += [told(6, "activity_scheduled", "d", undo), told(7, "activity_completed", "d"), told(8, "compensation_scheduled", "x"), told(9, "compensation_failed", "x", '{"target_activity_id":"d"}'), told(10, "activity_scheduled", "e", undo), told(11, "activity_failed", "e")]
    assert one(folds.compensation_order(spark.createDataFrame(past, TABLES["events"])), "seq", "place") == [(1, 1), (5, 0)]
    calls = spark.createDataFrame([("r", 0, "f:1"), ("r", 2, "f:2"), ("r", 4, "f:1"), ("s", 0, "f:1")], "run_id string, seq long, base string")
    assert one(folds.command_ordinals(calls), "run_id", "seq", "ordinal") == [("r", 0, 0), ("r", 2, 0), ("r", 4, 1), ("s", 0, 0)]
    assert folds.same_histories(h, h).count() == 0 and folds.same_histories(h, batch).count() > 0
    assert one(folds.covered(h, spark.createDataFrame([("r", 0)], "run_id string, through_seq long")), "seq", "compacted") == [(0, True), (1, False)]


# -- stores


def test_stores(spark, tmp_path):
    for own in (store.MemoryStore(spark), store.ParquetStore(spark, f"file://{tmp_path}/store")):
        assert own.read("events").count() == 0
        own.append("events", events(spark, PAIR))
        own.append("events", events(spark, PAIR, "s").withColumn("inserted_at", F.lit("2024-03-01").cast("timestamp_ntz")))
        assert own.read("events").count() == 4
        own.replace("runs", runs(spark, {"id": "a"}))
        own.replace("runs", own.read("runs").withColumn("state", F.lit("completed")))
        assert one(own.read("runs"), "id", "state") == [("a", "completed")]
    assert one(own.months(), "month") == [("2024-01",), ("2024-03",)]
    assert one(store.ensure_months(own.read("events").drop("month"), own.months().where("month = '2024-01'")), "month", "moved_rows") == [("2024-03", 2)]
    own.drop_months(["2024-01"])
    assert own.read("events").count() == 2
    store.dump_history(events(spark, PAIR), "r", f"file://{tmp_path}/one")
    assert one(store.load_history(spark, f"file://{tmp_path}/one"), "seq", "event_type") == [(0, "activity_scheduled"), (1, "activity_completed")]


json_values = st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.text("ab", max_size=2), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("ab", max_size=1), x, max_size=3), max_leaves=6)


@settings(max_examples=100, deadline=None)
@given(json_values, st.text("c", min_size=1, max_size=1), json_values)
def test_containment_is_reflexive_and_grows(value, key, more):
    assert jsonx.contains(value, value)
    if isinstance(value, dict):
        assert jsonx.contains(value | {key: more}, value)
    if isinstance(value, list):
        assert jsonx.contains([*value, more], value)
