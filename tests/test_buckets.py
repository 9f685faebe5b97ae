"""What belongs to a run or task is joined, grouped and put in order where it lies."""

import os

import pytest

from tideline.operators import folds
from tideline.plans import catalogue
from tideline.sources import fixtures

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def spread(spark):
    """The derived tables in several buckets, so that a plan has shuffles where it needs them."""
    old, kept = dict(fixtures.BUCKET), dict(fixtures._CACHE)
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    fixtures._CACHE.clear()
    fixtures.BUCKET.update(orders=200, lineitem=1000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)
    fixtures.BUCKET.update(old)
    fixtures._CACHE.clear()
    fixtures._CACHE.update(kept)


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def moves(table):
    return table()._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_each_table_is_shuffled_once_by_its_key_and_once_into_buckets(spread):
    """Orders and customers by customer, and runs into their buckets; line items; signals lie where their events do."""
    t = fixtures.workflow_tables(spread, SF)
    assert t["runs"].count() == 1500 and t.buckets == 8
    assert [moves(f) for f in (t._runs, t._events, t._signals)] == [3, 1, 0]


def test_tasks_are_shuffled_once_into_their_buckets(spread):
    assert moves(fixtures.workflow_tables(spread, SF)._tasks) == 1


@pytest.mark.parametrize("name, most", [("manual_retries", 6), ("compensation_batches", 3), ("replay_matches", 2), ("activity_context", 1)])
def test_shuffles_by_key(spread, name, most):
    assert shuffles(catalogue.QUERIES[name](spread, SF)) <= most


def test_timers_lie_where_their_events_do(spread):
    assert moves(fixtures.workflow_tables(spread, SF)._timers) == 0


@pytest.mark.parametrize("name", ["snapshot_extended", "snapshot_steps", "snapshot_trigger", "history_consumption"])
def test_histories_take_no_shuffle(spread, name):
    assert shuffles(catalogue.QUERIES[name](spread, SF)) == 0


def test_last_events_are_hash_aggregates(spread):
    df = catalogue.QUERIES["pending_effects"](spread, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and shuffles(df) == 0


def test_cancelled_runs_ask_for_runs_only(spread):
    kept = dict(fixtures._CACHE)
    fixtures._CACHE.clear()
    catalogue.QUERIES["cancel_cascade"](spread, SF)
    assert set(fixtures.workflow_tables(spread, SF)) == {"runs"}
    fixtures._CACHE.update(kept)


def test_expired_task_leases_take_no_shuffle(spread):
    t = fixtures.workflow_tables(spread, SF)
    assert moves(t._tasks) == 1 and "Exchange" not in catalogue.QUERIES["expired_task_leases"](spread, SF)._jdf.queryExecution().executedPlan().toString()


def carried(df):
    """What the uppermost shuffle of a plan carries."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "RepartitionByExpression":
        plan = plan.children().head()
    return plan.output().mkString(" "), plan.toString()


def test_tasks_carry_no_texts_into_their_buckets(spread):
    columns, _ = carried(fixtures.workflow_tables(spread, SF)._tasks())
    assert [c.split("#")[0] for c in columns.split()] == ["k", "seq", "inserted_at", "_done"]


@pytest.mark.parametrize("name", ["runs", "events", "tasks", "timers", "signals"])
def test_derived_tables_are_packed_tightly(spread, name):
    files = fixtures.workflow_tables(spread, SF)[name].inputFiles()
    assert files and all(f.endswith(".zstd.parquet") for f in files)


def test_runs_carry_remainders_of_their_customer(spread):
    assert "% 6) AS cust" in carried(fixtures.workflow_tables(spread, SF)._runs())[1]


def most_read(monkeypatch, spark, name):
    """The most bytes of files that a task may read while a table is derived, and when that is done."""
    seen, setting = {}, "spark.sql.files.maxPartitionBytes"
    kept = fixtures.bucketed
    monkeypatch.setattr(fixtures, "SPLIT", 300)
    monkeypatch.setattr(fixtures, "bucketed", lambda df, table, *rest: (seen.update({table: spark.conf.get(setting)}), kept(df, table, *rest))[1])
    fixtures._Derived(spark, SF)[name]
    return int(seen[f"wf_{name}"].rstrip("b")), spark.conf.get(setting)


def test_line_items_are_read_in_splits_of_some_rows(spread, monkeypatch):
    """6,000 line items at 300 to a task: a twentieth of the file."""
    had = spread.conf.get("spark.sql.files.maxPartitionBytes")
    assert most_read(monkeypatch, spread, "events") == (os.path.getsize(f"{SF}/lineitem.parquet") * 300 // 6000, had)


def test_orders_are_read_in_splits_of_some_rows(spread, monkeypatch):
    had = spread.conf.get("spark.sql.files.maxPartitionBytes")
    assert most_read(monkeypatch, spread, "runs") == (os.path.getsize(f"{SF}/orders.parquet") * 300 // 1500, had)


def test_consumption_reads_histories_once(spread):
    plan = catalogue.QUERIES["history_consumption"](spread, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan


def test_consumption_counts_events_outside_of_steps(spread):
    """A history that begins with a closer, one that stops, one without a run."""
    rows = [("a", 0, "timer_fired"), ("a", 1, "timer_started"), ("b", 0, "timer_fired"), ("c", 0, "timer_started"), ("c", 1, "nonsense"), (None, 0, "timer_fired")]
    events = spread.createDataFrame([(r, s, e, "c") for r, s, e in rows], "run_id string, seq long, event_type string, command_id string")
    got = {r.run_id: tuple(r)[1:] for r in folds.consumption(events).collect()}
    assert got == {"a": (2, 1, False), "b": (1, 1, True), "c": (2, 0, False), None: (1, 0, False)}


def test_line_items_carry_their_amounts_in_two_numbers(spread):
    columns, _ = carried(fixtures.workflow_tables(spread, SF)._events())
    assert not {c.split("#")[0] for c in columns.split()} & set(fixtures._AMOUNTS)


def test_amounts_come_back_as_they_were(spread):
    """Also such that hundredths do not hold: negative, large, fine, null, and no numbers at all."""
    odd = [0.0, 0.01, 0.07, 84197.04, -3.0, 1e300, 0.001, 2.0**26 + 0.5, None, float("nan"), float("inf"), float("-inf")]
    rows = [tuple(odd[(i + j) % len(odd)] for j in range(4)) for i in range(len(odd))] + [(x, 5.25, 0.1, 0.08) for x in odd] + [(17.0, 84197.04, x, 0.02) for x in odd]
    li = spread.createDataFrame(rows, ", ".join(f"{c} double" for c in fixtures._AMOUNTS))
    packed = fixtures._packed(li)
    assert 0 < packed.where("_raw IS NULL").count() < len(rows)
    assert sorted(map(repr, map(tuple, fixtures._unpacked(packed).collect()))) == sorted(map(repr, rows))


def test_other_types_of_amounts_are_left_alone(spread):
    li = spread.range(1).selectExpr(*(f"CAST(1.005 AS DECIMAL(12,3)) AS {c}" for c in fixtures._AMOUNTS))
    assert fixtures._unpacked(fixtures._packed(li)).collect() == li.collect()
