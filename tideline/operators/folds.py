"""Folds over event histories: steps, compaction, replay checks, command ordinals and compensation order.

Windows over one run do the work; a run's history is bounded by its snapshots, and runs are spread by key."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: The effect that an event of one step stands for.
SINGLE = {
    "side_effect": "side_effect", "workflow_log": "workflow_log", "activity_completed": "activity", "activity_failed": "activity",
    "signal_received": "await_signal", "timer_fired": "timer", "patched": "patched", "compensation_completed": "compensation",
    "compensation_failed": "compensation", "child_started": "start_child", "run_continued_as_new": "continue_as_new",
    "child_completed": "await_child", "child_failed": "await_child", "child_cancelled": "await_child",
}
#: Openers, the events that may close them, and the effect of the pair.
PAIRS = {
    "activity_scheduled": (("activity_completed", "activity_failed"), "activity"),
    "signal_awaited": (("signal_received", "timer_fired"), "await_signal"),
    "timer_started": (("timer_fired",), "timer"),
    "compensation_scheduled": (("compensation_completed", "compensation_failed"), "compensation"),
}


def _order() -> WindowSpec:
    return Window.partitionBy("run_id").orderBy("seq")


def _effect(event: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, effect in [*SINGLE.items(), *((k, v[1]) for k, v in PAIRS.items())]:
        out = F.when(event == name, effect).otherwise(out)
    return out


def _closes(opener: Column, closer: Column) -> Column:
    out = F.lit(False)
    for name, (ends, _) in PAIRS.items():
        out = out | ((opener == name) & closer.isin(*ends))
    return out


def pairs(events: DataFrame) -> DataFrame:
    """run_id, seq, event_type, next_type, outcome of each opener: paired, mismatch (another event or command
    follows), pending (the history ends) or gap (the next number is missing)."""
    following = events.withColumns({"next_type": F.lead("event_type").over(_order()), "next_seq": F.lead("seq").over(_order()), "next_command": F.lead("command_id").over(_order())})
    same = F.col("command_id").eqNullSafe(F.col("next_command"))
    outcome = (
        F.when(F.col("next_seq").isNull(), "pending").when(F.col("next_seq") != F.col("seq") + 1, "gap")
        .when(_closes(F.col("event_type"), F.col("next_type")) & same, "paired").otherwise("mismatch")
    )
    return following.where(F.col("event_type").isin(*PAIRS)).select("run_id", "seq", "event_type", "next_type", outcome.alias("outcome"))


def steps(events: DataFrame, payload: bool = False) -> DataFrame:
    """run_id, seq, effect_type, command_id, result_type, advance_by, stop for every step root. An event is a
    root unless it closes the root before it; retried activities are one step (failed, retry, ... in a row).
    stop says why a root is no complete step: incomplete, parallel, mismatch, missing_command, unsupported.

    Histories without retries need no more than the event before and after. Retry chains are found as islands:
    a failure that a retry follows, and the retry, belong to the root above them. With payload, that of the root
    and the numbers of all events of the step (members) come too."""
    e, after = F.col("event_type"), F.lead("event_type").over(_order())
    w = events.withColumns(
        {"_next": after, "_prev": F.lag("event_type").over(_order()), "_next_seq": F.lead("seq").over(_order()), "_next_command": F.lead("command_id").over(_order()), "_prev_command": F.lag("command_id").over(_order())}
    )
    opener = e.isin(*PAIRS)
    in_chain = (e == "activity_retry_scheduled") | (F.col("_prev").isin(*PAIRS) & _closes(F.col("_prev"), e)) | ((F.col("_prev") == "activity_retry_scheduled") & e.isin("activity_completed", "activity_failed"))
    w = w.withColumn("_root", (~in_chain).cast("int")).withColumn("_island", F.sum("_root").over(_order().rowsBetween(Window.unboundedPreceding, 0)))
    group = w.groupBy("run_id", "_island").agg(
        F.min(F.struct("seq", "event_type", "command_id", *(["payload"] * payload))).alias("root"),
        F.collect_list("seq").alias("members"),
        F.max(F.struct("seq", "event_type", "_next", "_next_seq")).alias("last"),
        F.count(F.lit(1)).alias("n"),
        F.bool_and(F.col("command_id").isNotNull()).alias("named"),
        F.min("command_id").alias("least_command"),
        F.max("command_id").alias("most_command"),
    )
    root, last = F.col("root.event_type"), F.col("last.event_type")
    pair, alone = root.isin(*PAIRS), F.col("n") == 1
    open_end = last.isin(*PAIRS, "activity_retry_scheduled")
    contiguous = F.col("last.seq") == F.col("root.seq") + F.col("n") - 1
    stop = (
        F.when(~pair & ~root.isin(*SINGLE), "unsupported")
        .when(pair & open_end & F.col("last._next").isNull(), "incomplete")
        .when((root == "compensation_scheduled") & alone & (F.col("last._next") == "compensation_scheduled"), "parallel")
        .when(pair & (open_end | ~contiguous), "mismatch")
        .when(~F.col("named"), "missing_command")
        .when(F.col("least_command") != F.col("most_command"), "mismatch")
    )
    return group.select("run_id", "root.seq", _effect(root).alias("effect_type"), "root.command_id", last.alias("result_type"), F.col("n").alias("advance_by"), stop.alias("stop"), "least_command", "most_command", *(["root.payload", "members"] * payload))


def compacted(events: DataFrame) -> DataFrame:
    """Steps of each run up to the first that stops, none if that one is an error. Runs whose first step stops
    give no rows."""
    return _judged(events).where("_kept").select("run_id", "seq", "effect_type", "command_id", "result_type", "advance_by")


def _judged(events: DataFrame) -> DataFrame:
    """All steps, with whether they are kept when the run is compacted."""
    bad = F.sum(F.col("stop").isNotNull().cast("int")).over(_order().rowsBetween(Window.unboundedPreceding, 0))
    first_stop = F.first("stop", ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return steps(events).withColumn("_kept", (bad == 0) & (first_stop.isNull() | first_stop.isin("incomplete", "parallel")))


def snapshots(events: DataFrame, threshold: int = 1, most_bytes: int | None = None) -> DataFrame:
    """run_id, through_seq, step_count, steps (JSON) of runs with at least `threshold` compacted events; too
    large ones are left out."""
    step = F.struct("seq", "effect_type", "command_id", "result_type", "advance_by")
    made = compacted(events).groupBy("run_id").agg(
        F.max(F.col("seq") + F.col("advance_by") - 1).alias("through_seq"), F.sum("advance_by").alias("events"), F.count(F.lit(1)).alias("step_count"), F.to_json(F.array_sort(F.collect_list(step))).alias("steps")
    )
    made = made.where(F.col("events") >= threshold)
    return made if most_bytes is None else made.where(F.octet_length("steps") <= most_bytes)


_STEPS = "array<struct<seq:bigint,effect_type:string,command_id:string,result_type:string,advance_by:bigint>>"


def extended(base: DataFrame, events: DataFrame) -> DataFrame:
    """run_id, through_seq, step_count, steps: snapshots on top of base ones (run_id, through_seq, steps; one a run,
    see history.latest_snapshots). Only events behind the base are folded; its steps stay. Runs without a new
    complete step give no row, runs without a base are folded from their start."""
    old = base.select("run_id", F.col("through_seq").alias("_base"), F.from_json("steps", _STEPS).alias("_old"))
    tail = events.join(old.select("run_id", "_base"), "run_id", "left").where(F.col("seq") > F.coalesce("_base", F.lit(-1))).drop("_base")
    both = F.concat(F.coalesce("_old", F.from_json(F.lit("[]"), _STEPS)), F.from_json("steps", _STEPS))
    made = snapshots(tail).join(old, "run_id", "left").withColumn("_all", F.array_sort(both))
    return made.select("run_id", "through_seq", F.size("_all").cast("long").alias("step_count"), F.to_json("_all").alias("steps"))


def folded_in_python(events: DataFrame) -> DataFrame:
    """As compacted, by a plain loop over each run's events; the windows are tested against it."""

    def fold(run: pd.DataFrame) -> pd.DataFrame:
        rows, out, i = run.sort_values("seq").to_dict("records"), [], 0
        while i < len(rows):
            taken, stop = _step(rows, i)
            if stop in ("incomplete", "parallel"):
                break
            if stop:
                return pd.DataFrame([], columns=["run_id", "seq", "effect_type", "command_id", "result_type", "advance_by"])
            first, last = rows[i], rows[i + taken - 1]
            effect = SINGLE.get(first["event_type"]) or PAIRS[first["event_type"]][1]
            out.append((first["run_id"], first["seq"], effect, first["command_id"], last["event_type"], taken))
            i += taken
        return pd.DataFrame(out, columns=["run_id", "seq", "effect_type", "command_id", "result_type", "advance_by"])

    schema = "run_id string, seq long, effect_type string, command_id string, result_type string, advance_by long"
    return events.select("run_id", "seq", "event_type", "command_id").groupBy("run_id").applyInPandas(fold, schema)


def _step(rows: list[dict], i: int) -> tuple[int, str | None]:
    root = rows[i]
    kind, command = root["event_type"], root["command_id"]
    if kind not in PAIRS:
        return 1, None if kind in SINGLE and command is not None else ("missing_command" if kind in SINGLE else "unsupported")
    at, ends = i, PAIRS[kind][0]
    while True:
        if at + 1 >= len(rows):
            return 0, "incomplete"
        nxt = rows[at + 1]
        if nxt["seq"] != rows[at]["seq"] + 1:
            return 0, "mismatch"
        if kind == nxt["event_type"] == "compensation_scheduled":
            return 0, "parallel"
        if command is None:
            return 0, "missing_command"
        if nxt["command_id"] != command or nxt["event_type"] not in ends:
            return 0, "mismatch"
        at += 1
        more = rows[at + 1] if at + 1 < len(rows) else None
        if kind == "activity_scheduled" and nxt["event_type"] == "activity_failed" and more and more["event_type"] == "activity_retry_scheduled":
            if more["command_id"] != command or more["seq"] != nxt["seq"] + 1:
                return 0, "mismatch"
            at += 1
            continue
        return at - i + 1, None


def pending_effects(events: DataFrame) -> DataFrame:
    """run_id, seq, event_type, reason of runs whose history ends with an opener."""
    #: Largest numbers are hash aggregates; a struct with a text in it would be sorted for.
    ends = events.groupBy("run_id").agg(F.max("seq").alias("seq"), *(F.max(F.when(F.col("event_type") == name, F.col("seq"))).alias(name) for name in PAIRS))
    kind, reason = (F.coalesce(*(F.when(F.col(name) == F.col("seq"), told) for name, told in rows)) for rows in ([(n, n) for n in PAIRS], [(n, e) for n, (_, e) in PAIRS.items()]))
    return ends.select("run_id", "seq", kind.alias("event_type"), reason.alias("reason")).where("event_type IS NOT NULL")


def command_ordinals(commands: DataFrame) -> DataFrame:
    """commands (run_id, seq, base) with ordinal: how many earlier commands of the run have the same base, that is,
    come from the same place of the program with the same arguments."""
    place = F.row_number().over(Window.partitionBy("run_id", "base").orderBy("seq"))
    return commands.select("run_id", "seq", "base", (place - 1).cast("long").alias("ordinal"))


def compensation_order(events: DataFrame) -> DataFrame:
    """run_id, seq, place of completed activities that are yet to be compensated: the last success first. Only
    those are that were scheduled with a compensation (payload: compensate); a compensation that ended, well or
    not, names its activity (payload: target_activity_id), as it is a command of its own."""
    value = lambda key: F.get_json_object("payload", f"$.{key}")
    able = events.where(F.col("event_type") == "activity_scheduled").where(F.coalesce(value("compensate"), F.lit("none")) != "none").select("run_id", "command_id").distinct()
    done = events.where("event_type IN ('compensation_completed', 'compensation_failed')").select("run_id", value("target_activity_id").alias("command_id"))
    left = events.where("event_type = 'activity_completed'").join(able, ["run_id", "command_id"], "left_semi").join(done, ["run_id", "command_id"], "left_anti")
    return left.select("run_id", "seq", (F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("seq"))) - 1).cast("long").alias("place"))


def replayed(expected: DataFrame, events: DataFrame) -> DataFrame:
    """expected (run_id, seq, event_type, command_id) against the history: ok, pending (no event there) or
    mismatch. A missing command id in the history matches any."""
    actual = events.select("run_id", "seq", F.col("event_type").alias("_type"), F.col("command_id").alias("_command"))
    joined = expected.join(actual, ["run_id", "seq"], "left")
    same = (F.col("_type") == F.col("event_type")) & (F.col("_command").isNull() | F.col("_command").eqNullSafe(F.col("command_id")))
    verdict = F.when(F.col("_type").isNull(), "pending").when(same, "ok").otherwise("mismatch")
    return joined.select("run_id", "seq", "event_type", "command_id", verdict.alias("verdict"))


def drift(expected: DataFrame, events: DataFrame) -> DataFrame:
    """run_id, seq of the first mismatch of each run."""
    return replayed(expected, events).where("verdict = 'mismatch'").groupBy("run_id").agg(F.min("seq").alias("seq"))


def matched(expected: DataFrame, events: DataFrame) -> DataFrame:
    """expected (run_id, seq, effect_type, command_id, identity) against the steps of the history: verdict ok, with
    advance_by and result_type of the whole step (its end, retries included); pending, where nothing is written
    there yet or the step has not ended; parallel, for a compensation within a batch (see parallel_batches); or
    mismatch. identity is what the effect must agree in beside its command, a map of names and texts that the
    payload of the step's first event must hold (a kind; a level and message; a signal's name; a timer, target
    or child id; a child's workflow and input hash); null or empty asks nothing. A missing command in the history
    matches any."""
    key = ["run_id", "seq"]
    #: A step tells of all its events' places, so that histories meet what is expected in one join.
    step = steps(events, payload=True).withColumnsRenamed({"effect_type": "_effect", "payload": "_payload"})
    told = F.struct("_effect", "result_type", "advance_by", "stop", "least_command", "most_command", "_payload")
    place = step.select("run_id", F.col("seq").alias("_root"), told.alias("_step"), F.explode("members").alias("seq"), F.lit(True).alias("_there"))
    place = place.select(*key, "_there", F.when(F.col("seq") == F.col("_root"), F.col("_step")).alias("_step"))
    j = expected.join(place, key, "left").select(*(F.col(c) for c in expected.columns), "_there", "_step.*").withColumn("_held", F.from_json("_payload", "map<string,string>"))
    own = lambda c: F.col(c).isNull() | F.col(c).eqNullSafe(F.col("command_id"))
    agrees = F.coalesce(F.forall(F.map_entries("identity"), lambda x: F.col("_held")[x["key"]].eqNullSafe(x["value"])), F.lit(True))
    same = F.coalesce(F.col("_effect") == F.col("effect_type"), F.lit(False)) & own("least_command") & own("most_command") & agrees
    ended = F.col("stop").isNull() | (F.col("stop") == "missing_command")
    verdict = F.when(F.col("_there").isNull(), "pending").when(~same, "mismatch").when(F.col("stop") == "incomplete", "pending").when(F.col("stop") == "parallel", "parallel").when(ended, "ok").otherwise("mismatch")
    j = j.withColumn("verdict", verdict)
    ok = F.col("verdict") == "ok"
    return j.select(*key, "effect_type", "command_id", "verdict", F.when(ok, F.col("result_type")).alias("result_type"), F.when(ok, F.col("advance_by")).alias("advance_by"))


def patch_decisions(uses: DataFrame, events: DataFrame) -> DataFrame:
    """uses (run_id, patch_name, seq) with the value that holds: the marker's, false without one; the first
    decision of a name holds for the whole run."""
    markers = events.where("event_type = 'patched'").select("run_id", "command_id", F.coalesce(F.get_json_object("payload", "$.value").cast("boolean"), F.lit(True)).alias("value"), "seq")
    first = markers.groupBy("run_id", F.col("command_id").alias("patch_name")).agg(F.min_by("value", "seq").alias("value"))
    return uses.join(first, ["run_id", "patch_name"], "left").withColumn("value", F.coalesce("value", F.lit(False)))


def parallel_batches(events: DataFrame) -> DataFrame:
    """run_id, batch, scheduled, finished, complete of runs of two or more compensation_scheduled: the terminals
    behind them may come in any order."""
    e = F.col("event_type")
    is_open, is_end = (e == "compensation_scheduled"), e.isin("compensation_completed", "compensation_failed")
    starts = (is_open & ~F.coalesce(F.lag("event_type").over(_order()) == "compensation_scheduled", F.lit(False))).cast("int")
    w = events.withColumn("_start", starts).withColumn("batch", F.sum("_start").over(_order().rowsBetween(Window.unboundedPreceding, 0))).where("batch > 0")
    by = w.groupBy("run_id", "batch").agg(
        F.count_if(is_open).alias("scheduled"), F.count_if(is_end).alias("finished"),
        F.array_sort(F.collect_list(F.when(is_open, F.col("command_id")))).alias("_a"), F.array_sort(F.collect_list(F.when(is_end, F.col("command_id")))).alias("_b"),
    )
    return by.where("scheduled > 1").select("run_id", "batch", "scheduled", "finished", (F.col("_a") == F.col("_b")).alias("complete"))


def same_histories(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one history has and the other lacks at the same place; numbers and times do not count."""
    place = F.row_number().over(_order())
    a, b = (x.select("run_id", place.alias("place"), "event_type", "command_id") for x in (left, right))
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def latest_pending_timer(events: DataFrame) -> DataFrame:
    """run_id, seq of the last timer that has started and not fired."""
    fired = events.where("event_type = 'timer_fired'").select("run_id", "command_id")
    return events.where("event_type = 'timer_started'").join(fired, ["run_id", "command_id"], "left_anti").groupBy("run_id").agg(F.max("seq").alias("seq"))


def consumption(events: DataFrame) -> DataFrame:
    """run_id, events, consumed, complete: whether the steps use up the whole history. Every event is part of one
    step, so the steps tell how many there are."""
    used = F.when(F.col("_kept") & F.col("run_id").isNotNull(), F.col("advance_by")).otherwise(0)
    out = _judged(events).groupBy("run_id").agg(F.sum("advance_by").alias("events"), F.sum(used).alias("consumed"))
    return out.withColumn("complete", F.col("events") == F.col("consumed"))


def covered(events: DataFrame, offsets: DataFrame) -> DataFrame:
    """Events with whether a snapshot's offset (run_id, through_seq) covers them."""
    return events.join(offsets, "run_id", "left").withColumn("compacted", F.col("seq") <= F.coalesce("through_seq", F.lit(-1)))


def durable(value: object, path: str = "$") -> tuple[str, str] | None:
    """(path, kind) of the first part of a value that JSON cannot hold, else None."""
    if isinstance(value, dict):
        items: Iterator = ((f"{path}.{k}", v) if isinstance(k, str) else (f"{path}.{k!r}", NotImplemented) for k, v in value.items())
    elif isinstance(value, (list, tuple)):
        items = ((f"{path}[{k}]", v) for k, v in enumerate(value))
    else:
        try:
            json.dumps(value)
            return None
        except TypeError:
            return path, type(value).__name__
    return next((bad for p, v in items if (bad := durable(v, p))), None)
