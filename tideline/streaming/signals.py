"""Streams over the journal: deliveries once each, signals against deadlines, due timers, missed wakes and leases."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tideline.functions.scalars import after, moment
from tideline.operators import transitions


def deliveries_once(signals: DataFrame) -> DataFrame:
    """A stream of signals: of equal (correlation, name, delivery) one passes, those without a delivery id all.
    The state has no end, as a delivery may come again at any time."""
    key = F.when(F.col("delivery_id").isNotNull(), F.struct("correlation_id", "name", "delivery_id"))
    apart = F.coalesce(F.to_json(key), F.concat(F.lit("id:"), "id"))
    return signals.withColumn("_key", apart).dropDuplicates(["_key"]).drop("_key")


RACE = "run_id string, name string, winner string, at timestamp"


def signal_or_timeout(stream: DataFrame) -> DataFrame:
    """stream (run_id, name, kind: await or signal, at, timeout_at) with event time `at` and a watermark: one row
    for each await, won by the first signal of its mailbox or by its deadline. Signals that come early wait in
    order; a signal that is there wins even past the deadline."""

    def race(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, mailbox = ([list(x) for x in part] for part in state.get) if state.exists else ([], [])
        out = []

        def settle() -> None:
            while waiting and mailbox:
                waiting.pop(0)
                out.append((*key, "signal", pd.Timestamp(mailbox.pop(0)[0], unit="us")))

        if state.hasTimedOut:
            now = state.getCurrentWatermarkMs() * 1000
            for a in [a for a in waiting if a[1] is not None and a[1] <= now]:
                waiting.remove(a)
                out.append((*key, "timeout", pd.Timestamp(a[1], unit="us")))
        else:
            rows = pd.concat(list(frames)).sort_values("at")
            micros = lambda t: None if pd.isna(t) else int(t.value // 1000)
            for r in rows.itertuples():
                (waiting.append([micros(r.at), micros(r.timeout_at)]) if r.kind == "await" else mailbox.append([micros(r.at)]))
            settle()
        if waiting or mailbox:
            state.update(([tuple(w) for w in waiting], [tuple(m) for m in mailbox]))
            deadlines = [w[1] for w in waiting if w[1] is not None]
            if deadlines:
                state.setTimeoutTimestamp(max(min(deadlines) // 1000, state.getCurrentWatermarkMs() + 1))
        else:
            state.remove()
        yield pd.DataFrame(out, columns=["run_id", "name", "winner", "at"])

    kept = "waiting array<struct<at:long,until:long>>, mailbox array<struct<at:long>>"
    return stream.groupBy("run_id", "name").applyInPandasWithState(race, RACE, kept, "append", GroupStateTimeout.EventTimeTimeout)


def due_timers(timers: DataFrame, as_of: str, window_ms: int = 60_000) -> DataFrame:
    """A micro-batch of timers: those that are due, and those of the near window with what is left to wait."""
    now = moment(as_of)
    left = F.greatest(F.lit(0).cast("long"), F.timestamp_diff("MILLISECOND", now, F.col("fires_at")))
    return timers.where(~F.col("fired")).withColumn("wait_ms", left).where(F.col("wait_ms") <= window_ms)


def timer_retries(timers: DataFrame, runs: DataFrame, as_of: str, batch: int = 100, refresh_ms: int = 60_000) -> DataFrame:
    """id, run_id, retry_at of due timers that a batch does not fire. A batch that is not full has taken all that
    can be claimed: the others, whose runs nobody leads, wait for the next refresh. Behind a full batch they are
    tried again at once."""
    now = moment(as_of)
    claimed = transitions.fire_timers(timers, runs, as_of, batch).select("id")
    spare = claimed.agg((F.count(F.lit(1)) < batch).alias("_spare"))
    left = timers.where(~F.col("fired") & (F.col("fires_at") <= now)).join(claimed, "id", "left_anti").join(spare)  # one row
    return left.select("id", "run_id", F.when(F.col("_spare"), after(now, refresh_ms)).otherwise(now).alias("retry_at"))


def catch_up(local: DataFrame, runs: DataFrame, signals: DataFrame, as_of: str, page: int = 500) -> tuple[DataFrame, DataFrame]:
    """(runs to wake, one row of totals) of the runs that a local engine leads (ids in local): those that a signal
    or their time should have woken. Pages are counted, not walked; the scan is one join."""
    mine = local.select("id").distinct()
    found = transitions.wake_evidence(runs.join(mine, "id", "left_semi"), signals, as_of)
    scanned = mine.agg(F.count(F.lit(1)).alias("scanned"), F.ceil(F.count(F.lit(1)) / page).alias("pages"))
    return found, scanned.join(transitions.wake_totals(found).withColumnRenamed("runs", "matched"))  # a row each


def catching_up(local: DataFrame, read: Callable[[str], DataFrame], clock: Callable[[], str], wake: Callable[[DataFrame, DataFrame], None]) -> DataStreamWriter:
    """A stream of ids of led runs: each micro-batch reads runs and signals anew and hands what it finds, and the
    totals, to wake. A batch may come again after a failure, so waking has to bear that."""
    return local.writeStream.foreachBatch(lambda batch, _: wake(*catch_up(batch, read("runs"), read("signals"), clock())))


TASK_LEASE = "task_id string, status string, at timestamp, next_at timestamp"


def task_leases(renewals: DataFrame, ttl_ms: int = 30_000, renew_ms: int = 10_000) -> DataFrame:
    """renewals (task_id, at, result: ok, error or miss) with event time `at` and a watermark. held after a renewal
    (next one in renew_ms), retry after an error (sooner; the lease goes on), lost after a miss, which is final:
    what comes within the ttl behind it is left out. expired, once, where the last lease ran out unrenewed."""
    soon = max(renew_ms // 4, 250)
    stamp = lambda ms: pd.Timestamp(ms, unit="ms")

    def renew(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lost, until = state.get if state.exists else (False, None)
        out = []
        if state.hasTimedOut:
            if not lost:
                out.append((*key, "expired", stamp(until), None))
            state.remove()
        else:
            for r in pd.concat(list(frames)).sort_values("at", kind="stable").itertuples():
                at = int(r.at.value // 1_000_000)
                if lost:
                    continue
                if r.result == "miss":
                    lost, until = True, at + ttl_ms
                    out.append((*key, "lost", stamp(at), None))
                elif r.result == "ok":
                    until = at + ttl_ms
                    out.append((*key, "held", stamp(at), stamp(at + renew_ms)))
                else:
                    until = until if until is not None else at + ttl_ms
                    out.append((*key, "retry", stamp(at), stamp(at + soon)))
            state.update((lost, until))
            state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["task_id", "status", "at", "next_at"]).astype({"at": "datetime64[us]", "next_at": "datetime64[us]"})

    return renewals.groupBy("task_id").applyInPandasWithState(renew, TASK_LEASE, "lost boolean, until long", "append", GroupStateTimeout.EventTimeTimeout)


def lease_epochs(heartbeats: DataFrame, ttl: str = "30 seconds") -> DataFrame:
    """owner, first and last beat, beats of each unbroken time of ownership; a gap of the ttl ends one."""
    return heartbeats.groupBy("run_id", "owner", F.session_window("at", ttl).alias("w")).agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count(F.lit(1)).alias("beats")).drop("w")


def event_counters(events: DataFrame) -> DataFrame:
    """A stream's events per run so far, from which snapshots are triggered."""
    return events.groupBy("run_id").agg(F.count(F.lit(1)).alias("events"), F.max("seq").alias("through_seq"))
