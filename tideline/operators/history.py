"""Reads and writes of event histories and of the tables that are written once for a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def history(events: DataFrame, run_id: str, after_seq: int | None = None) -> DataFrame:
    """Events of one run in order, after a sequence number if one is given."""
    out = events.where(F.col("run_id") == run_id)
    return (out if after_seq is None else out.where(F.col("seq") > after_seq)).orderBy("seq")


def event_at(events: DataFrame, run_id: str, seq: int) -> DataFrame:
    return events.where((F.col("run_id") == run_id) & (F.col("seq") == seq))


def event_page(events: DataFrame, run_id: str, after_seq: int | None = None, limit: int = 50) -> DataFrame:
    """A page of a run's events and one more row that tells whether another page follows."""
    n = min(limit, 100) if isinstance(limit, int) and limit > 0 else 50
    out = events.where(F.col("run_id") == run_id)
    if after_seq is not None:
        out = out.where(F.col("seq") > after_seq)
    return out.orderBy("seq", "inserted_at").limit(n + 1)


def tasks_of(tasks: DataFrame, run_id: str, limit: int = 100) -> DataFrame:
    return tasks.where(F.col("run_id") == run_id).orderBy("seq", "id").limit(limit)


def latest_snapshots(snapshots: DataFrame, supported: int = 1) -> DataFrame:
    """For each run its newest snapshot of a format that is understood. One whose steps do not parse counts as
    none."""
    newest = (
        snapshots.where(F.col("format_version") <= supported)
        .groupBy("run_id")
        .agg(F.max_by(F.struct("through_seq", "version_hash", "steps"), "through_seq").alias("s"))
    )
    return newest.select("run_id", "s.*").where(F.try_parse_json("steps").isNotNull())


def snapshot_and_tail(events: DataFrame, snapshots: DataFrame, supported: int = 1) -> DataFrame:
    """Events that the newest snapshot of their run does not cover, with its through_seq (null: none)."""
    newest = latest_snapshots(snapshots, supported).select("run_id", "through_seq")
    return events.join(newest, "run_id", "left").where(F.col("seq") > F.coalesce("through_seq", F.lit(-1)))


def next_seq(events: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id, next_seq: one more than the largest number of each run, 0 for runs without events."""
    largest = events.groupBy("run_id").agg((F.max("seq") + 1).alias("next_seq"))
    return runs.select(F.col("id").alias("run_id")).join(largest, "run_id", "left").withColumn("next_seq", F.coalesce("next_seq", F.lit(0).cast("long")))


def append(events: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """The new rows with numbers: given ones stay, the others follow the largest that their run has, in the
    history or among the given ones, in the given order."""
    largest = events.groupBy("run_id").agg(F.max("seq").alias("_last"))
    given = new.groupBy("run_id").agg(F.max("seq").alias("_given"))
    numbered = new.join(largest, "run_id", "left").join(given, "run_id", "left")
    place = F.row_number().over(Window.partitionBy("run_id", F.col("seq").isNull()).orderBy(*order))
    last = F.greatest(F.coalesce("_last", F.lit(-1)), F.coalesce("_given", F.lit(-1)))
    return numbered.withColumn("seq", F.coalesce("seq", last + place)).drop("_last", "_given")


def sequenced(events: DataFrame, order: list[str]) -> DataFrame:
    """Events numbered from 0 in each run."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy("run_id").orderBy(*order)).cast("long") - 1)


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows of new that are to be added: of equal keys the first in order, unless the key exists."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
    return first.join(existing.select(*keys), keys, "left_anti").select(*new.columns)


def insert_signals(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Signals to add: those without a delivery id always, of others one for each (correlation, name, delivery)."""
    keys = ["correlation_id", "name", "delivery_id"]
    named = insert_if_absent(existing.where("delivery_id IS NOT NULL"), new.where("delivery_id IS NOT NULL"), keys, ["inserted_at", "id"])
    return new.where("delivery_id IS NULL").unionByName(named)


def first_results(results: DataFrame) -> DataFrame:
    """The result of each (activity_module, idempotency_key) that was committed first."""
    first = F.min(F.struct("completed_at", "run_id", "seq")).alias("w")
    winners = results.where("idempotency_key IS NOT NULL").groupBy("activity_module", "idempotency_key").agg(first)
    return winners.select("activity_module", "idempotency_key", "w.completed_at", "w.run_id", "w.seq")


def result_of(results: DataFrame, module: str, key: str) -> DataFrame:
    return results.where((F.col("activity_module") == module) & (F.col("idempotency_key") == key))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows, those of new in place of existing ones with the same key."""
    return existing.join(new.select(*keys), keys, "left_anti").select(*existing.columns).unionByName(new.select(*existing.columns))


def timeline(events: DataFrame) -> DataFrame:
    from tideline.functions.scalars import event_kind

    return events.withColumn("kind", event_kind("event_type"))
