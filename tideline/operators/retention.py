"""Retention: logical chains, what may be pruned or archived, and monthly partitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.scalars import moment, month_label
from tideline.sources.schemas import NON_TERMINAL, TERMINAL

HISTORY_TABLES = ("events", "tasks", "attempts", "operations", "signals", "timers", "snapshots")
IDEMPOTENCY_TABLES = ("results", "ingress_keys")


def _logical() -> Column:
    return F.coalesce("correlation_id", "id").alias("logical_id")


def _conditions(as_of: str, older_than_days: int) -> list[Column]:
    """Oldest and newest completion of a chain, and four conditions over all its members."""
    now = moment(as_of)
    cutoff = now - F.make_dt_interval(days=F.lit(older_than_days))
    return [
        F.min("completed_at").alias("oldest_completed_at"),
        F.max("completed_at").alias("newest_completed_at"),
        F.bool_and(F.col("state").isin(*TERMINAL)).alias("terminal"),
        F.bool_and(F.col("completed_at").isNotNull()).alias("completed"),
        F.bool_and(F.col("retention_until").isNotNull() & (F.col("retention_until") < now)).alias("expired"),
        F.bool_and(F.col("completed_at") < cutoff).alias("older"),
    ]


def _members() -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("started_at", "id"))), lambda x: x["id"]).alias("run_ids")


def chain_stats(runs: DataFrame, as_of: str, older_than_days: int = 0) -> DataFrame:
    """logical_id, run_ids (in start order), oldest and newest completion, and four conditions over all members.
    The result lists each chain's members, so they are gathered per chain."""
    return runs.groupBy(_logical()).agg(_members(), *_conditions(as_of, older_than_days))


def prunable(runs: DataFrame, as_of: str, older_than_days: int = 0, batch: int | None = 100) -> DataFrame:
    """Chains that may go, the oldest first. A chain stays while any run is a child of one of its members; the
    parent is resolved to its chain, so that the test is a join on one key. Sums that start before the shuffle
    decide; members are gathered only for the chains of the result."""
    stats = runs.groupBy(_logical()).agg(*_conditions(as_of, older_than_days)).where("terminal AND completed AND expired AND older")
    logical = runs.select(F.col("id").alias("parent_run_id"), _logical())
    parents = runs.where("parent_run_id IS NOT NULL").select("parent_run_id").join(logical, "parent_run_id").select("logical_id").distinct()
    out = stats.join(parents, "logical_id", "left_anti").select("logical_id", "oldest_completed_at", "newest_completed_at")
    if batch is not None:
        out = out.orderBy("oldest_completed_at", "logical_id").limit(min(batch, 1000))
    own = runs.select(_logical(), "started_at", "id").join(out.select("logical_id"), "logical_id", "left_semi")
    listed = out.join(own.groupBy("logical_id").agg(_members()), "logical_id").select("logical_id", "run_ids", "oldest_completed_at", "newest_completed_at")
    return listed if batch is None else listed.orderBy("oldest_completed_at", "logical_id")


def dependents(chains: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, rows: how many rows of each table belong to the chains' runs."""
    ids = chains.select(F.explode("run_ids").alias("run_id"))
    counts = [t.join(ids, "run_id", "left_semi").agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows")) for name, t in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def prune(runs: DataFrame, tables: dict[str, DataFrame], plan: DataFrame, as_of: str, older_than_days: int = 0, with_idempotency: bool = False) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """(runs left, tables left, logical_id and outcome of each planned chain). The plan is made anew first: a
    chain whose members changed is kept as plan_changed, one that got a child as child_lineage_changed."""
    now = prunable(runs, as_of, older_than_days, None).select("logical_id", F.col("run_ids").alias("now_ids"))
    stats = chain_stats(runs, as_of, older_than_days).select("logical_id", F.col("run_ids").alias("members"), (F.col("terminal") & F.col("completed") & F.col("expired") & F.col("older")).alias("ready"))
    checked = plan.select("logical_id", "run_ids").join(now, "logical_id", "left").join(stats, "logical_id", "left")
    outcome = F.when(F.col("members").isNull() | ~F.col("ready") | (F.col("members") != F.col("run_ids")), "plan_changed").when(F.col("now_ids").isNull(), "child_lineage_changed").otherwise("pruned")
    checked = checked.withColumn("outcome", outcome)
    gone = checked.where("outcome = 'pruned'").select(F.explode("run_ids").alias("run_id"))
    names = (*HISTORY_TABLES, *(IDEMPOTENCY_TABLES if with_idempotency else ()))
    left = {n: t.join(gone, "run_id", "left_anti") if n in names and "run_id" in t.columns else t for n, t in tables.items()}
    return runs.join(gone.withColumnRenamed("run_id", "id"), "id", "left_anti"), left, checked.select("logical_id", "outcome")


def archivable(runs: DataFrame, as_of: str, days: int = 0) -> DataFrame:
    """Completed runs that have a successor, are past retention, and whose group has no member with an active
    parent. A run without a correlation is in no group, so nothing holds it back."""
    now = moment(as_of)
    done = runs.where((F.col("state") == "completed") & (F.col("completed_at") < now - F.make_dt_interval(days=F.lit(days))) & (F.col("retention_until") < now))
    followed = done.join(runs.select(F.col("continued_from_run_id").alias("id")), "id", "left_semi")
    active = runs.where(F.col("state").isin(*NON_TERMINAL)).select(F.col("id").alias("parent_run_id"))
    held = runs.join(active, "parent_run_id", "left_semi").where("correlation_id IS NOT NULL").select("correlation_id").distinct()
    return followed.join(held, "correlation_id", "left_anti").select("id", "correlation_id", "completed_at")


def in_archive_order(rows: DataFrame) -> DataFrame:
    """Archivable runs for display: by group, and in each as they ended."""
    return rows.orderBy("correlation_id", "completed_at", "id")


def archive(runs: DataFrame, as_of: str, days: int = 0) -> DataFrame:
    """The runs that stay."""
    return runs.join(archivable(runs, as_of, days).select("id"), "id", "left_anti")


def partition_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(month_label("inserted_at").alias("month")).agg(F.count(F.lit(1)).alias("rows"))


def droppable_partitions(events: DataFrame, runs: DataFrame, as_of: str) -> DataFrame:
    """month, rows, droppable: no event belongs to a run that is within retention. Events whose run is gone do
    not hold a month back. Rows are summed per month and run before the join."""
    by_run = events.groupBy(month_label("inserted_at").alias("month"), "run_id").agg(F.count(F.lit(1)).alias("n"))
    kept = F.col("retention_until").isNull() | (F.col("retention_until") >= moment(as_of))
    owner = runs.select(F.col("id").alias("run_id"), kept.alias("kept"))
    joined = by_run.join(owner, "run_id", "left")
    return joined.groupBy("month").agg(F.sum("n").alias("rows"), (~F.bool_or(F.coalesce("kept", F.lit(False)))).alias("droppable"))
