"""Workflow versions: which are required, registered, loaded, missing, or no longer needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.sources.schemas import NON_TERMINAL

KEY = ["workflow", "version_hash"]


def required(runs: DataFrame) -> DataFrame:
    """workflow, version_hash, runs, oldest_started_at of runs that have not ended."""
    return runs.where(F.col("state").isin(*NON_TERMINAL)).groupBy(*KEY).agg(F.count(F.lit(1)).alias("runs"), F.min("started_at").alias("oldest_started_at"))


def preflight(runs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Required versions with the status loaded or missing."""
    there = manifest.select(*KEY).distinct().withColumn("there", F.lit(True))
    return required(runs).join(there, KEY, "left").withColumn("status", F.when(F.col("there"), "loaded").otherwise("missing")).drop("there")


def differences(loaded: DataFrame, durable: DataFrame) -> DataFrame:
    """workflow, version_hash, side of versions that only one side has."""
    a, b = loaded.select(*KEY).distinct(), durable.select(*KEY).distinct()
    return a.join(b, KEY, "left_anti").withColumn("side", F.lit("loaded_only")).unionByName(b.join(a, KEY, "left_anti").withColumn("side", F.lit("durable_only")))


def collectable(versions: DataFrame, loaded: DataFrame, runs: DataFrame) -> DataFrame:
    """Registered versions that are not loaded and that no unfinished run needs; workflows of which nothing is
    loaded are left alone."""
    pinned = runs.where(F.col("state").isin(*NON_TERMINAL)).select(*KEY).distinct()
    known = versions.join(loaded.select("workflow"), "workflow", "left_semi")
    return known.join(loaded.select(*KEY), KEY, "left_anti").join(pinned, KEY, "left_anti").select(*KEY)


def patch_audit(runs: DataFrame, events: DataFrame, sites: DataFrame) -> DataFrame:
    """For each patch site (workflow, version_hash, name, command_base): runs of that version that have not ended
    and lack its marker, when the marker was first seen, and the verdict. A marker's command id is the site's
    with the use's number behind the last slash."""
    open_runs = runs.where(F.col("state").isin(*NON_TERMINAL)).select(F.col("id").alias("run_id"), *KEY)
    base = F.regexp_extract("command_id", r"^(.*)/\d+$", 1)
    markers = events.where("event_type = 'patched' AND command_id IS NOT NULL").groupBy("run_id", base.alias("command_base")).agg(F.min("inserted_at").alias("seen"))
    pairs = sites.join(open_runs, KEY, "left").join(markers, ["run_id", "command_base"], "left")
    out = pairs.groupBy(*KEY, "name").agg(F.count_if(F.col("run_id").isNotNull() & F.col("seen").isNull()).alias("in_flight_pre_patch"), F.min("seen").alias("first_seen_at"))
    return out.withColumn("verdict", F.when(F.col("in_flight_pre_patch") == 0, "safe-to-remove").otherwise("still-in-use"))


def stuck(runs: DataFrame) -> DataFrame:
    return runs.where("state = 'stuck_unknown_version'").agg(F.count(F.lit(1)).alias("stuck_runs"))


def recoverable(runs: DataFrame, versions: DataFrame) -> DataFrame:
    """Stuck runs whose version is registered now."""
    return runs.where("state = 'stuck_unknown_version'").join(versions.select(*KEY), KEY, "left_semi").select("id", *KEY)
