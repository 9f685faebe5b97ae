"""Chains of continued runs and trees of child runs.

Whole-table traversals double the length of the paths they know in each round (pointer jumping), so the number
of joins follows the logarithm of the longest chain. Chains of continued runs and of parents are followed to
their ends however long they are; descendants have the bound that the caller gives, and what it cuts is told."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.sources.schemas import TERMINAL
from tideline.sources.store import delete, materialised


def _followed(pairs: DataFrame) -> DataFrame:
    """node, at, depth: where each node's path of links (node, at) ends, and after how many links. Each round is
    written to the shared folder, and rounds go on until no path is open. Closed paths leave the join, so that
    the many nodes of one long chain never meet at its end."""
    spark = pairs.sparkSession
    start = pairs.withColumn("ended", F.col("at") == F.col("node"))
    path, where = materialised(start.select("node", "at", F.when(F.col("ended"), 0).otherwise(1).cast("long").alias("depth"), "ended"), "chains")
    reach, nodes = 1, None
    while path.where("NOT ended").limit(1).count():
        nodes = path.count() if nodes is None else nodes
        if reach > nodes:
            delete(spark, where)
            raise ValueError("runs form a cycle")
        onward = path.select(F.col("node").alias("at"), F.col("at").alias("far"), F.col("depth").alias("more"), F.col("ended").alias("over"))
        moved = path.where("NOT ended").join(onward, "at").select("node", F.col("far").alias("at"), (F.col("depth") + F.col("more")).alias("depth"), F.col("over").alias("ended"))
        longer, there = materialised(moved.unionByName(path.where("ended")), "chains")
        delete(spark, where)
        path, where, reach = longer, there, reach * 2
    return path.drop("ended")


def chain_tips(runs: DataFrame) -> DataFrame:
    """id, tip_id, depth: the run that each run's continuations lead to, however many they are. Of several
    successors those count that lead deepest, of equally deep tips the largest id. Continuations in a circle
    are an error.

    Runs are first followed to where their chain ends or branches. Branches are decided from the deepest up, in
    as many rounds as branches lie behind one another; without branches there is none."""
    link = runs.where("continued_from_run_id IS NOT NULL").select(F.col("continued_from_run_id").alias("node"), F.col("id").alias("next"))
    after = link.groupBy("node").agg(F.min("next").alias("next"), F.count(F.lit(1)).alias("n"))
    linked = runs.select(F.col("id").alias("node")).join(after, "node", "left")
    path = _followed(linked.select("node", F.when(F.col("n") == 1, F.col("next")).otherwise(F.col("node")).alias("at")))
    forks = after.where("n > 1").select("node").join(runs.select(F.col("id").alias("node")), "node", "left_semi")
    total = forks.count()
    if total:
        ways, _ = materialised(link.join(forks, "node").join(path.withColumnRenamed("node", "next"), "next").join(forks.select(F.col("node").alias("at"), F.lit(True).alias("fork")), "at", "left").select("node", "at", "depth", "fork"), "chain-forks")
        decided, _ = materialised(forks.limit(0).select(F.col("node").alias("at"), F.lit(0).cast("long").alias("more"), F.col("node").alias("tip")), "chain-decided")
        while (before := decided.count()) < total:
            seen = ways.join(decided, "at", "left")
            open_one = F.col("fork").isNotNull() & F.col("tip").isNull()
            best = F.max(F.struct((F.col("depth") + 1 + F.coalesce("more", F.lit(0))).alias("more"), F.coalesce("tip", "at").alias("tip"))).alias("best")
            decided, _ = materialised(seen.groupBy("node").agg(F.bool_or(open_one).alias("open"), best).where("NOT open").select(F.col("node").alias("at"), "best.more", "best.tip"), "chain-decided")
            if decided.count() == before:
                raise ValueError("runs form a cycle")
        path = path.join(decided, "at", "left").select("node", F.coalesce("tip", "at").alias("at"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
    return path.select(F.col("node").alias("id"), F.col("at").alias("tip_id"), "depth")


def tip_of(runs: DataFrame, run_id: str) -> DataFrame:
    """The tip of one chain: of runs that continue from it the deepest; if the run itself is gone, of the tips
    of its correlation group. Ties go to the larger id."""
    tips = chain_tips(runs)
    rooted = tips.where(F.col("id") == run_id).select(F.lit(1).alias("rooted"), "depth", F.col("tip_id").alias("id"))
    ended = runs.where(F.col("correlation_id") == run_id).join(runs.select(F.col("continued_from_run_id").alias("id")), "id", "left_anti")
    fallback = ended.select(F.lit(0).alias("rooted"), F.lit(0).cast("long").alias("depth"), "id")
    return rooted.unionByName(fallback).orderBy(F.desc("rooted"), F.desc("depth"), F.desc("id")).limit(1).select("id")


def group_tips(runs: DataFrame) -> DataFrame:
    """correlation_id, id of runs without a successor."""
    return runs.join(runs.select(F.col("continued_from_run_id").alias("id")), "id", "left_anti").where("correlation_id IS NOT NULL").select("correlation_id", "id")


def ancestor_depth(runs: DataFrame) -> DataFrame:
    """id, depth: how many parents are above each run, however many they are; parents in a circle are an error."""
    parent = runs.select(F.col("id").alias("node"), "parent_run_id").join(runs.select(F.col("id").alias("parent_run_id"), F.lit(True).alias("there")), "parent_run_id", "left")
    links = parent.select("node", F.when(F.col("there"), F.col("parent_run_id")).otherwise(F.col("node")).alias("at"))
    return _followed(links).select(F.col("node").alias("id"), "depth")


def descendants(runs: DataFrame, roots: DataFrame, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """(root_id, id, depth of all descendants down to `most` generations; root_id of those that have more).
    Each generation is one join on the parent."""
    link = runs.where("parent_run_id IS NOT NULL").select(F.col("parent_run_id").alias("parent"), F.col("id").alias("child"))
    level = roots.select(F.col("id").alias("root_id"), F.col("id").alias("parent"))
    found = None
    for depth in range(1, most + 2):
        level = level.join(link, "parent").select("root_id", F.col("child").alias("parent"))
        if depth <= most:
            rows = level.select("root_id", F.col("parent").alias("id"), F.lit(depth).cast("long").alias("depth"))
            found = rows if found is None else found.unionByName(rows)
    return found, level.select("root_id").distinct()


def children_outcomes(runs: DataFrame) -> DataFrame:
    """parent_run_id, child_run_id, tip_id, outcome of every child: completed, failed, cancelled or pending, as
    the tip of the child's chain has it."""
    child = runs.where("parent_run_id IS NOT NULL AND continued_from_run_id IS NULL").select("parent_run_id", F.col("id").alias("child_run_id"))
    tips = chain_tips(runs).select(F.col("id").alias("child_run_id"), "tip_id")
    state = runs.select(F.col("id").alias("tip_id"), "state")
    outcome = F.when(F.col("state").isin(*TERMINAL), F.col("state")).otherwise("pending")
    return child.join(tips, "child_run_id").join(state, "tip_id").select("parent_run_id", "child_run_id", "tip_id", outcome.alias("outcome"))


def guarded_tip(runs: DataFrame, run_id: str, namespace: str | None) -> DataFrame:
    """The tip of a run's chain if it lies in the namespace; a wrong namespace looks like a missing run."""
    tip = runs.join(tip_of(runs, run_id), "id", "left_semi")
    return tip if namespace is None else tip.where(F.coalesce("namespace", F.lit("default")) == namespace)
