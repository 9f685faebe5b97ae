"""Connected components of a link table, by joins and sums only.

Each round ties the larger neighbours of every node to its smallest one (large star), then the smaller ones
(small star), until nothing changes; the number of rounds grows with the logarithm of the longest chain. The
smallest neighbour of a node is a sum that starts before the shuffle, so a node with many links is no hot key
there, and the join that spreads it can be split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import Scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected(links: DataFrame, name: str) -> DataFrame:
    """node, comp for each node of links (a, b longs): comp is the smallest node that is reachable. Loops and
    repeated links count once; without links the result is empty. A round's table replaces the one before."""
    work = Scratch(links.sparkSession)
    ordered = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = work.keep(ordered, f"{name}-edges")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        #: Every row now points from a node to a smaller one.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(low, "a")
        small = tied.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        edges = work.keep(small, f"{name}-edges")
        if (now := _state(edges)) == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def relabelled(df: DataFrame, labels: DataFrame, column: str, into: str) -> DataFrame:
    """df with the component of a column's node; nodes without links are their own."""
    named = labels.select(F.col("node").alias(column), F.col("comp").alias("_comp"))
    return df.join(named, column, "left").withColumn(into, F.coalesce("_comp", column)).drop("_comp")
