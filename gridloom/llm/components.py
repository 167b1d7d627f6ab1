"""Connected components by alternating large-star and small-star rounds, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import cut, release, scratch


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (columns a, b; any order, repeats and loops allowed).

    component is the least node reachable. Nodes without an edge to another are left out. Only aggregates and
    equi-joins are used, so a hub is summed before it is shuffled and its join can be split; nothing but a row count
    and a checksum reaches the driver, and a round's table goes when the next one is written. If `rounds` do not suffice
    (the rounds needed grow with the logarithm of the longest path), that is an error.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        # large-star: every larger neighbour of u goes to u's least neighbour (or u itself)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.where("v > u")
            .join(_least(both), "u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        # small-star: u's smaller neighbours and u itself go to the least of them
        least = _least(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        with scratch(edges.sparkSession):
            release(now)
            now = cut(small.distinct(), "edges", kept=True)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
