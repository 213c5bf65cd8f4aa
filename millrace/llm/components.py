"""Connected components by alternating large-star and small-star rounds, as joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _minimum(edges: DataFrame) -> DataFrame:
    """For each ``u``: the smallest of u and its neighbours. Map-side combined, so a hub is no hot task."""
    return edges.groupBy("u").agg(F.min("v").alias("lo")).select("u", F.least("u", "lo").alias("m"))


def _large_star(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """New edges, and the table of minima they read. That is written first: a join of two plain shuffles is one whose
    large keys adaptive execution can split, which a join on top of an aggregate is not."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = scratch.keep(_minimum(both), "minima")
    new = (
        both.join(low, "u")
        .filter("v > u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .filter("u <> v")
        .distinct()
    )
    return new, low


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges to smaller nodes only: a hub is small, so its edges lie with their other ends."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _minimum(down)
    return (
        down.join(low, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(low.select("u", F.col("m").alias("v")))
        .filter("u <> v")
        .distinct()
    )


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``: component is the smallest node reachable.

    Null ends and loops are ignored; an empty table gives an empty result. Each round is written to the
    shared folder, which cuts lineage. Stops when a round changes nothing.
    """
    cur = scratch.keep(
        edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).filter("u <> v").distinct(),
        "edges",
    )
    mark = None
    for _ in range(rounds):
        large, low = _large_star(cur, scratch)
        new = scratch.keep(_small_star(large), "round")
        scratch.drop(cur)
        scratch.drop(low)
        cur = new
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
