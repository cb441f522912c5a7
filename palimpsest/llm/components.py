"""Connected components over an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import materialize, materialize_with, narrow


def _large_star(e: DataFrame, rows: int) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    low = materialize(narrow(low, rows))  # apart, so that a hub's rows can be split
    return narrow(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), rows)


def _small_star(e: DataFrame, rows: int) -> DataFrame:
    """Edges have u > v, a node few of them: what the large star leaves."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    hooked = e.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return narrow(low.select("u", F.col("m").alias("v")).union(hooked), rows)


def _written(e: DataFrame) -> tuple[DataFrame, tuple]:
    """`e` in the shared folder, its number of edges, and a sum over them that shows whether it changed."""
    return materialize_with(e, F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))


def connected_components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, component): each node of an edge (u, v) with the smallest node it can reach.

    Self-loops and repeated edges are allowed; an empty table gives none. `rows`
    is about the number of edges; it is counted if not given. Rounds are
    logarithmic in the size of the largest component; every round is written to
    the shared folder, which ends its lineage.
    """
    rows = edges.count() if rows is None else rows
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, state = _written(narrow(e, rows))
    while state[0]:
        large = materialize(_large_star(e, 2 * state[0]))
        e, new = _written(narrow(_small_star(large, 2 * state[0]).distinct(), state[0]))
        if new == state:
            break
        state = new
    low = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))  # e is in files by now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(narrow(low, state[0]))
