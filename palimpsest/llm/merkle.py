"""Merkle manifest of a table: a tree of hashes over the rows of each group, and one over the groups.

Spark numbers the leaves of a group and deals them to aligned blocks of 4096
leaves, each a whole subtree. Level queries in DuckDB reduce a block to its root:
an ordered string_agg of every run of FANOUT nodes, and sha256 of it. The roots of
blocks are leaves of the tree above and go the same way, until a group has one. Then
the path down: a block gets its own path from Spark, and a query adds each leaf's.
"""

from __future__ import annotations

from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import materialize, materialize_with, trim, trimmed

FANOUT = 8
LEVELS = 4  # of a block's subtree: 4096 leaves
DIGEST = 64  # characters of a digest

STEPS = T.ArrayType(T.StructType([T.StructField("before", T.StringType()), T.StructField("after", T.StringType())]))


def framed(value: Column) -> Column:
    """A value as it goes into a leaf: `-` if null, else its number of UTF-8 bytes, `:` and itself; integers in decimal."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*[framed(v) for v in values]), 256)


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its path give: at each step it stands between what is before and after it in its run."""
    return F.aggregate(steps, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def siblings_hash(steps: Column) -> Column:
    """The hash of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """`rows` with `idx`, the place of a row in its group, and `n`, the rows of the group; `group` is never null.

    The rows are sorted over all tasks by group and order, so a large group takes
    many. What each task holds of a group is counted, and a running sum over these
    counts gives the places. Rows that are equal in all of `order` come in any order.
    """
    spread = materialize(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id()))
    spread = spread.withColumn("_task", F.shiftright("_at", 33))
    counts = spread.groupBy(F.col(group).alias("_g"), F.col("_task").alias("_t")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_c"))
    by = W.partitionBy("_g")
    before = F.coalesce(F.sum("_c").over(by.orderBy("_t").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = materialize(counts.select("_g", "_t", (before - F.col("_first")).alias("_shift"), F.sum("_c").over(by).alias("n")))
    placed = spread.join(counts, (F.col(group) == F.col("_g")) & (F.col("_task") == F.col("_t")))
    return placed.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("idx"), "n")


@lru_cache(maxsize=1)
def _db() -> duckdb.DuckDBPyConnection:
    return duckdb.connect(config={"threads": 1, "memory_limit": "256MB"})


def _depth(n: int, levels: int) -> int:
    """Levels of the subtree of a block in a group of n nodes: all, unless the block is the group."""
    d = 0
    while d < levels and FANOUT**d < n:
        d += 1
    return d


def _levels(table: pa.Table, levels: int) -> int:
    """Fills the tables level0, level1 and so on with the nodes (i, h) of a block, and gives the number of the last."""
    db = _db()
    db.register("block_arrow", table.select(["idx", "hash"]))
    db.execute(f"create or replace temp table level0 as select idx % {FANOUT**levels} i, hash h from block_arrow").fetchall()
    db.unregister("block_arrow")
    depth = _depth(table.column("n")[0].as_py(), levels)
    for k in range(1, depth + 1):
        db.execute(f"create or replace temp table level{k} as select *, sha256(run) h from (select i // {FANOUT} i, string_agg(h, '' order by i) run from level{k - 1} group by 1)").fetchall()
    return depth


def _block_root(levels: int):
    def run(table: pa.Table) -> pa.Table:
        depth = _levels(table, levels)
        root = _db().execute(f"select h from level{depth}").fetchall()[0][0]
        g, idx, n = (table.column(c)[0].as_py() for c in ("g", "idx", "n"))
        return pa.table({"g": [g], "idx": [idx // FANOUT**levels], "n": [-(-n // FANOUT**levels)], "hash": [root]})

    return run


_STEP = pa.struct([("before", pa.string()), ("after", pa.string())])


def _paths(columns: list[str], levels: int):
    """For a block and the path of its root: `columns` of its nodes, their paths, and the roots that the block's row has."""

    def run(nodes: pa.Table, above: pa.Table) -> pa.Table:
        depth, n = _levels(nodes, levels), nodes.num_rows
        nodes = nodes.sort_by("idx")
        place = lambda k: f"{DIGEST} * (a.i // {FANOUT ** (k - 1)} % {FANOUT})"
        steps = "".join(f", {{'before': substr(l{k}.run, 1, {place(k)}), 'after': substr(l{k}.run, {place(k)} + {DIGEST + 1})}} s{k}" for k in range(1, depth + 1))
        joins = "".join(f" join level{k} l{k} on l{k}.i = a.i // {FANOUT**k}" for k in range(1, depth + 1))
        got = _db().sql(f"select a.i{steps} from level0 a{joins} order by a.i").to_arrow_table()
        outer = pa.array(above.column("steps")[0].as_py(), _STEP)
        # level by level, then the steps of the block's root: taken in the order of the nodes
        flat = pa.concat_arrays([*[got.column(f"s{k}").cast(_STEP).combine_chunks() for k in range(1, depth + 1)], outer])
        at = np.hstack([np.arange(depth) * n + np.arange(n)[:, None], np.broadcast_to(depth * n + np.arange(len(outer)), (n, len(outer)))])
        paths = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * at.shape[1], pa.int32()), flat.take(pa.array(at.ravel())))
        roots = {c: pa.array([above.column(c)[0].as_py()] * n, pa.string()) for c in ("subroot", "root")}
        out = pa.table({c: nodes.column(c) for c in columns} | {"steps": paths} | roots)
        trim()
        return out

    return run


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("b", F.shiftright("idx", 3 * levels))


def _up(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """The nodes (g, idx, n, hash), the roots of their blocks, the roots of these roots' blocks and so on; the last table has one row a group."""
    tables, most = [nodes], None
    while most is None or most > 1:
        blocks = _blocks(tables[-1].select("g", "idx", "n", "hash"), levels).groupBy("g", "b")
        roots, (most,) = materialize_with(blocks.applyInArrow(trimmed(_block_root(levels)), "g string, idx long, n long, hash string"), F.coalesce(F.max("n"), F.lit(0)))
        tables.append(roots)
    return tables


def _down(tables: list[DataFrame], tops: DataFrame, payload: T.StructType, levels: int) -> DataFrame:
    """`payload` columns of the first of `tables`, steps, subroot, root; tops has (g, steps, subroot, root) of each group."""
    above = tables[-1].select("g", F.lit(0).cast("long").alias("b")).join(tops, "g")
    for k in range(len(tables) - 2, -1, -1):
        fields = [*payload.fields] if k == 0 else [T.StructField("g", T.StringType()), T.StructField("idx", T.LongType())]
        schema = T.StructType([*fields, T.StructField("steps", STEPS), T.StructField("subroot", T.StringType()), T.StructField("root", T.StringType())])
        nodes = tables[k].select(*dict.fromkeys(["g", "idx", "n", "hash", *[f.name for f in fields]]))
        above = _blocks(nodes, levels).groupBy("g", "b").cogroup(above.groupBy("g", "b")).applyInArrow(_paths([f.name for f in fields], levels), schema)
        if k:
            above = materialize(above.withColumnRenamed("idx", "b"))
    return above


def manifest(leaves: DataFrame, group: str, key: str, leaf: str = "leaf", levels: int = LEVELS) -> DataFrame:
    """All columns of `leaves` with subroot, root and proof.

    In each group the leaves ascend by key; while there are several nodes, every
    FANOUT neighbours become their hash, and so do the groups' roots in byte order of
    the groups. `proof` has the siblings of each level as struct(before, after), and
    fold(leaf, proof) gives the root. Nulls: a null group is a group of its own, the
    first; rows without a key come before others, those without a leaf are left out.
    Rows of one key are ordered by their leaves, and equal ones are separate leaves.
    An empty table has no rows and no root. Columns named subroot, root or proof are
    replaced; others may have any name. Rows are dealt in blocks of FANOUT ** levels, so a
    group of any size never meets in a task; what a leaf was made from is hashed once, where it lies.
    """
    kept = [c for c in leaves.columns if c not in ("subroot", "root", "proof")]
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    stored = materialize(leaves.where(F.col(leaf).isNotNull()).select(F.struct(*kept).alias("row"), name.alias("g"), F.col(key).alias("k"), F.col(leaf).alias("hash")))
    nodes = numbered(stored.withColumn("id", F.monotonically_increasing_id()), "g", "k", "hash", "id").select("g", "idx", "n", "hash", "row")
    tables = _up(nodes, levels)
    groups = numbered(tables[-1].select(F.lit("").alias("all"), F.col("g").alias("name"), "hash"), "all", "name").select(F.col("all").alias("g"), "idx", "n", "hash", "name")
    over = _up(groups, levels)
    root = over[-1].select("g", F.array().cast(STEPS).alias("steps"), F.lit("").alias("subroot"), F.col("hash").alias("root"))
    tops = _down(over, root, T.StructType([groups.schema["name"], groups.schema["hash"]]), levels)
    tops = materialize(tops.select(F.col("name").alias("g"), "steps", F.col("hash").alias("subroot"), "root"))
    return _down(tables, tops, T.StructType([nodes.schema["row"]]), levels).select("row.*", "subroot", "root", F.col("steps").alias("proof"))
