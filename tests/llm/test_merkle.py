"""Merkle manifests against a plain tree in Python."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import merkle, queries
from tests.conftest import DATA


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """The root and each node's path: (before, after) in its run, level by level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for path, i in zip(paths, at):
            run = level[i // 8 * 8 : i // 8 * 8 + 8]
            path.append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
        level = [H(*level[i : i + 8]) for i in range(0, len(level), 8)]
        at = [i // 8 for i in at]
    return level[0], paths


def manifest(rows):
    """rows (id, group, leaf) -> {(group, id, leaf): [(subroot, root, path)]}"""
    groups = {}
    for k, g, leaf in rows:
        groups.setdefault(g, []).append((k is not None, k, leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g])]) for g in names}
    root, above = tree([trees[g][0] for g in names])
    out = {}
    for g, over in zip(names, above):
        for (_, k, leaf), path in zip(sorted(groups[g]), trees[g][1]):
            out.setdefault((g, k, leaf), []).append((trees[g][0], root, path + over))
    return {k: sorted(v) for k, v in out.items()}


def spark_manifest(df, levels=merkle.LEVELS):
    out = {}
    for r in merkle.manifest(df, "lang", "doc_id", levels=levels).collect():
        out.setdefault((r.lang, r.doc_id, r.leaf), []).append((r.subroot, r.root, [tuple(s) for s in r.proof]))
    return {k: sorted(v) for k, v in out.items()}


LEAVES = "doc_id long, lang string, leaf string"


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 8}, {"a": 9, None: 1}, {"": 3, None: 65, "é": 64, "z": 1, "Z": 2}, {f"g{i}": i % 3 + 1 for i in range(70)}])
def test_trees_of_all_sizes(spark, sizes):
    r = random.Random(1)
    rows = [(r.randint(-999, 999), g, H(str(r.random()))) for g, n in sizes.items() for _ in range(n)]
    assert spark_manifest(spark.createDataFrame(rows, LEAVES)) == manifest(rows)


@pytest.mark.parametrize("levels", [1, 2])
def test_blocks_of_blocks_and_a_hot_group(spark, levels):
    """Small blocks, so that a group has several tables of blocks, and more of them than another."""
    rows = [(i * 7 % 701, "hot", H(str(i))) for i in range(700)] + [(i, "b", H("b", str(i))) for i in range(64)] + [(1, None, H("x"))]
    assert spark_manifest(spark.createDataFrame(rows, LEAVES), levels) == manifest(rows)


def test_blocks_of_the_real_size(spark):
    n = 9000
    df = spark.range(n).select("id", F.when(F.col("id") % 9 == 0, "b").otherwise("a").alias("lang"), F.sha2(F.col("id").cast("string"), 256).alias("leaf")).withColumnRenamed("id", "doc_id")
    rows = [(i, "b" if i % 9 == 0 else "a", H(str(i))) for i in range(n)]
    assert spark_manifest(df) == manifest(rows)


def test_repeated_rows_ties_nulls_and_clashing_names(spark):
    rows = [(1, "a", H("p")), (1, "a", H("p")), (1, "a", H("o")), (None, "a", H("n")), (None, None, H("m")), (2, "a", None)]
    df = spark.createDataFrame(rows, LEAVES)
    assert spark_manifest(df) == manifest(rows[:-1])
    clash = df.withColumns({c: F.lit(7) for c in ("g", "idx", "n", "hash", "k", "id", "row", "b", "steps", "root", "proof", "all", "name", "_g", "_at")})
    out = merkle.manifest(clash, "lang", "doc_id")
    assert out.where("g = 7 and steps = 7 and length(root) = 64").count() == 5
    assert merkle.manifest(df.limit(0), "lang", "doc_id").count() == 0


def test_fold_finds_every_change(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], H(str(i))) for i in range(100)], LEAVES)
    m = merkle.manifest(df, "lang", "doc_id")
    assert m.where(merkle.fold(F.col("leaf"), F.col("proof")) == F.col("root")).count() == 100
    assert m.where(merkle.fold(F.sha2("leaf", 256), F.col("proof")) == F.col("root")).count() == 0


def test_leaves_frame_their_values(spark):
    long = "é" * 300_000
    df = spark.createDataFrame([(1, None, "a:b"), (None, "", long)], "a long, b string, c string").select(merkle.leaf_hash(F.col("a"), F.col("b"), F.col("c")).alias("h"))
    assert [r.h for r in df.collect()] == [H("1:1", "-", "3:a:b"), H("-", "0:", "600000:", long)]


def test_query_against_a_plain_version(spark):
    docs = duckdb.sql(f"select doc_id, source, lang, n_chars, text from '{DATA}/documents.parquet'").fetchall()
    lower = lambda t: None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    framed = lambda *v: "".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in v)
    leaf = {d[0]: H(framed(*d)) for d in docs}
    want = manifest([(d[0], d[2], leaf[d[0]]) for d in docs])
    got = {r.doc_id: r for r in queries.QUERIES["op12_merkle_manifest"](spark, DATA).collect()}
    assert len(got) == len(docs) and not all(r.verified for r in got.values())
    for d in docs:
        (subroot, root, path), r = want[d[2], d[0], leaf[d[0]]][0], got[d[0]]
        spoilt = zlib.crc32(str(d[0]).encode()) % 3 == 0
        node = H(framed(*d[:4], lower(d[4]))) if spoilt else leaf[d[0]]
        for before, after in path:
            node = H(before, node, after)
        assert (r.leaf, r.subroot, r.root, r.folded_root) == (leaf[d[0]], subroot, root, node)
        assert r.proof_sha256 == H(*[x for s in path for x in s]) and r.verified == (node == root)
