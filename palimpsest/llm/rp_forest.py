"""Approximate nearest neighbours: random-projection trees, one priority queue over all of them, exact reranking."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import materialize

#: Rows of a tree that one task reads at a time: neighbouring leaves share a block, a larger leaf has several.
BLOCK_ROWS = 32_768


#: Queries that visit one copy of a block. A block goes out once for every so many visits, so what moves grows with the visits.
VISITS = 65_536
#: Queries of one vector that meet its hits in one task.
SHARERS = 65_536


@dataclass(frozen=True)
class ForestParams:
    trees: int = 4
    leaf_rows: int = 256  # wanted rows of a leaf
    sample: int = 20_000  # rows the trees are fitted on, at most
    recall: float = 0.95  # share of the sample's own neighbours that a query's leaves are to hold; sets how many leaves it reads
    trials: int = 200  # rows of the sample that this is measured with
    least_rows: int = 2048  # rows, counted in all trees, that a query reads at least
    seed: int = 7


class Forest:
    """Trees in arrays. A node projects on a direction and splits at a threshold; leaves have numbers of their own."""

    def __init__(self, sample: np.ndarray, rows: int, params: ForestParams):
        """Maximum inner product becomes nearest neighbour by one more component, which lifts each vector to the largest norm."""
        self.trees, self.lift = [], float(np.sqrt((sample**2).sum(1).max())) if len(sample) else 1.0
        rng = np.random.default_rng(params.seed)
        x = self.lifted(sample)
        depth = max(0, int(np.ceil(np.log2(max(rows, 1) / params.leaf_rows))))
        depth = min(depth, max(0, int(np.log2(max(len(sample), 1) / 8))))
        for _ in range(params.trees):
            direction, cut, child = [], [], []
            leaves = 0

            def grow(ids: np.ndarray, level: int) -> int:
                nonlocal leaves
                if level < depth and len(ids) >= 2:
                    a, b = rng.choice(ids, 2, replace=False)
                    d = x[a] - x[b]
                    norm = np.linalg.norm(d)
                    d = d / norm if norm > 0 else rng.standard_normal(x.shape[1])
                    at = x[ids] @ d
                    t = float(np.median(at))
                    right = at > t
                    if right.any() and not right.all():
                        me = len(cut)
                        direction.append(d), cut.append(t), child.append([0, 0])
                        child[me] = [grow(ids[~right], level + 1), grow(ids[right], level + 1)]
                        return me
                leaves += 1
                return -leaves

            root = grow(np.arange(len(x)), 0)
            self.trees.append((np.array(direction).reshape(-1, x.shape[1]), np.array(cut), np.array(child, np.int64).reshape(-1, 2), root))

    def lifted(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.lift**2 - (x**2).sum(1), 0))
        return np.hstack([x, more[:, None]])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """rows x trees: the leaf (from 0) of each vector."""
        x = self.lifted(x)
        out = np.empty((len(x), len(self.trees)), np.int64)
        for t, (d, cut, child, root) in enumerate(self.trees):
            node = np.full(len(x), root)
            while (inner := np.flatnonzero(node >= 0)).size:
                at = node[inner]
                side = ((x[inner] * d[at]).sum(1) > cut[at]).astype(np.int64)
                node[inner] = child[at, side]
            out[:, t] = -node - 1
        return out

    def search(self, q: np.ndarray, counts: list[np.ndarray], wanted: float) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of one queue over all trees, until the leaves hold `wanted` rows."""
        q = self.lifted(q[None], query=True)[0]
        scale = self.lift / (np.linalg.norm(q) or 1.0)
        margin = [(d @ q) * scale - cut for d, cut, _, _ in self.trees]
        queue = [(-np.inf, t, root) for t, (_, _, _, root) in enumerate(self.trees)]
        heapq.heapify(queue)
        found, have = [], 0.0
        while queue and have < wanted:
            near, t, node = heapq.heappop(queue)
            while node >= 0:
                m = margin[t][node]
                child = self.trees[t][2][node]
                heapq.heappush(queue, (max(near, abs(m)), t, int(child[0 if m > 0 else 1])))
                node = int(child[1 if m > 0 else 0])
            found.append((t, -node - 1))
            have += counts[t][-node - 1]
        return found


    def share(self, x: np.ndarray, k: int, params: ForestParams) -> float:
        """Rows to read, counted in all trees, as a share of all rows: what finds params.recall of the k best of rows of `x` among its rows."""
        leaves = self.leaves(x)
        counts = [np.bincount(leaves[:, t]) for t in range(leaves.shape[1])]
        at = []
        for i, q in enumerate(x[: params.trials]):
            s = x @ q
            s[i] = -np.inf
            best = np.argsort(-s, kind="stable")[: min(k, len(x) - 1)]
            order = self.search(q, counts, np.inf)
            read = dict(zip(order, np.cumsum([counts[t][f] for t, f in order])))
            at += [min(read[t, f] for t, f in enumerate(leaves[r])) for r in best]
        return float(np.quantile(at, params.recall, method="higher")) / len(x) if at else 0.0


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """Rows with an id and `dim` finite components, not all zero, as doubles."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) == dim) & ~F.coalesce(bad, F.lit(True)) & F.exists(e, lambda x: x != 0)).select(
        "vec_id", e.cast("array<double>").alias("v")
    )


def _blocks(per_tree: list[np.ndarray]) -> dict[tuple[int, int], tuple[int, int]]:
    """(tree, leaf) -> (first block, number of blocks)."""
    out, block = {}, 0
    for t, counts in enumerate(per_tree):
        room = 0
        for leaf, n in enumerate(counts):
            if n > BLOCK_ROWS:
                parts = int(-(-n // BLOCK_ROWS))
                out[t, leaf] = (block + 1, parts)
                block, room = block + parts, 0
            else:
                if n > room:
                    block, room = block + 1, BLOCK_ROWS
                out[t, leaf] = (block, 1)
                room -= n
    return out


def nearest(vectors: DataFrame, is_query, k: int = 20, params: ForestParams = ForestParams()) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best by inner product among the rows that the forest reaches.

    vectors (vec_id, embedding); `is_query` a condition on vec_id. Vectors that
    are null, zero, not finite or not of the most common length take no part, as
    a product of vectors of different lengths means nothing; repeated (vec_id,
    embedding) rows count once. Equal vectors are indexed as one: only the k + 1
    smallest ids of each can appear in a result, so a vector that a third of the
    rows share costs one entry. Ties go to the smaller id. Fewer than k candidates
    give fewer rows; empty tables give none.

    The trees are fitted on at most params.sample rows and broadcast (size bound
    by the sample); every row is indexed. How much a query reads is measured on
    the sample, for params.recall: little where vectors cluster, nearly all where
    they have no structure. Leaves are read in blocks of about BLOCK_ROWS rows. A
    task holds one block and lets the queries that visit it pass by in batches; a
    block that more than VISITS queries visit is copied once for each VISITS of
    them, and one that nobody visits stays where it is. Queries that share a
    vector are searched as one and meet its hits in tasks of SHARERS.
    """
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    dims = vectors.where("embedding is not null").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return spark.createDataFrame([], out)
    good = usable(vectors, dims["d"]).withColumn("key", F.struct(F.xxhash64("v").alias("a"), F.xxhash64("v", F.lit(1)).alias("b"))).distinct()
    first = W.partitionBy("key").orderBy("vec_id")
    members = good.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).select("key", "vec_id", "v")
    distinct = good.groupBy("key").agg(F.first("v").alias("v"))
    queries = good.where(is_query)
    query_vectors = queries.groupBy("key").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("n")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = distinct.count()
    norm = lambda: F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    sample = distinct.orderBy(F.col("key.a"), F.col("key.b")).limit(params.sample - 1).union(distinct.orderBy(F.desc(norm()), "key").limit(1))
    fit = np.array([r[0] for r in sample.select("v").collect()], float).reshape(-1, dims["d"])
    if not len(fit):
        return spark.createDataFrame([], out)
    made = Forest(fit, rows, params)
    wanted = max(params.least_rows, made.share(fit, k, params) * rows)
    forest = spark.sparkContext.broadcast(made)

    def assign(it):
        for p in it:
            if len(p):
                leaves = forest.value.leaves(np.stack(p["v"].to_numpy()))
                for t in range(leaves.shape[1]):
                    yield pd.DataFrame({"a": p["a"], "b": p["b"], "v": p["v"], "tree": t, "leaf": leaves[:, t]})

    flat = lambda df, *more: df.select("key.a", "key.b", "v", *more)
    indexed = flat(distinct).mapInPandas(assign, "a long, b long, v array<double>, tree int, leaf long")
    counts = indexed.groupBy("tree", "leaf").count().collect()  # bounded by the sample
    per_tree = [np.zeros(max([c["leaf"] for c in counts if c["tree"] == t], default=0) + 1) for t in range(params.trees)]
    for c in counts:
        per_tree[c["tree"]][c["leaf"]] = c["count"]
    sizes = spark.sparkContext.broadcast(per_tree)
    blocks = _blocks(per_tree)
    placed = spark.sparkContext.broadcast(blocks)

    def visit(it):
        for p in it:
            out = []
            for v in p["v"]:
                to: dict[int, list[int]] = {}
                for t, f in forest.value.search(np.asarray(v, float), sizes.value, wanted):
                    first, parts = placed.value[t, f]
                    for c in range(first, first + parts):
                        to.setdefault(c, []).append(f)
                out.append([{"block": c, "leaves": leaves} for c, leaves in to.items()])
            yield p.assign(visits=out)

    asks = flat(query_vectors, "n").mapInPandas(visit, "a long, b long, v array<double>, n long, visits array<struct<block long, leaves array<long>>>")
    asks = materialize(asks)
    table = spark.createDataFrame([(t, f, *x) for (t, f), x in blocks.items()], "tree int, leaf long, first long, parts long")
    visits = asks.select("a", "b", "v", F.explode("visits").alias("x")).select("a", "b", "v", F.col("x.block").alias("block"), F.col("x.leaves").alias("leaves"))
    copies = visits.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / VISITS).alias("copies"))
    asked = visits.join(copies, "block").withColumn("part", F.pmod(F.xxhash64("b", "a"), "copies"))
    placed_rows = indexed.join(F.broadcast(table), ["tree", "leaf"]).withColumn("block", F.col("first") + F.pmod(F.xxhash64("b", "a"), "parts"))
    sent = placed_rows.join(copies, "block").select("a", "b", "v", F.array("leaf").alias("leaves"), "block", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("part"))
    met = sent.withColumn("ask", F.lit(False)).unionByName(asked.drop("copies").withColumn("ask", F.lit(True)))

    def best_of(ask: pd.DataFrame, ids: np.ndarray, v: np.ndarray, by_leaf: dict[int, np.ndarray]) -> pd.DataFrame:
        found = [pd.DataFrame({"q": [], "r": [], "score": []})]
        q = np.stack(ask["v"].to_numpy())
        at = np.repeat(np.arange(len(ask)), ask["leaves"].map(len))
        for leaf, who in pd.Series(at).groupby(np.concatenate(ask["leaves"].to_numpy())):
            own = by_leaf.get(leaf)
            for i in range(0, len(who) if own is not None else 0, 512):
                part = who.to_numpy()[i : i + 512]
                s = q[part] @ v[own].T
                top = min(k + 1, len(own))
                best = np.argpartition(-s, top - 1, axis=1)[:, :top]
                exact = np.cumsum(q[part][:, None, :] * v[own[best]], axis=-1)[..., -1]  # in the order of components
                found.append(pd.DataFrame({"q": np.repeat(part, top), "r": own[best].ravel(), "score": exact.ravel()}))
        f = pd.concat(found)
        f = f[f.groupby("q")["score"].rank(method="min", ascending=False) <= k + 1]
        q, r = f["q"].to_numpy(int), f["r"].to_numpy(int)
        return pd.DataFrame({"qa": ask["a"].to_numpy()[q], "qb": ask["b"].to_numpy()[q], "a": ids[r, 0], "b": ids[r, 1], "score": f["score"].to_numpy()})

    def rerank(it):
        """Rows of a copy of a block come before the queries that visit it: they stay until the next one's."""
        key, rows, made = None, [], None
        for p in it:
            for (*own, ask), g in p.groupby(["block", "part", "ask"]):
                if own != key:
                    key, rows, made = own, [], None
                if not ask:
                    rows.append((g[["a", "b"]].to_numpy(), np.stack(g["v"].to_numpy()), g["leaves"].str[0].to_numpy()))
                elif rows or made:
                    if not made:
                        ids, v, leaf = (np.concatenate(x) for x in zip(*rows))
                        made, rows = (ids, v, pd.Series(range(len(leaf))).groupby(leaf).indices), []
                    yield best_of(g, *made)

    pairs = met.repartition("block", "part").sortWithinPartitions("block", "part", "ask").mapInPandas(rerank, "qa long, qb long, a long, b long, score double")
    best = pairs.distinct().withColumn("n", F.rank().over(W.partitionBy("qa", "qb").orderBy(F.desc("score")))).where(F.col("n") <= k + 1).drop("n")
    m = members.select(F.col("key.a").alias("a"), F.col("key.b").alias("b"), "vec_id")
    hits = best.join(m, ["a", "b"])
    hits = hits.withColumn("n", F.row_number().over(W.partitionBy("qa", "qb").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1).drop("n")
    ask = queries.select(F.col("vec_id").alias("query_id"), F.col("key.a").alias("qa"), F.col("key.b").alias("qb"))
    shared = asks.where(F.col("n") > SHARERS).select(F.col("a").alias("qa"), F.col("b").alias("qb"), F.ceil(F.col("n") / SHARERS).alias("shares"))
    shared = F.broadcast(shared)  # a row for SHARERS queries, at most
    ask = ask.join(shared, ["qa", "qb"], "left").withColumn("share", F.pmod(F.xxhash64("query_id"), F.coalesce("shares", F.lit(1)))).drop("shares")
    hits = hits.join(shared, ["qa", "qb"], "left").withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1))).drop("shares")
    joined = ask.join(hits, ["qa", "qb", "share"]).where("vec_id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return joined.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
