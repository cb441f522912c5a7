"""Ranked retrieval over vector rows, lexical scores and their mixture."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.vectors import dot

MODES = ("similarity", "text-match", "hybrid", "tool")


@dataclass(frozen=True)
class SearchParams:
    """Defaults are fixed values; alpha is clamped to 0..1 and unknown modes mean similarity."""

    query: str | None = None
    threshold: float = 0.25
    rounds: tuple[str, ...] | None = None
    mode: str = "similarity"
    alpha: float = 0.7
    limit: int = 5

    def __post_init__(self):
        object.__setattr__(self, "alpha", min(1.0, max(0.0, self.alpha)))
        object.__setattr__(self, "mode", self.mode if self.mode in MODES else "similarity")
        object.__setattr__(self, "query", self.query or None)


def in_scope(rows: DataFrame, rounds, key: str = "round_file") -> DataFrame:
    """Rows of the given rounds (a list or a one-column table); None or an empty list keeps all."""
    if rounds is None or (not isinstance(rounds, DataFrame) and not rounds):
        return rows
    if isinstance(rounds, DataFrame):
        return rows.join(rounds.select(key), key, "left_semi")
    return rows.where(F.col(key).isin(list(rounds)))


def models(vectors: DataFrame, fallback: str) -> DataFrame:
    return vectors.select(F.coalesce("model", F.lit(fallback)).alias("model")).distinct()


def semantic_rows(vectors: DataFrame, queries: DataFrame, fallback: str | None = None) -> DataFrame:
    """Each vector row with its inner product with each query: (query, round_file, suffix, semantic).

    vectors (round_file, suffix, model, vector); queries (query, vector) or, with
    `fallback`, (query, model, vector): then rows meet the query vector of their
    own model, a missing model being the fallback; models without a query vector
    drop out. The query table is the small side: Spark broadcasts it by its size.
    """
    q = queries.withColumnRenamed("vector", "_q")
    if fallback is None:
        joined = vectors.drop("model").join(q)
    else:
        joined = vectors.withColumn("model", F.coalesce("model", F.lit(fallback))).join(q, "model")
    return joined.withColumn("semantic", dot(F.col("_q"), F.col("vector"))).where("semantic is not null").drop("_q", "vector", "model")


def fuse(rows: DataFrame, lexical: DataFrame | None, alpha: float) -> DataFrame:
    """Adds lexical and score = alpha * semantic + (1 - alpha) * lexical.

    lexical (query, round_file, normalized); a query without any lexical hit is
    ranked by its semantic score alone, whatever alpha says.
    """
    if lexical is None:
        return rows.withColumn("lexical", F.lit(0.0)).withColumn("score", F.col("semantic"))
    hit = lexical.select("query").distinct().withColumn("_any", F.lit(True))
    x = rows.join(lexical.select("query", "round_file", F.col("normalized").alias("lexical")), ["query", "round_file"], "left").join(hit, "query", "left")
    x = x.withColumn("lexical", F.coalesce("lexical", F.lit(0.0)))
    a = F.when(F.col("_any"), F.lit(float(alpha))).otherwise(1.0)
    return x.withColumn("score", a * F.col("semantic") + (1 - a) * F.col("lexical")).drop("_any")


def best_per_round(rows: DataFrame) -> DataFrame:
    """(query, round_file, score, semantic, lexical) of each round's best row; ties to the first suffix. Combined before the shuffle."""
    best = F.max_by(F.struct("score", "semantic", "lexical"), F.struct("score", "semantic"))
    return rows.groupBy("query", "round_file").agg(best.alias("_b")).select("query", "round_file", "_b.*")


def top(scores: DataFrame, k: int, threshold: float | None = None, order: str = "score") -> DataFrame:
    """Adds rank and keeps each query's k best from the threshold up; ties by round_file."""
    if threshold is not None:
        scores = scores.where(F.col(order) >= threshold)
    w = W.partitionBy("query").orderBy(F.desc(order), "round_file")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def similarity(vectors: DataFrame, queries: DataFrame, fallback: str | None = None, lexical: DataFrame | None = None, alpha: float = 0.7, rounds: DataFrame | None = None) -> DataFrame:
    """Best score of each round for each query. With `rounds`, rounds that are not stored are left out before the ranking."""
    rows = semantic_rows(vectors, queries, fallback)
    if rounds is not None:
        rows = rows.join(rounds.select("round_file"), "round_file", "left_semi")
    return best_per_round(fuse(rows, lexical, alpha))


# -- budgets ---------------------------------------------------------------

#: Share of the context window, floor in tokens, window, least score, most entries.
BUDGET_RATIO, MIN_BUDGET, WINDOW, MIN_SIMILARITY, MAX_ENTRIES = 0.08, 2000, 128_000, 0.3, 20


def context_budget(best: Column, window: int = WINDOW, least: float = MIN_SIMILARITY, floor: int = MIN_BUDGET, ratio: float = BUDGET_RATIO) -> Column:
    """Tokens for the relevance list: from the floor to ratio * window as the best score goes from `least` to 1."""
    most = max(floor, int(ratio * window))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (best - least) / (1 - least)))
    return F.floor(floor + t * (most - floor))


def recency_budget(window: int = WINDOW, ratio: float = BUDGET_RATIO, floor: int = MIN_BUDGET) -> int:
    return max(floor, int(ratio * window))


def select_in_budget(ranked: DataFrame, cost: Column, budget: Column | str, least: float = MIN_SIMILARITY, most: int = MAX_ENTRIES, reserved: int = 0) -> DataFrame:
    """The prefix of each query's ranking that fits: at most `most` rows, scores from `least`, costs adding up to the budget.

    `ranked` has query, rank (from 1, without gaps) and score. Selection stops at
    the first row that does not fit; as costs are positive, that is a bound on the
    running sum. `cost` may depend on rank.
    """
    kept = ranked.where((F.col("score") >= least) & (F.col("rank") <= most)).withColumn("cost", cost)
    used = F.sum("cost").over(W.partitionBy("query").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)) + reserved
    budget = F.col(budget) if isinstance(budget, str) else budget
    return kept.withColumn("used", used).where(F.col("used") <= budget)


def select_recent(chain: DataFrame, cost: Column, header_cost: Column, budget: int, most: int = MAX_ENTRIES, reserved: int = 0) -> DataFrame:
    """Newest-first prefix of each session's chain under a budget, the newest always kept.

    chain (session, pos, topic, ...): adds index (1 is the newest), group_no (topics
    in order of their newest kept round) and used. A topic's header is charged with
    its first row. `cost` may use index, `header_cost` group_no. A null topic is a
    group of its own.
    """
    recent = W.partitionBy("session").orderBy(F.desc("pos"))
    x = chain.withColumn("index", F.row_number().over(recent)).where(F.col("index") <= most)
    x = x.withColumn("_topic", F.coalesce(F.col("topic").cast("string"), F.concat(F.lit("alone:"), F.col("pos").cast("string"))))
    first = F.row_number().over(W.partitionBy("session", "_topic").orderBy("index")) == 1
    running = W.partitionBy("session").orderBy("index").rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("_first", first).withColumn("_groups", F.sum(F.col("_first").cast("int")).over(running))
    x = x.withColumn("group_no", F.max(F.when(F.col("_first"), F.col("_groups"))).over(W.partitionBy("session", "_topic")))
    x = x.withColumn("cost", cost + F.when(F.col("_first"), header_cost).otherwise(0))
    x = x.withColumn("used", F.sum("cost").over(running) + reserved)
    return x.where((F.col("index") == 1) | (F.col("used") <= budget)).drop("_topic", "_first", "_groups")
