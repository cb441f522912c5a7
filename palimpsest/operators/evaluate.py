"""Offline evaluation: candidates as of the query's time, ranked lists against labels, and their means."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.text import is_short, key_parts
from palimpsest.functions.vectors import dot
from palimpsest.operators.search import top
from palimpsest.sources.scratch import scratch_path


def candidates_as_of(queries: DataFrame, rounds: DataFrame, equal_to: str | None = None) -> DataFrame:
    """(query, round_file): rounds strictly before each query's time, itself and rounds without time left out.

    queries (query, ts), rounds (round_file, ts). A theta join in general;
    `equal_to` names a column of both (a store, a user) that candidates share with
    their query, which makes it an equi-join with a range filter.
    """
    r = rounds.withColumnRenamed("ts", "_ts")
    before = (F.col("_ts") < F.col("ts")) & (F.col("round_file") != F.col("query"))
    joined = queries.join(r, equal_to) if equal_to else queries.join(r)
    return joined.where(before).drop("_ts")


def earlier_counts(rounds: DataFrame, within: str) -> DataFrame:
    """All columns of rounds (`within`, ts) and `n`, how many of the same `within` have a smaller ts; null times have null.

    Times are counted first, so those that are equal are one row. These are sorted
    over all tasks, each adds up what it holds of a key, and a running sum over the
    tasks' totals is put before that: so a key of any size is split. A null key is a
    key like others.
    """
    same = F.struct(within, "ts")
    times = rounds.where("ts is not null").groupBy(F.col(within).alias("_g"), F.col("ts").alias("_ts")).agg(F.count(F.lit(1)).alias("_c"))
    path = scratch_path(rounds.sparkSession, "times")
    times.repartitionByRange("_g", "_ts").withColumn("_task", F.spark_partition_id()).write.parquet(path)
    times = rounds.sparkSession.read.parquet(path)
    upto = W.rowsBetween(W.unboundedPreceding, -1)
    totals = times.groupBy("_g", "_task").agg(F.sum("_c").alias("_t"))
    totals = totals.select(F.col("_g").alias("_h"), F.col("_task").alias("_k"), F.coalesce(F.sum("_t").over(upto.partitionBy("_g").orderBy("_task")), F.lit(0)).alias("_before"))
    here = times.withColumn("_here", F.coalesce(F.sum("_c").over(upto.partitionBy("_g", "_task").orderBy("_ts")), F.lit(0)))
    n = here.join(totals, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_task") == F.col("_k"))).select(F.struct(F.col("_g").alias(within), F.col("_ts").alias("ts")).alias("_at"), (F.col("_here") + F.col("_before")).alias("n"))
    return rounds.join(n, same.eqNullSafe(F.col("_at")), "left").drop("_at")


def excluded_without_time(rounds: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, excluded): distinct rounds other than the query that have no time."""
    blank = rounds.where("ts is null").select("round_file").distinct()
    own = queries.join(blank, F.col("query") == F.col("round_file"), "left_semi").select("query", F.lit(1).alias("_own"))
    n = blank.agg(F.count(F.lit(1)).alias("_n"))
    return queries.select("query").join(own, "query", "left").join(F.broadcast(n)).select("query", (F.col("_n") - F.coalesce("_own", F.lit(0))).alias("excluded"))


TURN = 2048  # queries that go to all tasks together


def _nearest_before(queries: list[tuple[str, object, list[float]]], k: int):
    """In each batch of rows (round_file, _ts, vector) the k best rounds before each query's time, and what ties with the last but for rounding."""
    by_size: dict[int, list] = {}
    for q in queries:
        by_size.setdefault(len(q[2]), []).append(q)
    sets = {d: ([q[0] for q in qs], [q[1] for q in qs], np.array([q[2] for q in qs], float).reshape(len(qs), d)) for d, qs in by_size.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, times, vectors = batch.column("round_file").to_pylist(), batch.column("_ts").to_pylist(), batch.column("vector")
            sizes, place = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False), {f: i for i, f in enumerate(files)}
            out: list[tuple[str, int]] = []
            for d, (names, limits, wanted) in sets.items():
                rows = np.flatnonzero(sizes == d)
                if not len(rows):
                    continue
                score = wanted @ vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), d).T
                at = np.array([times[i] for i in rows])
                own = np.array([place[files[i]] for i in rows])  # rows of one round have its place
                for name, limit, s in zip(names, limits, score):
                    ok = np.flatnonzero(np.isfinite(s) & (at < limit) & (own != place.get(name, -1)))
                    if not len(ok):
                        continue
                    best = np.full(len(files), -np.inf)
                    np.maximum.at(best, own[ok], s[ok])
                    found = np.flatnonzero(best > -np.inf)
                    if len(found) > k:
                        last = np.partition(best[found], -k)[-k]
                        found = found[best[found] >= last - 1e-9 * (1 + abs(last))]
                    chosen = ok[np.isin(own[ok], found)]
                    out += [(name, int(rows[i])) for i in chosen]
            if out:
                take = pa.array([i for _, i in out], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in out], pa.string()), batch.column("round_file").take(take), vectors.take(take)], ["query", "round_file", "vector"])

    return run


def rank_as_of(queries: DataFrame, vectors: DataFrame, rounds: DataFrame, k: int = 5) -> DataFrame:
    """(query, round_file, score, rank): each query's k best rounds by inner product among those before it.

    queries (query, ts, vector), vectors (round_file, vector), rounds (round_file,
    ts). The best of a round's rows counts; vectors of another size than the query's
    take no part, nor do null and non-finite ones. The queries go to all tasks in turns; a batch of
    rows is one product of matrices and sends its own best rounds alone, of which
    the scores are taken anew as sums in order, so equal vectors tie.
    """
    rows = vectors.select("round_file", F.col("vector").cast("array<double>").alias("vector")).join(rounds.select("round_file", F.col("ts").alias("_ts")), "round_file").where("_ts is not null")
    q = queries.select("query", "ts", F.col("vector").cast("array<double>").alias("_q")).where("_q is not null and ts is not null and not exists(_q, x -> x is null)")
    turns = max(1, -(-q.count() // TURN))
    near = None
    for turn in range(turns):
        mine = [(r.query, r.ts, r._q) for r in q.where(F.pmod(F.xxhash64("query"), F.lit(turns)) == turn).collect()]  # TURN queries, about
        part = rows.where("not exists(vector, x -> x is null)").mapInArrow(_nearest_before(mine, k), "query string, round_file string, vector array<double>")
        near = part if near is None else near.unionByName(part)
    scored = near.join(q.select("query", "_q"), "query").withColumn("score", dot(F.col("_q"), F.col("vector"))).where("score is not null")
    return top(scored.groupBy("query", "round_file").agg(F.max("score").alias("score")), k)


def query_metrics(labels: DataFrame, ranked: DataFrame, k: int = 5) -> DataFrame:
    """(query, n_labels, hit, recall, mrr, first_hit_rank) of each query with labels.

    labels (query, label), repeated ones count once; ranked (query, round_file, rank).
    """
    l = labels.where(F.col("label") != F.col("query")).distinct()
    n = l.groupBy("query").agg(F.count(F.lit(1)).alias("n_labels"))
    hits = l.join(ranked, [l["query"] == ranked["query"], l["label"] == ranked["round_file"]]).groupBy(l["query"]).agg(
        F.count_if(F.col("rank") <= k).alias("hits"), F.min("rank").alias("first_hit_rank")
    )
    x = n.join(hits, "query", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return x.select(
        "query",
        "n_labels",
        (F.col("hits") > 0).cast("int").alias("hit"),
        (F.col("hits") / F.col("n_labels")).alias("recall"),
        F.coalesce(1 / F.col("first_hit_rank"), F.lit(0.0)).alias("mrr"),
        "first_hit_rank",
    )


def macro_mean(metrics: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: queries with labels, queries without, and the means over the former (0 without any)."""
    x = queries.select("query").join(metrics, "query", "left")
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return x.agg(
        F.count("n_labels").alias("query_count"),
        F.count_if(F.col("n_labels").isNull()).alias("empty_label_count"),
        mean("hit").alias("hit_at_5"),
        mean("recall").alias("recall_at_5"),
        mean("mrr").alias("mrr"),
    )


def golden_metrics(labels: DataFrame, ranked: DataFrame, k: int = 5) -> DataFrame:
    """Means by mode: hits and recall on all labels, MRR on the primary label, else on the first.

    labels (query, label, pos, is_primary, mode).
    """
    some = query_metrics(labels.select("query", "label"), ranked, k).drop("mrr", "first_hit_rank")
    main = labels.groupBy("query").agg(F.min_by("label", F.struct((~F.col("is_primary")).alias("a"), F.col("pos").alias("b"))).alias("label"), F.first("mode").alias("mode"))
    one = main.join(query_metrics(main.select("query", "label"), ranked, k).select("query", "mrr"), "query", "left")
    x = one.join(some, "query")
    return x.groupBy(F.coalesce("mode", F.lit("similarity")).alias("mode")).agg(
        F.count(F.lit(1)).alias("query_count"), F.avg("hit").alias("hit_at_5"), F.avg("recall").alias("recall_at_5"), F.avg(F.coalesce("mrr", F.lit(0.0))).alias("mrr")
    )


def skip_reason(prompt: Column | str, has_embedding: Column, ts: Column, has_labels: Column) -> Column:
    """The first reason, in this order, for which a round is no query; null for those that are replayed with labels."""
    return F.when(is_short(prompt), "short").when(~has_embedding, "no_embedding").when(ts.isNull(), "no_timestamp").when(~has_labels, "no_labels")


def skip_counts(rounds: DataFrame, reason: Column) -> DataFrame:
    """One row of counts; rounds without labels were replayed before they were skipped."""
    x = rounds.select(reason.alias("r"))
    n = lambda *of: F.count_if(F.col("r").isin(*of))
    return x.agg(
        F.count(F.lit(1)).alias("total_rounds"),
        F.count_if(F.col("r").isNull() | (F.col("r") == "no_labels")).alias("replayed"),
        n("short").alias("skipped_short"),
        n("no_embedding").alias("skipped_no_embedding"),
        n("no_timestamp").alias("skipped_no_timestamp"),
        n("no_labels").alias("skipped_no_labels"),
    )


def noise_rate(positions: DataFrame) -> DataFrame:
    """One row: the share of presented entries that were not read; null if none was presented."""
    return positions.agg((1 - F.sum("readCount") / F.nullif(F.sum("presentedCount"), F.lit(0))).alias("noise_rate"))


def weak_labels(rounds: DataFrame, expansions: DataFrame) -> DataFrame:
    """(query, label): a round's parent and the rounds it expanded, without itself, each once."""
    parent = rounds.where("parentId is not null and parentId <> ''").select(F.col("round_file").alias("query"), F.col("parentId").alias("label"))
    return parent.union(expansions.select("query", "label")).where("query <> label").distinct()


def presented(entries: DataFrame, positions: int = 5) -> DataFrame:
    """(session, shown, position, hash) of chains (session, shown, pos, round_file), one for each time `shown`: the newest entry is position 1."""
    newest = F.row_number().over(W.partitionBy("session", "shown").orderBy(F.desc("pos")))
    return entries.select("session", "shown", newest.alias("position"), F.nullif("round_file", F.lit("")).alias("hash")).where(F.col("position") <= positions)


def read_positions(shown: DataFrame, reads: DataFrame, positions: int = 5) -> DataFrame:
    """(position, presentedCount, readCount), zeros included, of `presented` rows and reads (session, shown, hash).

    Every read counts at each position where its hash was presented at that time.
    """
    n = reads.groupBy("session", "shown", "hash").agg(F.count(F.lit(1)).alias("_n"))
    met = shown.where("hash is not null").join(n, ["session", "shown", "hash"], "left")
    by = met.groupBy("position").agg(F.count(F.lit(1)).alias("presentedCount"), F.coalesce(F.sum("_n"), F.lit(0)).alias("readCount"))
    every = shown.sparkSession.range(1, positions + 1).select(F.col("id").cast("int").alias("position"))
    return every.join(by, "position", "left").fillna(0)


def indexed_rounds(index: DataFrame) -> DataFrame:
    """One row: how many rounds an index (key: the round's file with a row's suffix) holds, each once."""
    return index.agg(F.count_distinct(key_parts(F.col("key"))[0]).alias("n_rounds"))
