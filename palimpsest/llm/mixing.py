"""Mixing sources to target weights by Poisson replication, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One Poisson draw has at most this mean; greater means are sums of independent draws.
PIECE = 400.0
#: Rates are broadcast up to so many sources; beyond, they are joined by shuffle.
BROADCAST_SOURCES = 20_000


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """source, n_docs, rate: the mean number of copies a document of the source gets.

    weights: target share of documents for each source (normalised; absent: 0).
    Without weights the shares are proportional to n_docs ** alpha. The mixture
    has epochs * count(docs) documents in expectation. A null source is a source.
    """
    n = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        raw = F.pow(F.col("n_docs").cast("double"), F.lit(float(alpha)))
    else:
        table = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
        raw = F.coalesce(F.try_element_at(table, F.coalesce("source", F.lit("\0"))), F.lit(0.0))
    n = n.withColumn("_raw", raw)
    total = n.agg(F.sum("n_docs").alias("_n"), F.sum("_raw").alias("_sum"))
    share = F.col("_raw") / F.when(F.col("_sum") > 0, F.col("_sum"))
    return n.join(F.broadcast(total)).select(
        "source", "n_docs", F.coalesce(share * F.col("_n") * F.lit(float(epochs)) / F.col("n_docs"), F.lit(0.0)).alias("rate")
    )


def _cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... far into the upper tail, of a Poisson with mean `rate`."""
    top = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    zero = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))
    step = lambda a, k: F.struct(
        (a["p"] * rate / k).alias("p"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + a["p"] * rate / k)).alias("c")
    )
    return F.aggregate(F.sequence(F.lit(1), top), zero, step, lambda a: a["c"])


def _uniform(*parts) -> Column:
    """A double in (0, 1) from 52 bits of an MD5 over the parts."""
    digits = F.substring(F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + 0.5) / F.lit(float(1 << 52))


def replicate(docs: DataFrame, rates: DataFrame, seed: int = 1, key: str = "doc_id") -> DataFrame:
    """The documents' columns with `copy_no` (from 0) and `shuffle_key`, in a global random order.

    A document is repeated by the quantile of a Poisson with its source's rate at
    a uniform drawn from (seed, key), so a rerun or a lost executor changes
    nothing; rate 0 gives no copy. Null keys draw as one key, null texts stay
    null, repeated rows repeat alike, an empty table stays empty. Input columns
    named copy_no or shuffle_key are replaced; all others are kept.
    """
    docs = docs.drop("copy_no", "shuffle_key")
    pieces = F.greatest(F.lit(1), F.ceil(F.col("rate") / PIECE)).cast("int")
    rates = rates.select(F.col("source").alias("__source"), pieces.alias("__pieces"), _cdf(F.col("rate") / pieces).alias("__cdf"))
    if rates.select("__source").limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    joined = docs.join(rates, docs["source"].eqNullSafe(rates["__source"]))
    one = lambda t: F.size(F.filter("__cdf", lambda c: c < _uniform(F.lit(seed), F.col(key), t)))
    count = F.aggregate(F.sequence(F.lit(0), F.col("__pieces") - 1), F.lit(0), lambda a, t: a + one(t))
    copies = (
        joined.withColumn("__copies", count)
        .where("__copies > 0")
        .withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
        .withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"order{seed}"), F.coalesce(F.col(key).cast("string"), F.lit("null")), "copy_no")))
    )
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return copies.select(*docs.columns, "copy_no", "shuffle_key").repartition(n, "shuffle_key").sortWithinPartitions("shuffle_key")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0, seed: int = 1) -> DataFrame:
    """Poisson replication of `docs` to the target weights; see source_rates and replicate."""
    return replicate(docs, source_rates(docs, weights, alpha, epochs), seed)
