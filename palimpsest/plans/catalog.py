"""How the driver's tables play the parts of a store (they hold no rounds of their own)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.vectors import as_doubles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as rounds' texts: (round_file, doc_id, text, lang, source)."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("round_file"), "doc_id", "text", "lang", "source")


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark as queries: (query, text)."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as index rows: two rows a round (prompt, response), three models by label (one missing), three host shards."""
    e = table(spark, sf_dir, "embeddings")
    v = F.col("vec_id")
    return e.select(
        v,
        F.floor(v / 2).cast("string").alias("round_file"),
        F.when(v % 2 == 0, ":prompt").otherwise(":response").alias("suffix"),
        F.when(F.col("label") % 3 > 0, F.concat(F.lit("m"), (F.col("label") % 3).cast("string"))).alias("model"),
        as_doubles(F.col("embedding")).alias("vector"),
        F.concat(F.lit("index.h"), (v % 3).cast("string")).alias("shard"),
        v.alias("pos"),
        "label",
    )


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set of searches: every row whose id is divisible by 100, against all rows: (query, vector)."""
    return vectors(spark, sf_dir).where("vec_id % 100 = 0").select(F.col("vec_id").cast("string").alias("query"), "vector")


def event_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as rounds with times: a session is a user."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("round_file"), "event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "event_type", "value", "props"
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("pos"), "role", "text")
