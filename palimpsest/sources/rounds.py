"""Round store: JSON files as the exchange format, Parquet as the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.text import key_parts
from palimpsest.sources.schemas import ROUND, STATS


def read_rounds(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Rounds of a folder of one-object JSON files, round_file from the file's name.

    Files whose name begins with `index` are no rounds. Unreadable ones are left
    out, or end the job if `strict`.
    """
    reader = spark.read.schema(ROUND if strict else T.StructType([*ROUND.fields, T.StructField("_bad", T.StringType())])).option("multiLine", True).option("pathGlobFilter", "*.json")
    reader = reader.option("mode", "FAILFAST") if strict else reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
    rounds = reader.json(path).withColumn("round_file", F.col("_metadata.file_name"))
    rounds = rounds.where(~F.col("round_file").startswith("index") & (F.col("round_file") != "stats.json"))
    return rounds if strict else rounds.where("_bad is null").drop("_bad")


def read_round(rounds: DataFrame, key: str) -> DataFrame:
    """One round by its file or by a row key with a suffix; see with_defaults."""
    file = key_parts(F.lit(key))[0]
    return with_defaults(rounds.where(F.col("round_file") == file))


def with_defaults(rounds: DataFrame) -> DataFrame:
    """Rounds with missing texts and lists empty, missing numbers 0 and no follow-up where none is noted."""
    plain = {"string": F.lit(""), "int": F.lit(0), "boolean": F.lit(False)}
    own = {"userPrompt", "responseSequence", "turnIndex", "toolCallCount", "needsFollowup", "toolCallNames", "toolCalls", "responseSegments"}
    default = lambda f: F.array().cast(f.dataType) if isinstance(f.dataType, T.ArrayType) else plain[f.dataType.simpleString()]
    return rounds.select(*[F.coalesce(F.col(f.name), default(f)).alias(f.name) if f.name in own else F.col(f.name) for f in rounds.schema.fields])


def modified_after(files: DataFrame, cutoff_ms: int) -> DataFrame:
    """Rows of files changed after the cutoff; an unknown time keeps the row. Needs `modified_ms`."""
    return files.where(F.col("modified_ms").isNull() | (F.col("modified_ms") > cutoff_ms))


def append_new(rounds: DataFrame, stored: DataFrame, path: str) -> None:
    """Appends rounds that are not stored yet, each once; repeating the call adds nothing."""
    rounds.dropDuplicates(["round_file"]).join(stored.select("round_file"), "round_file", "left_anti").write.mode("append").parquet(path)


def write_json(rounds: DataFrame, path: str) -> None:
    """One JSON object a line; Spark's commit protocol shows all of it or nothing."""
    rounds.write.mode("overwrite").json(path)


def snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """Copies of tables under a path that must not exist."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")


def read_stats(texts: DataFrame) -> DataFrame:
    """(version, positionScores) of JSON texts (value). Version 1 has the fifth position only; broken ones count as empty."""
    s = texts.select(F.from_json("value", STATS).alias("s"))
    zero = lambda p=F.lit(0), r=F.lit(0): F.struct(p.cast("long").alias("presentedCount"), r.cast("long").alias("readCount"), F.lit(None).cast("string").alias("presentedHash"))
    empty = F.array(*[zero() for _ in range(5)])
    old = F.array(*[zero() for _ in range(4)], zero(F.col("s.position5.presentedCount"), F.col("s.position5.readCount")))
    scores = F.when((F.col("s.version") == 1) & F.col("s.position5").isNotNull(), old).otherwise(F.coalesce("s.positionScores", empty))
    return s.select(F.lit(2).alias("version"), scores.alias("positionScores"))
