"""Vector index as text shards `index.<host>`: base64url of a JSON vector, key, model, input hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.text import key_parts

#: Names beside the shards that are none themselves.
NOT_SHARDS = (
    r"^index-tools(?:\..+)?\.fulltext\.csv$",
    r"^index\.bm25(?:\..+)?\.json$",
    r"^index\.backlog\.json$",
    r"^index\..*\.bak(?:[.-]|$)",
    r"^index\..+\.lock$",
    r"^index\..+\.tmp\.",
)
#: Fixed value: marks an input hash that was assumed, not measured.
ASSUMED = "assumed-"
_HASH = r"^(?:assumed-)?[A-Za-z0-9_-]{43}$"


def is_shard(name: Column) -> Column:
    out = name.startswith("index.")
    for pattern in NOT_SHARDS:
        out = out & ~name.rlike(pattern)
    return out


def shard_lines(spark: SparkSession, path: str) -> DataFrame:
    """(shard, line_no, line) of every shard in a folder, blank lines left out. Files are split by Spark; line_no orders within a shard."""
    lines = spark.read.option("pathGlobFilter", "index.*").text(path).select(F.col("_metadata.file_name").alias("shard"), F.trim("value").alias("line"), F.monotonically_increasing_id().alias("line_no"))
    return lines.where(is_shard(F.col("shard")) & (F.col("line") != ""))


def decode_vector(b64: Column) -> Column:
    """Doubles of a base64url JSON list; null if it is none."""
    plain = F.translate(b64, "-_\r\n", "+/")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))
    return F.from_json(F.try_to_binary(padded, F.lit("base64")).cast("string"), "array<double>")


def encode_vector(v: Column) -> Column:
    return F.rtrim(F.translate(F.base64(F.to_json(v)), "+/\r\n", "-_"), F.lit("="))  # base64() breaks lines


def parse_lines(lines: DataFrame) -> DataFrame:
    """VECTOR_ROW columns plus `ok`. A trailing field of an input hash's form is one; the model is what stands before it."""
    f = F.split("line", ",")
    n = F.size(f)
    last = F.element_at(f, -1)
    hashed = (n >= 4) & last.rlike(_HASH)
    file, suffix = key_parts(F.get(f, F.lit(1)))
    model = F.when(n >= 3, F.nullif(F.array_join(F.slice(f, F.lit(3), F.greatest(n - 2 - hashed.cast("int"), F.lit(0))), ","), F.lit("")))
    out = lines.select(
        file.alias("round_file"), suffix.alias("suffix"), model.alias("model"), F.when(hashed, last).alias("input_hash"), decode_vector(F.get(f, F.lit(0))).alias("vector"), "shard", F.col("line_no").alias("pos"), "line"
    )
    return out.withColumn("ok", F.col("vector").isNotNull() & F.col("round_file").isNotNull())


def format_line(vector: Column, key: Column, model: Column, input_hash: Column) -> Column:
    return F.concat_ws(",", encode_vector(vector), key, F.when(input_hash.isNotNull(), F.coalesce(model, F.lit(""))).otherwise(model), input_hash)


def bare_hash(h: Column) -> Column:
    return F.regexp_replace(h, f"^{ASSUMED}", "")


def merge_rows(rows: DataFrame) -> DataFrame:
    """One row for each (round, suffix, model): the first by shard name, then by position."""
    w = W.partitionBy("round_file", "suffix", "model").orderBy("shard", "pos")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def read_index(spark: SparkSession, path: str, strict: bool = False, merge: bool = True) -> DataFrame:
    """The merged view of a folder of shards. Broken rows are left out, or end the job if `strict`."""
    rows = parse_lines(shard_lines(spark, path))
    if strict:
        rows = rows.withColumn("vector", F.when(F.col("ok"), F.col("vector")).otherwise(F.raise_error(F.concat(F.lit("broken row in "), F.col("shard")))))
    rows = rows.where("ok").drop("ok", "line")
    return merge_rows(rows) if merge else rows


def count_lines(spark: SparkSession, path: str) -> int:
    """Rows of all shards, broken ones too, without decoding."""
    return shard_lines(spark, path).count()


def without_files(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Parsed lines whose round is not among `files` (round_file); broken lines stay."""
    return lines.join(files.select("round_file"), "round_file", "left_anti")


def write_shards(rows: DataFrame, path: str) -> None:
    """Vector rows as a table partitioned by shard: only the shards that occur are replaced, so hosts do not touch each other's."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)


def replace_own(stored: DataFrame, own: str, fresh: DataFrame, baseline: DataFrame) -> DataFrame:
    """The own shard's new rows: `fresh`, and what others appended to it since `baseline` was read."""
    appended = stored.where(F.col("shard") == own).exceptAll(baseline)
    return fresh.unionByName(appended)


def broken_rows(parsed: DataFrame) -> DataFrame:
    """(shard, broken): how many lines of each shard could not be parsed, where there are any; read_index leaves them out."""
    return parsed.where("not ok").groupBy("shard").agg(F.count(F.lit(1)).alias("broken"))


#: Fixed value: the one file of an index from before shards.
LEGACY = "index.csv"


def adopt_legacy(lines: DataFrame, own: str) -> DataFrame:
    """Lines of the index from before shards become the own shard's, where there is none yet; else they stay what they are."""
    mine = lines.where(F.col("shard") == own).agg(F.count(F.lit(1)).alias("_mine"))
    adopted = (F.col("shard") == LEGACY) & (F.col("_mine") == 0)
    return lines.join(F.broadcast(mine)).withColumn("shard", F.when(adopted, own).otherwise(F.col("shard"))).drop("_mine")


def append_rows(rows: DataFrame, path: str) -> None:
    """Adds vector rows to a table partitioned by shard. A writer makes files of its own, so hosts need no lock."""
    rows.write.mode("append").partitionBy("shard").parquet(path)
