"""Sweep of a store: what each text and each of its vector rows needs. A batch over the whole tables.

    python -m jobs.sweep --rounds /data/documents.parquet --vectors /data/embeddings.parquet --output /data/sweep

Writes, and overwrites at each run:

* <output>/rounds/action=A: every id of the store once, with the first of these that holds:
  nameless (a text without an id, one row for each content), conflict (several texts under one id), empty, duplicate (the
  same text but for outer white space as `keeper`, the smallest such id), reembed (a vector row is of another model, and
  some suffix has none of this one), embed (no vector row), keep;
* <output>/vectors/action=A: every vector row that has to go: orphan (no such id), doomed (its text is empty or a
  duplicate), short (the prompt row of a text of few words), stale (of another model, where a current row has its place);
* <output>/keepers: of each content that several ids have, the keeper and their number;
* <output>/summary: ids and words by source and action.

Texts are read once and leave their task as a digest and a word count; no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, main, rebalanced
from palimpsest.functions import text as X
from palimpsest.operators import maintain

ROUND_COLUMNS = {"id": "doc_id", "text": "text", "source": "source"}
ROUND_PLAN = "id long, source string, words int, rows long, short boolean, keeper long, action string"
VECTOR_PLAN = "id long, suffix string, model string, action string"
VECTOR_COLUMNS = {"id": "floor(vec_id / 2)", "suffix": "if(vec_id % 2 = 0, ':prompt', ':response')", "model": "if(label % 3 > 0, concat('m', label % 3), null)"}


def facts(rounds: DataFrame) -> DataFrame:
    """(id, key, source, words, conflict, rows) of texts (id, text, source): one row for each id, for each content where there is none."""
    trimmed = X.trim_unicode(F.coalesce("text", F.lit("")))
    each = rounds.select("id", "source", F.md5(trimmed).alias("key"), X.word_count("text").alias("words"), (trimmed == "").alias("blank"))
    # rows of one id and content differ in outer white space or source only; the least stands for them
    by = each.groupBy("id", F.when(F.col("id").isNull(), F.col("key")).alias("_content")).agg(
        F.min(F.struct("key", "source", "words", "blank")).alias("f"), (F.min("key") != F.max("key")).alias("conflict"), F.count(F.lit(1)).alias("rows")
    )
    return by.select("id", "f.*", "conflict", "rows")


def plan_rounds(found: DataFrame, keepers: DataFrame, vectors: DataFrame, model: str, short_words: int) -> DataFrame:
    """(id, source, words, rows, short, keeper, action); found is facts(), keepers (key, keeper, copies), vectors (id, suffix, model)."""
    short = found.select(F.col("id").alias("round_file"), (F.col("words") < short_words).alias("short"))
    rows = vectors.withColumnRenamed("id", "round_file")
    covered = maintain.coverage(maintain.forcing_of(rows, short.where("round_file is not null")), model).withColumnRenamed("round_file", "id")
    x = found.join(keepers.select("key", "keeper"), "key", "left").join(covered, "id", "left")
    action = (
        F.when(F.col("id").isNull(), "nameless").when(F.col("conflict"), "conflict").when(F.col("blank"), "empty").when(F.col("id") != F.col("keeper"), "duplicate")
        .when(F.col("covered"), "keep").when(F.col("has_stale"), "reembed").otherwise("embed")
    )
    keeper = F.when(action == "duplicate", F.col("keeper"))
    return x.select("id", "source", "words", "rows", (F.col("words") < short_words).alias("short"), keeper.alias("keeper"), action.alias("action"))


def plan_vectors(vectors: DataFrame, planned: DataFrame, model: str) -> DataFrame:
    """(id, suffix, model, action) of the vector rows that have to go."""
    of_round = planned.where("id is not null").select("id", "short", F.col("action").alias("fate"))
    current = F.coalesce("model", F.lit(model)) == model
    has = vectors.where(current).select("id", "suffix").distinct().withColumn("has", F.lit(True))
    x = vectors.join(of_round, "id", "left").join(has, ["id", "suffix"], "left")
    action = (
        F.when(F.col("fate").isNull(), "orphan").when(F.col("fate").isin("empty", "duplicate"), "doomed")
        .when(F.col("short") & (F.col("suffix") == ":prompt"), "short").when(~current & F.col("has"), "stale")
    )
    return x.select("id", "suffix", "model", action.alias("action")).where("action is not null")


def _written(df: DataFrame, path: str, *by: str) -> DataFrame:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_plans(spark: SparkSession, output: str) -> tuple[DataFrame, DataFrame]:
    """What a sweep wrote of rounds and of vector rows, also where there is none; ids are integers."""
    return spark.read.schema(ROUND_PLAN).parquet(f"{output}/rounds"), spark.read.schema(VECTOR_PLAN).parquet(f"{output}/vectors")


def sweep(
    spark: SparkSession, rounds: str, vectors: str, output: str, model: str = "m1", short_words: int = 20,
    round_columns: dict[str, str] = ROUND_COLUMNS, vector_columns: dict[str, str] = VECTOR_COLUMNS,
) -> dict:
    """Write what each text and vector row of a store needs; gives the counts by action.

    The columns of either table are SQL expressions over what the files have. Null
    models count as current. A text without words is empty; null sources stay null.
    """
    texts = spark.read.parquet(rounds).selectExpr(*[f"{e} as {c}" for c, e in round_columns.items()])
    rows = spark.read.parquet(vectors).selectExpr(*[f"{e} as {c}" for c, e in vector_columns.items()]).where("id is not null")
    found = _written(facts(texts), f"{output}/facts")
    named = found.where("id is not null and not conflict and not blank")
    same = named.groupBy("key").agg(F.min("id").alias("keeper"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    keepers = _written(same, f"{output}/keepers")  # apart, so that the rows of a text with very many copies can be split
    planned = _written(rebalanced(plan_rounds(found, keepers, rows, model, short_words), "action"), f"{output}/rounds", "action")
    leaving = _written(rebalanced(plan_vectors(rows, planned, model), "action"), f"{output}/vectors", "action")
    by = planned.groupBy("source", "action").agg(F.count(F.lit(1)).alias("ids"), F.sum("words").alias("words"))
    by.coalesce(1).write.mode("overwrite").json(f"{output}/summary")
    count = lambda df: {r.action: r["count"] for r in df.groupBy("action").count().collect()}
    out = {"rounds": count(planned), "vectors": count(leaving)}
    log.info("read %s and %s; of the rounds %s, vector rows to go %s; written to %s", rounds, vectors, out["rounds"], out["vectors"], output)
    return out


if __name__ == "__main__":
    raise SystemExit(main(sweep, "sweep.json"))
