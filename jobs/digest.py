"""Digest of conversation logs: new log files become rounds of the store. Incremental: a stream over the files, run until none is left.

    python -m jobs.digest --source /data/conversations --output /data/store --checkpoint /data/store_checkpoint

A run takes the files that its checkpoint has not seen, in batches. A batch

1. writes its messages to <output>/messages/bucket=B/batch=N: sessions are dealt to buckets by a hash;
2. makes the rounds of the buckets that it touched anew, from all their messages, and puts them in the place of the old
   ones in <output>/rounds/bucket=B. So a session may go on in later files, in any order, and its open round is closed
   then; other buckets aren't read;
3. writes what it read and made to <output>/log/batch=N.

Each step overwrites the folders of its own batch or bucket. So a batch that is repeated after a failure, at any point,
gives the same files again, and a run without new files changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, main, rebalanced
from palimpsest.operators import sessions

LOG = "batch long, messages long, rejected long, sessions long, buckets long, rounds long"


def _write(df: DataFrame, path: str, *by: str, form: str = "parquet") -> None:
    df.write.format(form).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).save(path)


def messages_of(log_rows: DataFrame, session: str, pos: str, role: str, text: str, buckets: int) -> DataFrame:
    """(session, pos, role, text, bucket) of log rows under any names; other columns are left behind."""
    m = log_rows.select(F.col(session).alias("session"), F.col(pos).alias("pos"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return m.withColumn("bucket", bucket_of("session", buckets))


def bucket_of(session: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(session), F.lit(buckets)).cast("int")


def rounds_of_messages(messages: DataFrame, buckets: int) -> DataFrame:
    """Rounds with their bucket, parent and outcome: 'prompt-only' where there is no answer yet, else 'stored'.

    Messages (session, pos, role, text, batch): of several at one position the
    first delivered counts, within a batch the least by role and text.
    """
    said = F.struct("role", "text")
    one = messages.groupBy("session", "pos").agg(F.min_by(said, F.struct("batch", "role", "text")).alias("m")).select("session", "pos", "m.*")
    rounds = sessions.with_parent(sessions.rounds_of(one, "session", "pos"))
    outcome = F.when(sessions.is_prompt_only(), "prompt-only").otherwise("stored")
    return rounds.withColumn("outcome", outcome).withColumn("bucket", bucket_of("session", buckets))


def digest(
    spark: SparkSession, source: str, output: str, checkpoint: str, schema: str = "conv_id long, turn long, role string, text string",
    session: str = "conv_id", pos: str = "turn", role: str = "role", text: str = "text", buckets: int = 32, files_per_batch: int = 1000,
) -> dict:
    """Turn the new files of `source` into rounds; gives the counts of this run.

    `source` is a folder or a pattern; a single file can only be named by a pattern.
    `schema` names the columns that are read; files may have more. Rows without a
    session or a position can't be placed: they are counted as rejected. A bucket is
    the unit of work that is made anew, so choose `buckets` once, as many as the
    store's messages need to be some hundred MB each; the number can't be changed
    under a checkpoint.
    """
    kept, made, notes = f"{output}/messages", f"{output}/rounds", f"{output}/log"
    runs: list[dict] = []

    def apply(batch: DataFrame, number: int) -> None:
        here, kinds = batch.sparkSession, dict(batch.dtypes)
        fresh = messages_of(batch, session, pos, role, text, buckets)
        placed = F.col("session").isNotNull() & F.col("pos").isNotNull()
        _write(rebalanced(fresh.where(placed), "bucket").withColumn("batch", F.lit(number).cast("long")), kept, "bucket", "batch")
        rejected = fresh.where(~placed).count()
        stored = here.read.schema(f"session {kinds[session]}, pos {kinds[pos]}, role string, text string, bucket int, batch long").parquet(kept)
        new = stored.where(F.col("batch") == number)
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # `buckets` numbers at most
        mine = F.col("bucket").isin(touched)
        rounds = rounds_of_messages(stored.where(mine & (F.col("batch") <= number)), buckets)
        _write(rebalanced(rounds, "bucket"), made, "bucket")
        n, who = new.agg(F.count(F.lit(1)), F.count_distinct("session")).first()
        n_rounds = here.read.schema(rounds.schema).parquet(made).where(mine).count()
        row = (number, n, rejected, who, len(touched), n_rounds)
        _write(here.createDataFrame([row], LOG).coalesce(1), notes, "batch", form="json")
        runs.append(dict(zip(("batch", "messages", "rejected", "sessions", "buckets", "rounds"), row)))
        log.info("batch %d of %s: %d messages of %d sessions read, %d rejected; %d buckets with %d rounds written to %s", number, source, n, who, rejected, len(touched), n_rounds, made)

    # files are taken whatever their age
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("maxFileAge", "36500d").parquet(source)
    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%d batches of %s", len(runs), source)
    return {"batches": len(runs), **{k: sum(r[k] for r in runs) for k in ("messages", "rejected")}, "log": runs}


if __name__ == "__main__":
    raise SystemExit(main(digest, "digest.json"))
