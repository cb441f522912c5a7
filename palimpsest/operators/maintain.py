"""Maintenance of the store: coverage of rounds by index rows, duplicates, twins, orphans, migrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import text as X

FORCING = (":prompt", ":response")  # fixed value: suffixes whose staleness forces a new embedding


def forcing_rows(vectors: DataFrame, rounds: DataFrame) -> DataFrame:
    """Vector rows that a new embedding would replace and that may force one: a short prompt has no prompt row."""
    return forcing_of(vectors, rounds.select("round_file", X.is_short("userPrompt").alias("short")))


def forcing_of(vectors: DataFrame, short: DataFrame) -> DataFrame:
    """forcing_rows where it is known already which rounds are short: short (round_file, short)."""
    r = short.select("round_file", F.col("short").alias("_short"))
    return vectors.where(F.col("suffix").isin(*FORCING)).join(r, "round_file").where(~(F.col("_short") & (F.col("suffix") == ":prompt"))).drop("_short")


def coverage(rows: DataFrame, model: str) -> DataFrame:
    """(round_file, has_row, has_stale, covered) over forcing rows.

    A row without a model is current. A stale row matters only where its suffix
    has no current row: another host's stale row can not be replaced from here.
    """
    current = F.coalesce("model", F.lit(model)) == model
    by = rows.groupBy("round_file", "suffix").agg(F.bool_or(current).alias("c"), F.bool_or(~current).alias("s"))
    return by.groupBy("round_file").agg(F.lit(True).alias("has_row"), F.bool_or("s").alias("has_stale"), F.bool_and(F.col("c")).alias("covered"))


def classify_rounds(rounds: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Coverage of every stored round; rounds without rows are not covered."""
    c = coverage(forcing_rows(vectors, rounds), model)
    false = lambda n: F.coalesce(n, F.lit(False)).alias(n)
    return rounds.select("round_file").join(c, "round_file", "left").select("round_file", false("has_row"), false("has_stale"), false("covered"))


def own_shard_stale(vectors: DataFrame, rounds: DataFrame, own: str, model: str) -> DataFrame:
    """Rounds of which the own shard holds rows, but for some suffix only stale ones."""
    return coverage(forcing_rows(vectors.where(F.col("shard") == own), rounds), model).where("not covered").select("round_file")


def pending(classified: DataFrame, inline: int = 10) -> DataFrame:
    """One row: how many rounds are not covered, and whether they are too many to embed at once."""
    return classified.agg(F.count_if(~F.col("covered")).alias("pending")).withColumn("deferred", F.col("pending") > inline)


def orphan_rows(existing: DataFrame, reproduced: DataFrame) -> DataFrame:
    """Rows that a new embedding of their round does not write: they stay, with their own model."""
    return existing.join(reproduced.select("round_file", "suffix"), ["round_file", "suffix"], "left_anti")


def reembed(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    return fresh.unionByName(orphan_rows(existing, fresh), allowMissingColumns=True)


def duplicate_plan(records: DataFrame, cutoff: Column | int) -> DataFrame:
    """(key, keeper, filename): recovered copies, not older than the cutoff, of content that has a keeper.

    records (key, filename, recovered, mtime). The keeper is the earliest live
    record, else the earliest; ties by name. The keeper is an aggregate combined
    before the shuffle, so a key with many copies does not gather in one task.
    """
    keep = records.groupBy("key").agg(F.min_by("filename", F.struct("recovered", "mtime", "filename")).alias("keeper"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    cut = F.lit(cutoff) if isinstance(cutoff, int) else cutoff
    return records.join(keep.drop("_n"), "key").where((F.col("filename") != F.col("keeper")) & F.col("recovered") & (F.col("mtime") >= cut)).select("key", "keeper", "filename")


def foreign_guard(plan: DataFrame, vectors: DataFrame, own: str) -> DataFrame:
    """Planned files that no other host's shard refers to."""
    return plan.join(vectors.where(F.col("shard") != own).select(F.col("round_file").alias("filename")), "filename", "left_anti")


def marker_twins(rounds: DataFrame) -> DataFrame:
    """(round_file, twin, outcome) of rounds stored with their follow-up mark.

    The twin is the file that the content without the mark names: outcome
    'duplicate' if it exists and is flagged, 'twin-not-followup' if not flagged,
    'twin-missing' otherwise. Rounds already under that name are left out.
    """
    calls = "toolCalls" if "toolCalls" in rounds.columns else None
    own = rounds.where(X.needs_followup("responseSequence")).select("round_file", X.round_file("userPrompt", X.strip_followup("responseSequence"), calls).alias("twin"))
    twins = rounds.select(F.col("round_file").alias("twin"), F.coalesce("needsFollowup", F.lit(False)).alias("_flag"))
    outcome = F.when(F.col("_flag").isNull(), "twin-missing").when(F.col("_flag"), "duplicate").otherwise("twin-not-followup")
    return own.where("round_file <> twin").join(twins, "twin", "left").select("round_file", "twin", outcome.alias("outcome"))


def stale_content(rounds: DataFrame) -> DataFrame:
    """(target, files): files whose content names another file, by that name."""
    calls = "toolCalls" if "toolCalls" in rounds.columns else None
    named = rounds.select("round_file", X.round_file("userPrompt", "responseSequence", calls).alias("target"))
    return named.where("round_file <> target").groupBy("target").agg(F.array_sort(F.collect_list("round_file")).alias("files"))


def content_hash_migration(rounds: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plan, vectors): plan (round_file, target, action) renames a file to its content's name, or deletes it where the name is taken.

    Of several files with one content the first by name is renamed. Vector rows follow.
    """
    calls = "toolCalls" if "toolCalls" in rounds.columns else None
    named = rounds.select("round_file", X.round_file("userPrompt", "responseSequence", calls).alias("target"))
    w = W.partitionBy("target").orderBy((F.col("round_file") != F.col("target")), "round_file")
    plan = named.withColumn("_n", F.row_number().over(w)).where("round_file <> target").select("round_file", "target", F.when(F.col("_n") == 1, "rename").otherwise("delete").alias("action"))
    moved = vectors.join(plan.where("action = 'rename'").select("round_file", "target"), "round_file", "left").withColumn("round_file", F.coalesce("target", "round_file")).drop("target")
    return plan, moved


def update_row_keys(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Rows with round_file replaced by `target` of names (round_file, target) where there is one."""
    return rows.join(names, "round_file", "left").withColumn("round_file", F.coalesce("target", "round_file")).drop("target")


def erase_short(vectors: DataFrame, rounds: DataFrame) -> DataFrame:
    """Vector rows without the prompt and response rows of rounds with a short prompt."""
    short = rounds.where(X.is_short("userPrompt")).select("round_file")
    doomed = F.col("suffix").isin(*FORCING)
    return vectors.where(~doomed).unionByName(vectors.where(doomed).join(short, "round_file", "left_anti").select(*vectors.columns))


def input_staleness(prompt_rows: DataFrame, rounds: DataFrame) -> DataFrame:
    """(round_file, reason): the worst of a round's prompt rows: 'hash-mismatch', 'legacy' or 'current'.

    prompt_rows (round_file, input_hash), rounds (round_file, current_hash,
    has_vec_hash). A legacy capture is current only under a matching assumed
    hash; a later one under a matching hash.
    """
    bare = F.regexp_replace("input_hash", "^assumed-", "")
    match = F.coalesce(bare == F.col("current_hash"), F.lit(False))
    assumed = F.coalesce(F.col("input_hash").startswith("assumed-"), F.lit(False))
    rank = F.when(F.col("has_vec_hash"), F.when(match, 0).otherwise(2)).otherwise(F.when(assumed & match, 0).otherwise(1))
    names = F.array(F.lit("current"), F.lit("legacy"), F.lit("hash-mismatch"))
    return prompt_rows.join(rounds, "round_file").groupBy("round_file").agg(F.max(rank).alias("_r")).select("round_file", F.element_at(names, F.col("_r") + 1).alias("reason"))


def concurrent_appends(now: DataFrame, before: DataFrame) -> DataFrame:
    """Rows of `now` beyond those of `before`, repeats counted."""
    return now.exceptAll(before)


def shard_summary(rows: DataFrame, own: str) -> DataFrame:
    """(shard, n_rows, rounds) of the other hosts' shards, for records that list them: see shard_rounds for large ones."""
    return rows.where(F.col("shard") != own).groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.array_sort(F.collect_set("round_file")).alias("rounds"))


def shard_rounds(rows: DataFrame, own: str) -> DataFrame:
    """(shard, round_file, n_rows) of the other hosts' shards: a row for each round, so no shard gathers in one cell."""
    return rows.where(F.col("shard") != own).groupBy("shard", "round_file").agg(F.count(F.lit(1)).alias("n_rows"))


def persist_outcomes(rounds: DataFrame, stored: DataFrame) -> DataFrame:
    """(session, turn_index, round_file, outcome) of rounds (those columns and userPrompt) that are to be stored.

    'no-prompt' without words of the user; 'dedup' where the file is stored
    already, or an earlier round of the table has it; 'blocked' where an earlier
    round of the session is neither stored nor to be saved, so that a gap would
    stay; else 'saved'.
    """
    known = stored.select("round_file").distinct().withColumn("_stored", F.lit(True))
    first = F.row_number().over(W.partitionBy("round_file").orderBy("session", "turn_index")) == 1
    blank = F.coalesce(X.trim_unicode("userPrompt"), F.lit("")) == ""
    x = rounds.withColumn("_first", first).join(known, "round_file", "left").withColumn("_blank", blank)
    before = W.partitionBy("session").orderBy("turn_index").rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumn("_gap", F.coalesce(F.max(F.col("_blank") & F.col("_stored").isNull()).over(before), F.lit(False)))
    outcome = F.when(F.col("_stored") | (~F.col("_blank") & ~F.col("_first")), "dedup").when(F.col("_blank"), "no-prompt").when(F.col("_gap"), "blocked").otherwise("saved")
    return x.select("session", "turn_index", "round_file", outcome.alias("outcome"))


def missing_rounds(parsed: DataFrame, stored: DataFrame) -> DataFrame:
    """Parsed rounds that are stored neither under their name nor, but for outer white space, under another.

    All of a log's rounds are compared, so a gap before a stored round is found too.
    """
    by_name = parsed.join(stored.select("round_file"), "round_file", "left_anti")
    key = lambda df: X.duplicate_key("userPrompt", "responseSequence", "toolCalls" if "toolCalls" in df.columns else None)
    return by_name.withColumn("_key", key(by_name)).join(stored.select(key(stored).alias("_key")).distinct(), "_key", "left_anti").drop("_key")


def heal_embedding(rounds: DataFrame, vectors: DataFrame) -> DataFrame:
    """promptEmbedding of rounds that lack it, from their response row."""
    v = vectors.where("suffix = ':response'").groupBy("round_file").agg(F.min_by("vector", F.struct("shard", "pos")).alias("_v"))
    return rounds.join(v, "round_file", "left").withColumn("promptEmbedding", F.coalesce("promptEmbedding", "_v")).drop("_v")


def repair_from_log(broken: DataFrame, parsed: DataFrame) -> DataFrame:
    """(round_file, target): broken round files and the file of the parsed round with the same entry id."""
    return broken.select("round_file", "id").join(parsed.select("id", F.col("round_file").alias("target")), "id", "left").select("round_file", "target")


def embed_rows(rounds: DataFrame, clean: Column, response: Column) -> DataFrame:
    """(round_file, suffix, text) to embed for each round: a short prompt gives its response alone; a summary is added where there is one.

    suffix ':combined' is the text of the round's own vector.
    """
    short = X.is_short("userPrompt")
    part = lambda s, t, c=None: F.when(F.lit(True) if c is None else c, F.struct(F.lit(s).alias("suffix"), t.alias("text")))
    summary = F.col("summaryText") if "summaryText" in rounds.columns else F.lit(None).cast("string")
    rows = F.array(
        part(":prompt", clean, ~short), part(":response", response), part(":combined", F.when(short, response).otherwise(F.concat(clean, F.lit("\n\n"), response))), part(":summary", summary, F.coalesce(summary != "", F.lit(False)))
    )
    return rounds.select("round_file", F.explode(F.array_compact(rows)).alias("r")).select("round_file", "r.*")


def record_backlog(backlog: DataFrame, script: str, shards: DataFrame, at: str) -> DataFrame:
    """The backlog with a script's entries replaced by what it left of other hosts' shards (shard, n_rows, rounds)."""
    added = shards.select(F.lit(script).alias("script"), "shard", "n_rows", "rounds", F.lit(at).alias("recorded_at"))
    return backlog.where(F.col("script") != script).unionByName(added)


def clear_backlog(backlog: DataFrame, script: str, shards: list[str]) -> DataFrame:
    """The backlog without a script's entries for these shards: their host has done them."""
    return backlog.where(~((F.col("script") == script) & F.col("shard").isin(shards)))
