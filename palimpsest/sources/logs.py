"""Session logs (JSONL) as whole files, and the tool index as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_logs(spark: SparkSession, path: str, modified_after_ms: int | None = None) -> DataFrame:
    """(path, content, modified_ms) of every *.jsonl file under `path`: line order is kept, a file is one session."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(path, wholetext=True)
    files = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"), F.unix_millis("_metadata.file_modification_time").alias("modified_ms"))
    return files if modified_after_ms is None else files.where(F.col("modified_ms") > modified_after_ms)


def tail_is_closed(content) -> "F.Column":
    """Whether a log's last assistant message is finished: its stop reason is not `toolUse`."""
    lines = F.filter(F.split(content, "\n"), lambda x: F.get_json_object(x, "$.message.role") == "assistant")
    return F.coalesce(F.get_json_object(F.try_element_at(lines, F.lit(-1)), "$.message.stopReason") != "toolUse", F.lit(True))


def parse_tool_lines(lines: DataFrame) -> DataFrame:
    """(round_file, tool_index, tool_name, searchable) of lines (value); the text may hold commas, broken lines are left out."""
    f = F.split("value", ",", 4)
    rows = lines.select(F.get(f, F.lit(0)).alias("round_file"), F.get(f, F.lit(1)).try_cast("int").alias("tool_index"), F.get(f, F.lit(2)).alias("tool_name"), F.get(f, F.lit(3)).alias("searchable"))
    return rows.where("searchable is not null and tool_index is not null")


def format_tool_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat_ws(",", "round_file", "tool_index", "tool_name", "searchable").alias("value"))


def newest_first(files: DataFrame, most: int | None = None) -> DataFrame:
    """Files by their time of change, the newest first, unknown times last, ties by path; at most `most` of them."""
    ordered = files.orderBy(F.col("modified_ms").desc_nulls_last(), "path")
    return files.sparkSession.createDataFrame([], files.schema) if most == 0 else ordered.limit(most) if most else ordered


def last_examined(files: DataFrame, before: int = 0) -> DataFrame:
    """One row: the time up to which files have been examined, which never goes back."""
    return files.agg(F.greatest(F.coalesce(F.max("modified_ms"), F.lit(0)), F.lit(before)).alias("examined_ms"))


def new_rounds(parsed: DataFrame, stored: DataFrame, most: int | None = None) -> DataFrame:
    """Rounds of an import that are not stored, each once, the earliest first; `most` counts after that."""
    fresh = parsed.join(stored.select("round_file"), "round_file", "left_anti").groupBy("round_file").agg(F.min("userTimestamp").alias("userTimestamp"))
    ordered = fresh.orderBy("userTimestamp", "round_file")
    return ordered.limit(most) if most else ordered
