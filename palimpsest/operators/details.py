"""Drill-down into one text of each row: a page of lines, or the lines that match a pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_LINES = 200  # fixed value


def page(rows: DataFrame, key: str, text: str, from_line: int = 1, line_count: int = PAGE_LINES) -> DataFrame:
    """(key, page, first_line, last_line, total_lines, next_line): lines from_line on; next_line is null at the end."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    x = rows.select(key, lines.alias("_l"), F.size(lines).alias("total_lines"))
    start = max(0, from_line - 1)
    last = F.least(F.col("total_lines"), F.lit(start + line_count))
    body = F.array_join(F.slice("_l", F.lit(start + 1), F.lit(line_count)), "\n")
    return x.select(
        key,
        F.when(F.col("total_lines") <= start, "(empty)").otherwise(body).alias("page"),
        F.lit(start + 1).alias("first_line"),
        last.alias("last_line"),
        "total_lines",
        F.when(last < F.col("total_lines"), last + 1).alias("next_line"),
    )


def match_lines(rows: DataFrame, key: str, text: str, pattern: str, line_count: int = 0, max_matches: int = 1, prompt: str | None = None) -> DataFrame:
    """(key, match_no, line_no, source, context, shown, total): the first max_matches matching lines, each with line_count more.

    With `prompt`, the prompt's lines are searched first; a match there is the only
    one shown. Line numbers count from 1 within their text.
    """
    x = rows.select(key, F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("_l"), *([F.split(F.coalesce(F.col(prompt), F.lit("")), "\n").alias("_p")] if prompt else []))

    def hits(lines: str, source: str) -> Column:
        with_no = F.transform(lines, lambda l, i: F.struct((i + 1).alias("line_no"), F.lit(source).alias("source"), l.alias("line")))
        return F.filter(with_no, lambda s: s["line"].rlike("(?m)" + pattern))

    found = F.concat(hits("_p", "user"), hits("_l", "assistant")) if prompt else hits("_l", "text")
    x = x.withColumn("_h", found).withColumn("total", F.size("_h"))
    shown = F.when(F.get("_h", F.lit(0))["source"] == "user", 1).otherwise(F.least(F.col("total"), F.lit(max_matches)))
    x = x.withColumn("shown", shown).select("*", F.posexplode("_h").alias("_i", "m")).where(F.col("_i") < F.col("shown"))
    around = F.array_join(F.slice("_l", F.col("m.line_no"), F.lit(line_count + 1)), "\n")
    context = F.when(F.col("m.source") == "user", F.col("m.line")).otherwise(around)
    return x.select(key, (F.col("_i") + 1).alias("match_no"), "m.line_no", "m.source", context.alias("context"), "shown", "total")


def tool_call(rounds: DataFrame, index: int) -> DataFrame:
    """(round_file, name, arguments, result): one call of each round that has so many."""
    call = F.get("toolCalls", F.lit(index))
    return rounds.where(F.size("toolCalls") > index).select(
        "round_file", call["name"].alias("name"), call["arguments"].alias("arguments"), F.coalesce(call["result_full"], call["result_summary"], F.lit("")).alias("result")
    )
