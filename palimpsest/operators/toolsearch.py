"""Search over tool calls by how many of a query's keywords they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.leaves import searchable_text


def tool_rows(rounds: DataFrame) -> DataFrame:
    """(round_file, tool_index, tool_name, searchable): a row for each tool call."""
    calls = rounds.select("round_file", F.explode("toolCalls").alias("t"))
    return calls.select("round_file", F.col("t.index").alias("tool_index"), F.col("t.name").alias("tool_name"), searchable_text("t.name", "t.arguments").alias("searchable"))


def keywords(queries: DataFrame, query: str = "query", text: str = "text") -> DataFrame:
    """(query, keyword, total): distinct lower-case words; `total` counts repeats too."""
    words = F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")
    q = queries.select(F.col(query).alias("query"), words.alias("_w"))
    return q.select("query", F.explode(F.array_distinct("_w")).alias("keyword"), F.size("_w").alias("total"))


def search_tools(rows: DataFrame, queries: DataFrame, query: str = "query", text: str = "text") -> DataFrame:
    """(query, round_file, matched, total, score, tools): rounds with any keyword; score = matched distinct keywords / total.

    `tools` are the calls with a hit as (index, name) by index. The keyword table
    meets each call by a `contains` condition; Spark broadcasts it while it is small. Calls
    of a round that read alike are one before that, and hits are one before they are listed.
    """
    calls = rows.select("round_file", "tool_index", "tool_name", "searchable").distinct()
    hits = calls.join(keywords(queries, query, text), F.col("searchable").contains(F.col("keyword"))).select("query", "round_file", "total", "keyword", "tool_index", "tool_name").distinct()
    out = hits.groupBy("query", "round_file", "total").agg(
        F.size(F.collect_set("keyword")).cast("long").alias("matched"), F.array_sort(F.collect_set(F.struct(F.col("tool_index").alias("index"), F.col("tool_name").alias("name")))).alias("tools")
    )
    return out.withColumn("score", F.col("matched") / F.col("total"))
