"""Text expressions. All are built-in Catalyst expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the class that a lexical token consists of, after lower-casing.
TOKEN_CLASS = r"[a-z0-9_./:-]+"
#: Fixed value: marks, alone on the last line of a response, that the next round belongs to the same topic.
FOLLOWUP_MARKER = "\nround_needs_followup"
#: What stands for tool calls that were taken out of a response.
REDACTED = r"\[(?:Tool call )?REDACTED[^\]]*\]\n?"
#: Fixed value: a query that names a file or a path.
PATH_QUERY = r"(?:^|\s)(?:[./~]?[-\w]+/[-\w./]+|[-\w]+\.[A-Za-z0-9]{1,10})(?:\s|$)"
#: White space at either end, in the wide sense (Unicode), unlike trim().
_LEFT, _RIGHT = r"(?U)^[\s﻿]+", r"(?U)[\s﻿]+$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_unicode(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(c), _LEFT, ""), _RIGHT, "")


def rtrim_unicode(c: Column | str) -> Column:
    return F.regexp_replace(col(c), _RIGHT, "")


def stem(token: Column | str) -> Column:
    """Drops the first of -ing, -ed, -ies (to y), -es, -s that the token's length allows."""
    t = col(token)
    n = F.length(t)
    cut = lambda k: F.substring(t, F.lit(1), n - k)
    rules = (("ing", 5, cut(3)), ("ed", 4, cut(2)), ("ies", 4, F.concat(cut(3), F.lit("y"))), ("es", 4, cut(2)), ("s", 3, cut(1)))
    out = t
    for suffix, longer, to in reversed(rules):
        out = F.when((n > longer) & t.endswith(suffix), to).otherwise(out)
    return out


def bm25_tokens(text: Column | str) -> Column:
    """Array of stemmed tokens: each run of TOKEN_CLASS, then its parts between . / : - where it has several."""
    raw = F.regexp_extract_all(F.lower(col(text)), F.lit(f"({TOKEN_CLASS})"), 1)
    parts = lambda r: F.filter(F.split(r, "[./:-]+"), lambda p: (p != "") & (p != r))
    return F.coalesce(F.flatten(F.transform(raw, lambda r: F.transform(F.concat(F.array(r), parts(r)), stem))), F.array().cast("array<string>"))


def token_runs(lowered: Column) -> Column:
    return F.regexp_extract_all(lowered, F.lit(f"({TOKEN_CLASS})"), 1)  # unlike split(), it compiles its pattern once


def has_border(run: Column) -> Column:
    return run.contains(".") | run.contains("-") | run.contains(":") | run.contains("/")


def token_parts(run: Column) -> Column:
    """What stands between the borders of a run that has some."""
    return F.regexp_extract_all(run, F.lit("([a-z0-9_]+)"), 1)


def token_bag(text: Column | str) -> Column:
    """The same tokens in another order and before stemming: stemming them once exploded stays in generated code."""
    runs = token_runs(F.lower(col(text)))
    parts = F.flatten(F.transform(F.filter(runs, has_border), token_parts))
    return F.coalesce(F.concat(runs, parts), F.array().cast("array<string>"))


def golden_tokens(text: Column | str) -> Column:
    """Array of lower-case ASCII words; underscores and lower-to-upper borders separate."""
    spaced = F.regexp_replace(F.replace(col(text), F.lit("_"), F.lit(" ")), "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda w: w != "")


def lexical_overlap(query: Column | str, text: Column | str) -> Column:
    """How many distinct words of the query the text has."""
    return F.size(F.array_intersect(F.array_distinct(golden_tokens(query)), F.array_distinct(golden_tokens(text))))


def token_estimate(text: Column | str) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(col(text)) / 4)


def message_tokens(content: Column | str) -> Column:
    """Token estimate over an array of blocks (type, text): text blocks count, others do not."""
    return F.aggregate(col(content), F.lit(0).cast("long"), lambda a, b: a + F.coalesce(token_estimate(b["text"]), F.lit(0)))


def word_count(text: Column | str) -> Column:
    return F.size(F.filter(F.split(F.coalesce(col(text), F.lit("")), r"(?U)\s+"), lambda w: w != ""))


def is_short(text: Column | str, words: int = 20) -> Column:
    return word_count(text) < words


def first_words(text: Column | str, n: int = 200) -> Column:
    """Up to n pieces between single spaces."""
    return F.array_join(F.slice(F.split(col(text), " "), 1, n), " ")


def excerpt(text: Column | str, limit: int = 250) -> Column:
    flat = trim_unicode(F.regexp_replace(col(text), r"(?U)\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(rtrim_unicode(F.substring(flat, 1, limit - 1)), F.lit("…")))


def is_path_query(text: Column | str) -> Column:
    return F.coalesce(col(text), F.lit("")).rlike(PATH_QUERY)


def difficulty(prompt: Column | str, first_hit_rank: Column | str) -> Column:
    r = col(first_hit_rank)
    return F.when(is_path_query(prompt), "hard").when(r.isin(1, 2), "control").when(r.isNull(), "miss").otherwise("hard")


def needs_followup(response: Column | str) -> Column:
    return F.coalesce(col(response).endswith(FOLLOWUP_MARKER), F.lit(False))


def strip_followup(response: Column | str) -> Column:
    r = col(response)
    return F.when(needs_followup(r), rtrim_unicode(F.substring(r, F.lit(1), F.length(r) - len(FOLLOWUP_MARKER)))).otherwise(r)


def strip_prefix(text: Column | str, prefix: str) -> Column:
    t = col(text)
    return F.when(t.startswith(prefix), F.substring(t, len(prefix) + 1, 1 << 30)).otherwise(t)


def content_hash(prompt: Column | str, response: Column | str, tool_calls: Column | str | None = None) -> Column:
    """MD5 over prompt, response, then each call's arguments and result (full, else summary), nothing between."""
    parts = [F.coalesce(col(prompt), F.lit("")), F.coalesce(col(response), F.lit(""))]
    if tool_calls is not None:
        one = lambda t: F.concat(F.coalesce(t["arguments"], F.lit("")), F.coalesce(t["result_full"], t["result_summary"], F.lit("")))
        parts.append(F.coalesce(F.array_join(F.transform(col(tool_calls), one), ""), F.lit("")))
    return F.md5(F.concat(*parts))


def round_file(prompt: Column | str, response: Column | str, tool_calls: Column | str | None = None) -> Column:
    return F.concat(content_hash(prompt, response, tool_calls), F.lit(".json"))


def duplicate_key(prompt: Column | str, response: Column | str, tool_calls: Column | str | None = None) -> Column:
    """Equal for rounds that differ in outer white space only."""
    tools = F.array().cast("array<string>")
    if tool_calls is not None:
        result = lambda t: rtrim_unicode(F.coalesce(t["result_full"], t["result_summary"], F.lit("")))
        one = lambda t: F.concat_ws("\0", F.coalesce(t["name"], F.lit("")), F.coalesce(t["arguments"], F.lit("")), result(t))
        tools = F.coalesce(F.transform(col(tool_calls), one), tools)
    return F.to_json(F.struct(trim_unicode(F.coalesce(col(prompt), F.lit(""))).alias("p"), trim_unicode(F.coalesce(col(response), F.lit(""))).alias("r"), tools.alias("t")))


def input_stamp(text: Column | str) -> Column:
    """SHA-256 of an embedding input, base64url without padding."""
    return F.rtrim(F.translate(F.base64(F.unhex(F.sha2(col(text), 256))), "+/", "-_"), F.lit("="))


def response_input(response: Column | str, max_bytes: int = 24_000) -> Column:
    """The response as it is embedded: without redaction marks, at most max_bytes of UTF-8.

    Of a character that the limit cuts, nothing is left.
    """
    bare = F.regexp_replace(col(response), REDACTED, "")
    raw = F.encode(bare, "utf-8")
    # a character begins where the next byte is no continuation (10xxxxxx): step back to such a limit
    inside = lambda k: F.substring(F.hex(F.substring(raw, k + 1, 1)), 1, 1).isin("8", "9", "A", "B")
    limit = F.lit(max_bytes)
    for back in (3, 2, 1):
        limit = F.when(~inside(max_bytes - back), max_bytes - back).otherwise(limit)
    limit = F.when(~inside(max_bytes), max_bytes).otherwise(limit)
    return F.when(F.octet_length(bare) <= max_bytes, bare).otherwise(F.decode(F.substring(raw, F.lit(1), limit), "utf-8"))


def round_text(prompt: Column | str, response: Column | str, names: Column | str | None = None, tool_calls: Column | str | None = None) -> Column:
    """What the lexical index holds of a round: prompt, response, then tool names and each call's fields; empty parts are left out."""
    lines = []
    if names is not None:
        lines.append(F.coalesce(col(names), F.array().cast("array<string>")))
    if tool_calls is not None:
        fields = lambda t: F.array(*[F.coalesce(t[f], F.lit("")) for f in ("name", "arguments", "result_summary", "result_full")])
        lines.append(F.coalesce(F.flatten(F.transform(col(tool_calls), fields)), F.array().cast("array<string>")))
    tools = F.array_join(F.concat(*lines), "\n") if lines else F.lit("")
    return F.array_join(F.filter(F.array(col(prompt), col(response), tools), lambda p: p.isNotNull() & (p != "")), "\n\n")


def blocks_text(blocks: Column | str, sep: str = " ", thinking: bool = True) -> Column:
    """Text of message blocks (type, text): text blocks, and thinking blocks in their brackets."""
    kept = F.filter(col(blocks), lambda b: b["type"].isin(*(["text", "thinking"] if thinking else ["text"])) & (F.coalesce(b["text"], F.lit("")) != ""))
    mark = lambda b: F.when(b["type"] == "thinking", F.concat(F.lit("[thinking] "), b["text"], F.lit(" [/thinking]"))).otherwise(b["text"])
    return F.coalesce(F.array_join(F.transform(kept, mark), sep), F.lit(""))


def size_label(n: Column | str) -> Column:
    """Bytes as KB, with up to two decimals under one KB and none above, or as MB with up to two decimals."""
    n = col(n)
    two = lambda x: F.regexp_replace(F.format_string("%.2f", F.floor(x * 100 + 0.5) / 100), r"\.?0+$", "")
    whole = F.floor(n / 1024 + 0.5).cast("string")
    return F.when(n < 1024, F.concat(two(n / 1024), F.lit("KB"))).when(n < 1 << 20, F.concat(whole, F.lit("KB"))).otherwise(F.concat(two(n / (1 << 20)), F.lit("MB")))


def call_bytes(call: Column) -> Column:
    return F.coalesce(F.octet_length(F.coalesce(call["result_full"], call["result_summary"])), F.lit(0))


def tool_summary(tool_calls: Column | str, count: Column | str) -> Column:
    """'n tools (name×count (size), ...)' with names in order of their first call."""
    calls = col(tool_calls)
    names = F.array_distinct(F.transform(calls, lambda t: t["name"]))

    def part(name: Column) -> Column:
        own = F.filter(calls, lambda t: t["name"] == name)
        total = F.aggregate(own, F.lit(0), lambda a, t: a + call_bytes(t))
        label = F.concat(name, F.lit("×"), F.size(own).cast("string"))
        return F.when(total > 0, F.concat(label, F.lit(" ("), size_label(total), F.lit(")"))).otherwise(label)

    some = F.concat(col(count).cast("string"), F.lit(" tools ("), F.array_join(F.transform(names, part), ", "), F.lit(")"))
    return F.when(F.coalesce(F.size(calls), F.lit(0)) > 0, some).otherwise(F.concat(F.coalesce(col(count), F.lit(0)).cast("string"), F.lit(" tools")))


def truncate_prompt(prompt: Column | str, head: int = 260, tail: int = 140) -> Column:
    """Long prompts keep whole lines of their first `head` and last `tail` characters around a note of what is gone."""
    p = col(prompt)
    n = F.length(p)
    h, t = F.substring(p, 1, head), F.substring(p, F.greatest(n - tail + 1, F.lit(1)), F.lit(tail))
    last = F.length(h) - F.instr(F.reverse(h), "\n")  # characters before the last line break
    h = F.when((F.instr(h, "\n") > 0) & (last > 0), F.substring(h, F.lit(1), last)).otherwise(h)
    first = F.instr(t, "\n")
    t = F.when((first > 0) & (first < F.length(t)), F.substring(t, first + 1, F.length(t))).otherwise(t)
    gone = (n - F.length(h) - F.length(t)).cast("string")
    return F.when(n <= head + tail, p).otherwise(F.concat(h, F.lit("\n… ["), gone, F.lit(" chars elided] …\n"), t))


def entry_text(head: Column, prompt: Column | str) -> Column:
    """A list entry: its head line, the truncated prompt indented, a rule."""
    body = F.array_join(F.split(truncate_prompt(prompt), "\n"), "\n  ")
    return F.concat(head, F.lit("\n  user: "), body, F.lit("\n  ---"))


def relevance_entry(rank: Column, file: Column, score: Column, tools: Column, prompt: Column | str, size: Column | None = None) -> Column:
    tail = F.lit("") if size is None else F.coalesce(F.concat(F.lit(" | "), size), F.lit(""))
    head = F.concat(rank.cast("string"), F.lit(". "), file, F.lit(" ["), F.format_string("%.2f", score), F.lit(" | "), tools, tail, F.lit("]:"))
    return entry_text(head, prompt)


def recency_entry(rank: Column, file: Column, tools: Column, prompt: Column | str, size: Column | None = None) -> Column:
    tail = F.lit("") if size is None else F.coalesce(F.concat(F.lit(" | "), size), F.lit(""))
    head = F.concat(F.lit("- [index: "), rank.cast("string"), F.lit("] "), file, F.lit(" [n/a | "), tools, tail, F.lit("]:"))
    return entry_text(head, prompt)


def rebuild_segments(response: Column | str, tool_calls: Column | str) -> Column:
    """Segments for rounds that lack them: the whole text, then a mark for each tool call."""
    text = F.filter(
        F.array(F.struct(F.lit("text").alias("type"), col(response).alias("text"), F.lit(None).cast("int").alias("toolCallIndex"))), lambda s: trim_unicode(F.coalesce(s["text"], F.lit(""))) != ""
    )
    n = F.coalesce(F.size(col(tool_calls)), F.lit(0))
    marks = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.lit("toolCall").alias("type"), F.lit(None).cast("string").alias("text"), i.alias("toolCallIndex"))))
    return F.concat(text, F.coalesce(marks, F.array().cast("array<struct<type:string,text:string,toolCallIndex:int>>")))


def segments_text(file: Column | str, segments: Column | str, response: Column | str) -> Column:
    """A round's response with a stub for each tool call; without segments the response itself."""
    stub = lambda s: F.concat(F.lit('[Tool call REDACTED: use get_tool_details("'), col(file), F.lit('", '), s["toolCallIndex"].cast("string"), F.lit(") to expand]"))
    one = lambda s: F.when(s["type"] == "text", F.nullif(s["text"], F.lit(""))).when(s["toolCallIndex"].isNotNull(), stub(s))
    return F.when(F.size(col(segments)) > 0, F.array_join(F.transform(col(segments), one), "\n")).otherwise(F.coalesce(col(response), F.lit("(empty)")))


def checkpoint_text(summary: Column | str) -> Column:
    """A checkpoint's task and its lists, each under a title; empty lists are left out."""
    s = col(summary)
    part = lambda title, f: F.when(F.size(s[f]) > 0, F.concat(F.lit(f"{title}:\n- "), F.array_join(s[f], "\n- ")))
    task = F.concat(F.lit("Current Task: "), F.coalesce(s["currentTask"], F.lit("")))
    lists = (("Progress Made", "progressMade"), ("Current State", "currentState"), ("Next Steps", "nextSteps"), ("Key Findings / Decisions", "keyFindings"))
    return F.concat_ws("\n", task, *[part(*x) for x in lists])


def checkpoint_of_calls(tool_calls: Column | str, name: str = "checkpoint", accepted: str = "Checkpoint recorded") -> Column:
    """The summary in the arguments of the last call of that name whose result says that it was accepted; null without one."""
    shape = "currentTask string, progressMade array<string>, currentState array<string>, nextSteps array<string>, keyFindings array<string>"
    taken = F.filter(col(tool_calls), lambda t: t["name"].contains(name) & t["result_summary"].contains(accepted))
    parsed = F.transform(taken, lambda t: F.from_json(t["arguments"], shape))
    last = F.try_element_at(F.filter(parsed, lambda p: p["currentTask"].isNotNull() & p["progressMade"].isNotNull()), F.lit(-1))
    empty = F.array().cast("array<string>")
    lists = [F.coalesce(last[f], empty).alias(f) for f in ("progressMade", "currentState", "nextSteps", "keyFindings")]
    return F.when(last.isNotNull(), F.struct(last["currentTask"].alias("currentTask"), *lists))


def has_signal(log: Column | str, signals: tuple[str, ...] = ("search_interactions", "get_round_details", "get_tool_details", "RECENCY LIST", "RELEVANCE LIST")) -> Column:
    """Whether a session's log shows that retrieval was used in it: any of the signals."""
    out = F.lit(False)
    for s in signals:
        out = out | col(log).contains(s)
    return out


def expanded_round(arguments: Column | str) -> Column:
    """The round that a call's JSON arguments name: the first element of a list, or `round`; only strings count."""
    a = F.try_parse_json(col(arguments))
    out = F.lit(None).cast("string")
    for path in ("$.round", "$[0]"):
        v = F.try_variant_get(a, path, "variant")
        out = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(a, path, "string")).otherwise(out)
    return out


def key_parts(key: Column | str) -> tuple[Column, Column]:
    """(round file, suffix with its colon or null) of a vector row's key."""
    base = F.regexp_extract(col(key), r"([^/]*)$", 1)
    file = F.regexp_extract(base, r"^(.*?\.json)", 1)
    return F.when(file == "", base).otherwise(file), F.nullif(F.regexp_extract(base, r"\.json(:[A-Za-z]+)$", 1), F.lit(""))


def size_warning(tokens: Column | str, threshold: Column | float) -> Column:
    """3, 2, 1 from 100, 85, 70 % of the threshold; 0 under it."""
    share = col(tokens) / (threshold if isinstance(threshold, Column) else F.lit(float(threshold)))
    return F.when(share >= 1, 3).when(share >= 0.85, 2).when(share >= 0.7, 1).otherwise(0)


def loose_json(text: Column | str) -> Column:
    """From the first { to the last }, null without both."""
    return F.nullif(F.regexp_extract(col(text), r"(?s)(\{.*\})", 1), F.lit(""))


def fault_state(prompt: Column | str, response: Column | str, n_tools: Column | str, limit: int = 12_000) -> Column:
    """Prompt and response for a judge of rounds, tool calls counted only, at most `limit` characters."""
    note = F.when(col(n_tools) > 0, F.concat(F.lit("\n["), col(n_tools).cast("string"), F.lit(" tool calls in the response were redacted]"))).otherwise("")
    return F.substring(F.concat(F.lit("USER PROMPT:\n"), F.coalesce(col(prompt), F.lit("")), F.lit("\n\nASSISTANT RESPONSE:\n"), F.coalesce(col(response), F.lit("")), note), 1, limit)
