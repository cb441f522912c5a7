"""Sessionizing logs into rounds: a user message opens a round, what follows attaches to it."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import count as counting
from itertools import groupby
from operator import itemgetter
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.functions.envelope import split_prompt
from palimpsest.sources.schemas import PARSED_ROUND

RESULT_CLIP = 300  # fixed value: characters of a result that its summary keeps


def rounds_of(messages: DataFrame, session: str, pos: str, role: str = "role", text: str = "text", ts: Column | None = None) -> DataFrame:
    """Rounds of plain messages (role user or assistant, text).

    (session, turn_index, round_file, userPrompt, responseSequence, needsFollowup,
    userTimestamp, responseEndTimestamp, n_messages). What comes before the first
    user message is left out; a follow-up mark is cut off before the hash is
    taken; a round ends where the next begins.
    """
    m = messages.select(F.col(session).alias("session"), F.col(pos).alias("pos"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"), (F.col(pos) if ts is None else ts).alias("ts"))
    opened = F.sum((F.col("role") == "user").cast("int")).over(W.partitionBy("session").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    m = m.withColumn("round", opened).where("round > 0")
    said = F.filter(F.array_sort(F.collect_list(F.struct("pos", "role", "text"))), lambda x: (x["role"] == "assistant") & (x["text"] != ""))
    r = m.groupBy("session", "round").agg(
        F.max(F.when(F.col("role") == "user", F.col("text"))).alias("_prompt"),
        F.max(F.when(F.col("role") == "user", F.col("ts"))).alias("userTimestamp"),
        F.array_join(F.transform(said, lambda x: x["text"]), "\n\n").alias("_raw"),
        F.count(F.lit(1)).alias("n_messages"),
    )
    r = r.withColumn("userPrompt", X.trim_unicode("_prompt")).withColumn("_raw", X.trim_unicode("_raw"))
    r = r.withColumn("responseSequence", X.strip_followup("_raw")).withColumn("needsFollowup", X.needs_followup("_raw"))
    order = W.partitionBy("session").orderBy("round")
    return r.select(
        "session",
        (F.row_number().over(order) - 1).alias("turn_index"),
        X.round_file("userPrompt", "responseSequence").alias("round_file"),
        "userPrompt",
        "responseSequence",
        "needsFollowup",
        "userTimestamp",
        F.lead("userTimestamp").over(order).alias("responseEndTimestamp"),
        "n_messages",
    )


def is_prompt_only(response: Column | str = "responseSequence", tool_calls: Column | str | None = None) -> Column:
    """Rounds without an answer and without tool calls are not stored."""
    none = F.coalesce(F.size(X.col(tool_calls)), F.lit(0)) <= 0 if tool_calls is not None else F.lit(True)
    return (F.coalesce(X.col(response), F.lit("")) == "") & none


def with_parent(rounds: DataFrame) -> DataFrame:
    """parentId: the round before in the session."""
    return rounds.withColumn("parentId", F.lag("round_file").over(W.partitionBy("session").orderBy("turn_index")))


def with_related_parent(rounds: DataFrame, topic: str = "topic") -> DataFrame:
    """relatedParentId: the round before in the same topic of the session."""
    return rounds.withColumn("relatedParentId", F.lag("round_file").over(W.partitionBy("session", topic).orderBy("turn_index")))


# -- logs with tool calls. A dialect's reader turns lines into events of a common form; rounds are the stretches from one
# question to the next, and what a round consists of is read off its events.


class Event(NamedTuple):
    kind: str  # ask, say, call, result or other
    text: str = ""
    id: str | None = None  # of the entry for a question, of the call for calls and results
    name: str | None = None  # of a tool
    arguments: object = None
    ts: int | None = None
    about: dict | None = None  # columns that a question gives its round


def _string(x) -> str | None:
    return x if isinstance(x, str) else None


def _objects(lines: list[str], strict: bool) -> Iterator[dict]:
    """The lines that are JSON objects; one that is no JSON raises if `strict`."""
    for n, line in enumerate(lines, 1):
        try:
            value = json.loads(line)
        except ValueError as x:
            if strict:
                raise ValueError(f"line {n}: invalid JSON: {x}") from x
            continue
        if isinstance(value, dict):
            yield value


def _blocks(content, *kinds: str) -> list[dict]:
    return [b for b in content if isinstance(b, dict) and b.get("type") in kinds] if isinstance(content, list) else []


def _spoken(block: dict) -> str:
    """A text or thinking block as it stands in a response; empty if it says nothing."""
    text = _string(block.get("text")) or ""
    return f"[thinking] {text} [/thinking]" if text and block["type"] == "thinking" else text


def _host_events(lines: list[str]) -> Iterator[Event]:
    for e in _objects(lines, strict=False):
        m = e.get("message")
        if e.get("type") != "message" or not isinstance(m, dict):
            continue
        content = m.get("content")
        if m.get("role") == "user":
            asked = " ".join(b["text"] for b in _blocks(content, "text") if _string(b.get("text")) is not None)
            ts = m.get("timestamp")
            yield Event("ask", split_prompt(asked.strip())[0], e.get("id") or "", ts=None if ts is None else int(ts))
        elif m.get("role") == "assistant":
            for b in _blocks(content, "text", "thinking", "toolCall"):
                if b["type"] == "toolCall":
                    yield Event("call", id=_string(b.get("id")), name=_string(b.get("name")), arguments=b.get("arguments"))
                elif said := _spoken(b):
                    yield Event("say", said)
        elif m.get("role") == "toolResult":
            said = " ".join(filter(None, map(_spoken, _blocks(content, "text", "thinking"))))
            yield Event("result", said, _string(m.get("toolCallId")), m.get("toolName") or None)


def _import_text(content, results: bool = False) -> str:
    """The texts of a message's content by lines; with `results`, those in tool results too."""
    if isinstance(content, str):
        return content.strip()
    parts = []
    for b in _blocks(content, "text", *["tool_result"] * results):
        if b["type"] == "tool_result":
            inner = b.get("content")
            parts += [inner] if isinstance(inner, str) else [_import_text(inner, True)] if isinstance(inner, list) else []
        elif _string(b.get("text")) is not None:
            parts.append(b["text"])
    return "\n".join(parts).strip()


def _millis(stamp) -> int:
    t = pd.to_datetime(stamp, utc=True, errors="coerce") if isinstance(stamp, str) else pd.NaT
    return 0 if t is pd.NaT else int(t.timestamp() * 1000)


def _import_events(lines: list[str], sidechains: bool = False) -> Iterator[Event]:
    for e in _objects(lines, strict=True):
        if e.get("isSidechain") and not sidechains:
            continue
        m = e.get("message") if isinstance(e.get("message"), dict) else {}
        content, ts = m.get("content"), _millis(e.get("timestamp"))
        if e.get("type") == "user" and (str(content).strip() if isinstance(content, str) else any(str(b.get("text") or "").strip() for b in _blocks(content, "text"))):
            about = {"source": "import", "cwd": e.get("cwd"), "gitBranch": e.get("gitBranch"), "sourceSession": e.get("sessionId")}
            yield Event("ask", split_prompt(_import_text(content))[0], ts=ts, about=about)
        elif e.get("type") == "user":
            yield from (Event("result", _import_text([b], True), _string(b.get("tool_use_id"))) for b in _blocks(content, "tool_result"))
        elif e.get("type") == "assistant" and isinstance(content, list):
            yield Event("other", ts=ts or None)
            for b in _blocks(content, "text", "tool_use"):
                if b["type"] == "tool_use":
                    yield Event("call", id=_string(b.get("id")), name=_string(b.get("name")), arguments=b.get("input"))
                elif (_string(b.get("text")) or "").strip():
                    yield Event("say", b["text"])


def _rounds(events: Iterable[Event]) -> list[list[Event]]:
    """Stretches from one question to the next; what comes before the first is left out."""
    numbered, n = [], 0
    for e in events:
        n += e.kind == "ask"
        numbered.append((n, e))
    return [[e for _, e in stretch] for n, stretch in groupby(numbered, itemgetter(0)) if n]


def _first_open(calls: list[Event], claimed: dict[int, str], call_id: str | None) -> int | None:
    """The first call of that id without a result, else the last call without one."""
    free = [i for i in range(len(calls)) if not claimed.get(i)]
    return next((i for i in free if call_id is not None and calls[i].id == call_id), free[-1] if free else None)


def _own_or_open(calls: list[Event], claimed: dict[int, str], call_id: str | None) -> int | None:
    """The last call of that id, whose result is replaced; for a result without an id the last call without one."""
    fits = [i for i, c in enumerate(calls) if (c.id == call_id if call_id is not None else not claimed.get(i))]
    return fits[-1] if fits else None


def _tool_calls(events: list[Event], claims, whole: bool) -> list[dict]:
    calls: list[Event] = []
    claimed: dict[int, str] = {}
    for e in events:
        if e.kind == "call":
            calls.append(e)
        elif e.kind == "result" and (i := claims(calls, claimed, e.id)) is not None:
            claimed[i] = e.text if whole else e.text[:RESULT_CLIP]
    return [
        {
            "index": i,
            "id": c.id,
            "name": c.name or "unknown",
            "arguments": json.dumps({} if c.arguments is None else c.arguments, ensure_ascii=False, separators=(",", ":")),
            "result_summary": claimed.get(i, "")[:RESULT_CLIP],
            "result_full": claimed.get(i) if whole else None,
            "result_truncated": False if whole and i in claimed else None,
        }
        for i, c in enumerate(calls)
    ]


def _row(events: list[Event], response: str, end: int, turn: int, follow: bool, calls: list[dict]) -> dict:
    asked, *rest = events
    shown, number = [e for e in rest if e.kind in ("say", "call")], counting()
    segment = lambda e: {"type": "text", "text": e.text, "toolCallIndex": None} if e.kind == "say" else {"type": "toolCall", "text": None, "toolCallIndex": next(number)}
    return {
        "id": asked.id,
        "userPrompt": asked.text,
        "responseSequence": response,
        "turnIndex": turn,
        "userTimestamp": asked.ts or 0,
        "responseEndTimestamp": end,
        "toolCallCount": len(calls),
        "toolCallNames": list(dict.fromkeys(e.name for e in rest if e.name)),
        "toolCalls": calls,
        "responseSegments": [segment(e) for e in shown],
        "needsFollowup": follow,
    } | (asked.about or {})


def _response(events: list[Event]) -> str:
    return "\n\n".join(e.text for e in events if e.kind == "say").strip()


def _host_rounds(lines: list[str], now: int, skip_short: bool) -> list[dict]:
    """Rounds of a log of the host's dialect. A log of one short answer alone has none if `skip_short`."""
    rounds = _rounds(_host_events(lines))
    if skip_short and len(rounds) == 1 and len(_response(rounds[0])) < 20:
        return []
    ends = [now if r[0].ts is None else r[0].ts for r in rounds[1:]] + [now]
    out = []
    for turn, (events, end) in enumerate(zip(rounds, ends)):
        raw = _response(events)
        answer = raw.removesuffix(X.FOLLOWUP_MARKER)
        follow = answer != raw
        out.append(_row(events, answer.rstrip() if follow else raw, end, turn, follow, _tool_calls(events, _first_open, True)))
    return out


def _import_rounds(lines: list[str], now: int) -> list[dict]:
    """Rounds of a log of the import dialect with a prompt and an answer of some length. A line that is no JSON raises."""
    out = []
    for events in _rounds(_import_events(lines)):
        response = _response(events)
        if events[0].text and len(response) >= 20:
            end = [e.ts for e in events if e.ts][-1:] or [now]
            out.append(_row(events, response, end[0], len(out), False, _tool_calls(events, _own_or_open, False)))
    return out


def parse_logs(files: DataFrame, dialect: str = "host", now: int = 0, skip_short_final: bool = False) -> DataFrame:
    """Rounds of whole log files (path, content), one session each; see PARSED_ROUND.

    dialect 'host' leaves out broken lines; in 'import' a broken line makes the
    file one row with `error` and no round. round_file hashes tool calls in the
    host's dialect, prompt and response only in the other. Files are independent,
    so a lost task parses its own files anew.
    """

    def run(batches):
        for p in batches:
            rows = []
            for path, content in zip(p["path"], p["content"]):
                lines = [x for x in (content or "").split("\n") if x.strip()]
                try:
                    found = _host_rounds(lines, now, skip_short_final) if dialect == "host" else _import_rounds(lines, now)
                    rows += [{"session": path, "error": None} | r for r in found]
                except ValueError as x:
                    rows.append({"session": path, "error": str(x)})
            yield pd.DataFrame(rows, columns=PARSED_ROUND.names).astype(object).where(lambda d: d.notna(), None) if rows else pd.DataFrame(columns=PARSED_ROUND.names)

    out = files.select("path", "content").mapInPandas(run, PARSED_ROUND)
    calls = "toolCalls" if dialect == "host" else None
    out = out.withColumn("round_file", F.when(F.col("error").isNull(), X.round_file("userPrompt", "responseSequence", calls)))
    return out.withColumn("id", F.coalesce("id", F.regexp_replace("round_file", r"\.json$", "")))
