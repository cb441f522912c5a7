"""Prompts that are serialized message lists: the user's own words are taken out of them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.fenced import blocks

#: Longer texts are not tried; what stands for an envelope without words of the user.
LENGTH_LIMIT, NOTE = 1_000_000, "[MESSAGE_ENVELOPE: ~{} chars]"


def _messages(text: str) -> list[dict] | None:
    """The messages of a text that is a JSON list of them, an object with such a list, or one message."""
    if not 0 < len(text) <= LENGTH_LIMIT or not text.strip().startswith(("{", "[")):
        return None
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return None
    listed = value.get("messages") if isinstance(value, dict) else value
    if isinstance(listed, list) and listed and all(isinstance(m, dict) and isinstance(m.get("role"), str) for m in listed):
        return listed
    if isinstance(value, dict) and isinstance(value.get("role"), str) and "content" in value:
        return [value]
    return None


def _words(content) -> str:
    if isinstance(content, str):
        return content.strip()
    if isinstance(content, list):
        texts = [b.get("text") for b in content if isinstance(b, dict) and b.get("type") == "text"]
        return "\n".join(t for t in texts if isinstance(t, str) and t).strip()
    return ""


def _last_user(messages: list[dict]) -> str | None:
    return next((w for m in reversed(messages) if m["role"] == "user" and (w := _words(m.get("content")))), None)


def split_prompt(text: str) -> tuple[str, bool]:
    """(the user's text, whether there was an envelope). Clean text passes unchanged."""
    if (messages := _messages(text)) is not None:
        return _last_user(messages) or NOTE.format(len(text)), True
    for block in blocks(text):
        body = text[block.body : block.close]
        if (messages := _messages(body)) is not None:
            note, before, after = NOTE.format(len(body)), text[: block.start], text[block.end :]
            alone = not (before + after).strip()
            return (_last_user(messages) or note) if alone else before + note + after, True
    return text, False


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("was_envelope", T.BooleanType())]))
def extract_envelope(prompt: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([split_prompt(t) if t is not None else (None, False) for t in prompt], columns=["text", "was_envelope"])
