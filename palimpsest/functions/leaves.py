"""Searchable text of tool calls: the string leaves of JSON of any depth."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def string_leaves(value) -> list[str]:
    out, stack = [], [value]
    while stack:
        v = stack.pop()
        if isinstance(v, str):
            out.append(v)
        elif isinstance(v, (list, dict)):
            stack.extend(reversed(list(v.values() if isinstance(v, dict) else v)))
    return out


def searchable(name: str | None, arguments: str | None) -> str:
    try:
        parts = string_leaves(json.loads(arguments or ""))
    except (ValueError, RecursionError):
        parts = [arguments or ""]
    return re.sub(r"\s+", " ", " ".join([name or "", *parts]).lower()).strip()


@F.pandas_udf(T.StringType())
def searchable_text(name: pd.Series, arguments: pd.Series) -> pd.Series:
    return pd.Series([searchable(n, a) for n, a in zip(name, arguments)], dtype=object)
