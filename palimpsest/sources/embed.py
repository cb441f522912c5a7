"""Embedding source: any function from texts to vectors, called on Arrow batches, with retries."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str], str], list[list[float]]]


class Transient(Exception):
    """An error that may pass: a timeout, a busy or failing service."""


def hashing_embedder(texts: list[str], model: str, dim: int = 64) -> list[list[float]]:
    """A stand-in without a service: signed word hashes. Deterministic; equal words give equal directions, nothing more."""
    out = np.zeros((len(texts), dim))
    for row, t in zip(out, texts):
        for w in t.lower().split():
            h = int.from_bytes(hashlib.md5(f"{model}:{w}".encode()).digest()[:8], "big")
            row[h % dim] += 1 if h >> 63 else -1
    return out.tolist()


def with_retries(embed: Embedder, tries: int = 4, backoff_s: float = 1.0, sleep=time.sleep) -> Embedder:
    """Repeats transient failures after backoff, 2 backoff, 4 backoff ...; other errors pass at once."""

    def call(texts: list[str], model: str) -> list[list[float]]:
        for n in range(tries):
            try:
                return embed(texts, model)
            except Transient:
                if n == tries - 1:
                    raise
                sleep(backoff_s * 2**n)
        return []

    return call


def embed_texts(rows: DataFrame, text: str, model: str, embed: Embedder = hashing_embedder, calls_at_once: int | None = None) -> DataFrame:
    """Adds `vector`, from distinct non-null texts only; `calls_at_once` limits the tasks that call the service."""
    texts = rows.select(F.col(text).alias("_text")).where("_text is not null").distinct()
    if calls_at_once:
        texts = texts.repartition(calls_at_once)

    def run(batches: Iterator[pd.DataFrame]):
        for p in batches:
            yield pd.DataFrame({"_text": p["_text"], "vector": pd.Series(embed(p["_text"].tolist(), model), dtype=object)})

    found = texts.mapInPandas(run, "_text string, vector array<double>")
    return rows.join(found, rows[text] == found["_text"], "left").drop("_text")
