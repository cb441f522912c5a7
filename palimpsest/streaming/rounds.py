"""Rounds and topics from a stream of messages, and an idempotent sink.

A round is closed by the next user message of its session (punctuation, not
time), so state is one open round a session; a timeout lets idle sessions close.
Results equal the batch operators' over the same messages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palimpsest.functions import text as X
from palimpsest.operators.grouping import THRESHOLD, Topics
from palimpsest.sources.scratch import exists

ROUND = "session long, round int, prompt string, raw string, n_messages int"
_STATE = "round int, prompt string, parts array<string>, n int, last long"


def stream_rounds(messages: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Closed rounds of a stream (session, pos, role, text), with a processing-time timeout for the last of a session.

    Messages of a session must arrive in the order of pos over batches; within a
    batch they are sorted. Later copies of a position that was seen are left out.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        no, prompt, parts, n, last = state.get if state.exists else (0, None, [], 0, -1)
        parts = list(parts or [])
        out = []

        def close() -> None:
            if prompt is not None:
                out.append((key[0], no, prompt, "\n\n".join(parts), n))

        if state.hasTimedOut:
            close()
            state.remove()
        else:
            for m in pd.concat(list(batches)).sort_values("pos").itertuples():
                if m.pos <= last:
                    continue
                last, text = int(m.pos), m.text or ""
                if m.role == "user":
                    close()
                    no, prompt, parts, n = no + 1, text, [], 1
                elif prompt is not None:
                    n += 1
                    parts += [text] if m.role == "assistant" and text else []
            state.update((no, prompt, parts, n, last))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["session", "round", "prompt", "raw", "n_messages"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    closed = messages.select("session", "pos", "role", "text").groupBy("session").applyInPandasWithState(run, ROUND, _STATE, "append", timeout)
    raw, asked = X.trim_unicode("raw"), X.trim_unicode("prompt")
    return closed.select(
        "session",
        (F.col("round") - 1).alias("turn_index"),
        X.round_file(asked, X.strip_followup(raw)).alias("round_file"),
        asked.alias("userPrompt"),
        X.strip_followup(raw).alias("responseSequence"),
        X.needs_followup(raw).alias("needsFollowup"),
        "n_messages",
    )


def stream_topics(rounds: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(session, pos, topic) of a stream (session, pos, vector); state: a session's centroids and their sizes."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flat, dims, sizes = state.get if state.exists else ([], [], [])
        cuts = np.cumsum([0, *dims])
        t = Topics(threshold, [np.array(flat[a:b], float) for a, b in zip(cuts, cuts[1:])], list(sizes))
        p = pd.concat(list(batches)).sort_values("pos")
        topic = [t.assign(v) for v in p["vector"]]
        state.update(([float(x) for c in t.centroids for x in c], [len(c) for c in t.centroids], [int(s) for s in t.sizes]))
        yield pd.DataFrame({"session": key[0], "pos": p["pos"], "topic": topic})

    return rounds.groupBy("session").applyInPandasWithState(run, "session long, pos long, topic int", "flat array<double>, dims array<int>, sizes array<int>", "append", GroupStateTimeout.NoTimeout)


def store_stream(rounds: DataFrame, path: str, checkpoint: str):
    """Runs what is there now into a Parquet table, each round once.

    A batch leaves out what other batches have stored already. One that is repeated
    after a failure writes its own files anew.
    """

    def write(df: DataFrame, batch: int) -> None:
        fresh = df.dropDuplicates(["round_file"])
        if exists(df.sparkSession, path):
            stored = df.sparkSession.read.parquet(path).where(F.col("batch") != batch).select("round_file")
            fresh = fresh.join(stored, "round_file", "left_anti").select(*df.columns)
        fresh.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return rounds.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
