"""Online topic clustering: rounds join the nearest topic of their session, in order."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

THRESHOLD = 0.77  # fixed value


class Topics:
    """Centroids of one session. Order matters, so a session is one sequential computation.

    Centroids of one dimension are the rows of one table, which doubles when it is full.
    """

    def __init__(self, threshold: float = THRESHOLD, centroids: Iterable | None = None, sizes: Iterable[int] | None = None):
        self.threshold = threshold
        self.sizes: list[int] = []
        self._place: list[tuple[int, int]] = []  # of each topic: dimension, row
        self._rows: dict[int, np.ndarray] = {}
        self._topics: dict[int, list[int]] = {}  # the topics of a dimension, by row
        for c, n in zip(centroids or [], sizes or []):
            self._open(np.asarray(c, float), n)

    @property
    def centroids(self) -> list[np.ndarray]:
        return [self._rows[d][r] for d, r in self._place]

    def assign(self, vector, forced: int | None = None) -> int:
        """The topic of the next round: the forced one if it exists; else the first of the most similar from the
        threshold up; else a new one. A round without vector opens a topic that nothing matches; one whose vector has
        another dimension than the topic it is forced into leaves the centroid as it is."""
        v = None if vector is None else np.asarray(vector, float)
        if forced is None or not 0 <= forced < len(self.sizes):
            forced = None if v is None else self._nearest(v)
        if forced is None:
            return self._open(np.zeros(0) if v is None else v, 1)
        self.sizes[forced] += 1
        d, r = self._place[forced]
        if v is not None and len(v) == d:
            self._rows[d][r] += (v - self._rows[d][r]) / self.sizes[forced]
        return forced

    def _open(self, c: np.ndarray, size: int) -> int:
        topics = self._topics.setdefault(len(c), [])
        rows = self._rows.setdefault(len(c), np.zeros((1, len(c))))
        if len(topics) == len(rows):
            rows = self._rows[len(c)] = np.vstack([rows, np.zeros_like(rows)])
        rows[len(topics)] = c
        self._place.append((len(c), len(topics)))
        topics.append(len(self.sizes))
        self.sizes.append(size)
        return topics[-1]

    def _nearest(self, v: np.ndarray) -> int | None:
        topics = self._topics.get(len(v))
        if not topics:
            return None
        s = self._rows[len(v)][: len(topics)] @ v
        s = np.where(s >= self.threshold, s, 0.0)
        best = int(s.argmax())
        return topics[best] if s[best] > 0 else None


def topics(rounds: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(session, pos, topic) of rounds (session, pos, vector, forced): forced is a topic number or null.

    Rounds come sorted and pass by in batches: a task holds the centroids of one
    session, none of its rounds. Sessions spread over tasks; the rounds of one take
    their turns. Rounds without a session are one session. Rounds of one position are
    taken in the order of their forced topics, then vectors.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, state = None, None
        for b in batches:
            vectors = b.column("vector")
            flat, ends = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            out, start = [], 0
            for s, end, known, forced in zip(b.column("session").to_pylist(), ends.tolist(), vectors.is_valid().to_pylist(), b.column("forced").to_pylist()):
                if state is None or s != session:
                    session, state = s, Topics(threshold)
                out.append(state.assign(flat[start:end] if known else None, forced))
                start = end
            yield pa.RecordBatch.from_arrays([b.column("session"), b.column("pos"), pa.array(out, pa.int32())], ["session", "pos", "topic"])

    kinds = dict(rounds.dtypes)
    r = rounds.select("session", "pos", "vector", "forced").repartition("session").sortWithinPartitions("session", "pos", "forced", "vector")
    return r.mapInArrow(scan, f"session {kinds['session']}, pos {kinds['pos']}, topic int")
