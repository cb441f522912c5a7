"""Working memory: a session keeps its seven latest slots."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CAPACITY = 7  # fixed value


@dataclass(frozen=True)
class Slot:
    id: int
    summary: str
    content: str
    source_round: str | None = None

    def __str__(self) -> str:
        source = f"\nSource round: {self.source_round}" if self.source_round else ""
        return f"[id: {self.id}] {self.summary}{source}\n\n{self.content}"


class WorkingMemory:
    """Slots by id. A new one has the highest id so far plus one; beyond the capacity the lowest id goes."""

    def __init__(self):
        self.slots: dict[int, Slot] = {}

    def add(self, summary: str, content: str, source_round: str | None = None) -> int:
        new = max(self.slots, default=0) + 1
        self.slots[new] = Slot(new, summary, content, source_round)
        if len(self.slots) > CAPACITY:
            del self.slots[min(self.slots)]
        return new

    def get(self, slot: int) -> Slot | None:
        return self.slots.get(slot)

    def update(self, slot: int, summary: str, content: str, source_round: str | None = None) -> Slot | None:
        if (old := self.slots.get(slot)) is not None:
            self.slots[slot] = replace(old, summary=summary, content=content, source_round=old.source_round if source_round is None else source_round)
        return self.slots.get(slot)

    def delete(self, slot: int) -> bool:
        return self.slots.pop(slot, None) is not None

    def take(self, slot: int) -> Slot | None:
        return self.slots.pop(slot, None)


def kept_slots(additions: DataFrame) -> DataFrame:
    """(session, id, ...): what each session holds after its additions (session, pos, ...) alone."""
    w = W.partitionBy("session")
    x = additions.withColumn("id", F.row_number().over(w.orderBy("pos"))).withColumn("_back", F.row_number().over(w.orderBy(F.desc("pos"))))
    return x.where(F.col("_back") <= CAPACITY).drop("_back")
