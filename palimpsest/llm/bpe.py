"""Byte-level BPE: recursive DuckDB queries merge the distinct words of a partition; ordered aggregation decodes.

A word of more than PIECE bytes is merged in overlapping pieces of it. Merging the
bytes of neighbouring tokens alone gives these tokens again, as no merge crossed
their borders; and a sequence of which that holds for all neighbours is the one
that merging the whole gives. So two pieces that have a token in common, at the
same place, join at it: the tokens up to it come from one, those after from the other.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Generator, Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from palimpsest.llm.common import release

#: Bytes of a piece of a word, and what neighbouring pieces share at least.
PIECE, OVERLAP = 32, 12
#: Bytes of encoded words that a task keeps, with what Python adds to each; beyond, it starts anew.
CACHE_BYTES, WORD_BYTES = 80 << 20, 160
#: Bytes of text that are split into words at a time, and bytes of words that one query merges.
SLICE_BYTES, QUERY_BYTES = 1_500_000, 400_000
#: Tokens that one query decodes, and bytes of words that one query looks up as whole tokens.
QUERY_TOKENS, LOOKUP_BYTES = 250_000, 2_000_000


@lru_cache(maxsize=2)
def read_ranks(path: str) -> tuple[pa.Table, pa.Table, np.ndarray, np.ndarray]:
    """Tokens (id, piece in hex), merges (ab, c), the id of each byte and the length of each token, of a rank file."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    pairs, whole = [], []
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if a is not None and b is not None:
                pairs.append(a << 32 | b), whole.append(rank)
    token = pa.table({"id": pa.array(ranks.values(), pa.int32()), "piece": pa.array([k.hex() for k in ranks], pa.string())})
    merges = pa.table({"ab": pa.array(pairs, pa.int64()), "c": pa.array(whole, pa.int32())})
    size = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
    size[list(ranks.values())] = [len(k) for k in ranks]
    return token, merges, np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32), size


Tokens = list[tuple[int, int, int]]  # (start, end, id) in a word


def join_pieces(word: bytes) -> Generator[tuple[int, int], Tokens, Tokens]:
    """The tokens of a word; asks for those of its pieces (start, end) and is sent them.

    Pieces lie on a grid, so that those of a word can be merged together. Where
    neighbours have no token in common, a piece from a border of tokens stands
    between them; if that has none either, the piece is read on to twice its length.
    """
    start, end = 0, min(PIECE, len(word))
    here = yield start, end
    out: Tokens = []
    step = PIECE - OVERLAP
    while end < len(word):
        grid = (end - OVERLAP) // step * step
        border = max((a for a, _, _ in here if a <= end - OVERLAP), default=start)
        for at in (grid, border):
            if at <= start:
                continue
            stop = min(at + PIECE, len(word))
            if stop <= end:
                continue
            there = yield at, stop
            both = min(set(here) & set(there), default=None)
            if both:
                out += [t for t in here if t < both]
                here, start, end = [t for t in there if t >= both], at, stop
                break
        else:
            first = here[0][0]  # what is before is settled
            start, end = first, min(first + 2 * (end - first), len(word))
            here = yield start, end
    return out + here


def spill_folder() -> str:
    """A folder beside the shuffle files of this worker's executor, which Spark names to its workers; none outside of Spark."""
    local = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return os.path.join(local, f"duckdb-{os.getpid()}") if local else ""


def lots(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges [first, last) of neighbours that have `most` together, or of one that has more."""
    reach, first = np.cumsum(lengths), 0
    while first < len(lengths):
        last = max(first + 1, int(np.searchsorted(reach, reach[first] - lengths[first] + most, "right")))
        yield first, last
        first = last


class BpeTable:
    """Ranks of a rank file and their merge table in an in-memory DuckDB of one thread, and a cache of encoded words."""

    def __init__(self, path: str, pattern: str):
        self.words = regex.compile(pattern)
        token, merges, self.byte_id, self.size = read_ranks(path)
        self.longest = int(self.size.max(initial=0))
        self.cache: dict[str, bytes] = {}
        self.held = 0
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "160MB", "temp_directory": spill_folder()})
        for name, rows in (("token", token), ("merges", merges)):
            self.db.register("rows_arrow", rows)
            self.db.execute(f"create table {name} as from rows_arrow").fetchall()
            self.db.unregister("rows_arrow")

    def close(self) -> None:
        self.cache.clear()
        self.db.close()

    def _merge(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each piece, by the recursive query; pieces of like length go together."""
        pieces, out = sorted(pieces, key=len), {}
        lengths = np.array([len(x) for x in pieces], np.int64)
        for first, last in lots(lengths, QUERY_BYTES):
            n = lengths[first:last]
            data = np.frombuffer(b"".join(pieces[first:last]), np.uint8)
            pos = np.arange(len(data)) - np.repeat(np.cumsum(n) - n, n)
            self.db.register("bytes_arrow", pa.table({"w": np.repeat(np.arange(len(n), dtype=np.int32), n), "p": pos.astype(np.int32), "t": self.byte_id[data]}))
            got = self.db.execute(_MERGE).fetchnumpy()
            self.db.unregister("bytes_arrow")
            raw = np.asarray(got["t"]).astype("<u4").tobytes()
            ends = (4 * np.searchsorted(np.asarray(got["w"]), np.arange(len(n) + 1))).tolist()
            out.update((x, raw[a:b]) for x, a, b in zip(pieces[first:last], ends, ends[1:]))
        return out

    def _tokens(self, at: int, ids: bytes) -> Tokens:
        t = np.frombuffer(ids, "<u4").astype(np.int64)
        ends = at + np.cumsum(self.size[t])
        return list(zip((ends - self.size[t]).tolist(), ends.tolist(), t.tolist()))

    def _whole_tokens(self, words: list[bytes]) -> dict[bytes, int]:
        """Words that are tokens themselves. A word longer than any token isn't looked up."""
        words, out = [w for w in words if len(w) <= self.longest], {}
        for a, b in lots(np.array([len(w) for w in words], np.int64), LOOKUP_BYTES):
            self.db.register("words_arrow", pa.table({"piece": pa.array([w.hex() for w in words[a:b]], pa.string())}))
            got = self.db.execute("select piece, id from words_arrow join token using (piece)").fetchall()
            self.db.unregister("words_arrow")
            out.update((bytes.fromhex(p), t) for p, t in got)
        return out

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers. As in the library, a word that is a token is that token."""
        done = {w: t.to_bytes(4, "little") for w, t in self._whole_tokens(words).items()}
        rest = [w for w in words if w not in done]
        long = [w for w in rest if len(w) > PIECE]
        grid = (w[i : i + PIECE] for w in long for i in range(0, len(w) - OVERLAP, PIECE - OVERLAP))
        merged = self._merge(list({w for w in rest if len(w) <= PIECE}.union(grid)))
        done.update((w, merged[w]) for w in rest if len(w) <= PIECE)
        waiting = [(w, walk, next(walk)) for w in set(long) for walk in [join_pieces(w)]]
        while waiting:
            asked, waiting = waiting, []
            for w, walk, (a, b) in asked:
                try:
                    while (ids := merged.get(w[a:b])) is not None:
                        a, b = walk.send(self._tokens(a, ids))
                    waiting.append((w, walk, (a, b)))
                except StopIteration as end:
                    done[w] = np.array([t for _, _, t in end.value], "<u4").tobytes()
            if waiting:
                merged |= self._merge(list({w[a:b] for w, _, (a, b) in waiting}))
        return [done[w] for w in words]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; words not met before are merged together."""
        if self.held > CACHE_BYTES:
            self.cache.clear()
            self.held = 0
        split = [self.words.findall(t) for t in texts]
        fresh = list(set().union(*split).difference(self.cache)) if split else []
        if fresh:
            ids = self.merge_words([w.encode() for w in fresh])
            self.cache.update(zip(fresh, ids))
            self.held += sum(map(len, fresh)) + sum(map(len, ids)) + WORD_BYTES * len(fresh)
        get = self.cache.__getitem__
        return [b"".join(map(get, ws)) for ws in split]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of each id sequence, by an ordered aggregation over its token rows.

        A query decodes QUERY_TOKENS tokens at most: a longer sequence is cut into
        runs, whose bytes are put together again.
        """
        step = 4 * QUERY_TOKENS
        runs = [(k, x[i : i + step]) for k, x in enumerate(ids) for i in range(0, len(x), step)]
        out: list[list[bytes]] = [[] for _ in ids]
        lengths = np.array([len(x) // 4 for _, x in runs], np.int64)
        for first, last in lots(lengths, QUERY_TOKENS):
            n = lengths[first:last]
            flat = np.frombuffer(b"".join(x for _, x in runs[first:last]), "<u4").astype(np.int32)
            rows = pa.table({"d": np.repeat(np.arange(len(n), dtype=np.int32), n), "p": np.arange(len(flat), dtype=np.int32), "t": flat})
            self.db.register("ids_arrow", rows)
            got = dict(self.db.execute(_DECODE).fetchall())
            self.db.unregister("ids_arrow")
            for d, (k, _) in enumerate(runs[first:last]):
                out[k].append(bytes.fromhex(got[d]))
        return [b"".join(x) for x in out]


_DECODE = "select d, string_agg(piece, '' order by p) from ids_arrow join token on t = id group by d"
#: A row is a token at k = piece << 32 | position. One round contracts the leftmost pair of least rank of every piece that
#: still has a pair in the merge table: the least of (merged token, position, length of the pair's first token) in one number.
_MERGE = """
with recursive state as (
    select (w::bigint << 32) | p k, t, false done from bytes_arrow
    union all
    (with pair as (
        select k, t, lead(t) over o n, lead(k) over o next from state where not done window o as (order by k)
    ), ranked as (
        select k, t, (c::bigint << 42) | ((k & 4294967295) << 10) | (next - k) pick
        from pair left join merges on ab = ((t::bigint << 32) | n) and (next >> 32) = (k >> 32)
    ), best as (
        select k >> 32 w, min(pick) least from ranked group by all
    )
    select k, case when ((least >> 10) & 4294967295) = (k & 4294967295) then (least >> 42)::int else t end t, least is null done
    from ranked join best on w = (k >> 32)
    where least is null or (k & 4294967295) <> ((least >> 10) & 4294967295) + (least & 1023))
)
select (k >> 32)::int w, t from state where done order by k
"""


def encode_decode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """All columns of `docs` with ids (binary, little-endian unsigned 32-bit), n_tokens and decoded (binary).

    Each match of `pattern` is merged by itself, special strings are ordinary
    text. Null texts are empty: no ids. The rank file is a path every executor
    can open, as the installed tokenizer package is. Columns of those names are
    replaced. Texts may be of any length. Memory: a slice of texts or one longer text
    and its tokens, a bounded cache of words, and queries over a bounded number of
    rows, which spill to the executor's own folder if need be.
    """
    docs = docs.drop("ids", "n_tokens", "decoded")

    def run(it):
        table = BpeTable(path, pattern)
        for batch in it:
            size = np.cumsum([0, *(x or 0 for x in pc.binary_length(batch.column(text)).to_pylist())])
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(size, size[first] + SLICE_BYTES, "right")) - 1)
                part = batch.slice(first, last - first)
                texts = [t or "" for t in part.column(text).to_pylist()]
                ids = table.encode(texts)
                n = pa.array([len(x) // 4 for x in ids], pa.int64())
                cols = [*part.columns, pa.array(ids, pa.binary()), n, pa.array(table.decode(ids), pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, [*part.schema.names, "ids", "n_tokens", "decoded"])
                first = last
        table.close()
        release()

    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.BinaryType())])
    return docs.mapInArrow(run, schema)
