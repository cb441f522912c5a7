"""MinHash near-duplicates by a multi-index Hamming join of signatures.

A signature has PARTS parts of 16 bits, each from the least hash of a document's
shingles under a function of its own; the distance of two is the number of parts in
which they differ. It is split into chunks of CHUNK parts. Two signatures that
differ in fewer than 2 * PARTS / CHUNK parts have a chunk with one error at most:
so each chunk gives a key for each place where an error may be, of the other parts,
and all pairs within that distance share a key. Documents that share one with another
are candidates; those that have too few shingles in common with all other candidates
together can't link and go. The rest are compared by distance, then confirmed on their
full sets of shingles.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import batches, materialize, materialize_counted, mix64, narrow, one_row_per_id, pack, release, sized_buckets, trimmed, unpack
from palimpsest.llm.ngram_join import GROWTH, HOT_HERE, THRESHOLD, leader_rounds, of_all_copies, shingle_hashes, shingle_sets, verify_pairs

WORDS = 4
PARTS, CHUNK = 80, 5
#: All pairs of signatures up to this distance are found: 16 chunks can't all have two errors.
SURE = 2 * (PARTS // CHUNK) - 1
#: Pairs found at a greater distance go on to be confirmed up to this one. At similarity 0.8 a part differs with
#: probability 0.2, so a link's distance is over SURE once in 40,000 times and over FAR less than once in 10^10; and one in
#: 1.8 * 10^9 has two errors in every chunk, so isn't found.
FAR = 43
CROWD = 32  # documents of a key, beyond which they meet at rare shingles instead
FLUSH = 1_500_000  # keys that a task holds before it sends them
BUCKET_BYTES = 256 << 10  # of stored signatures, whose keys a task holds at a time

_FACTORS = mix64(np.arange(1, PARTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_SUMS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def signatures_of(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Parts of the sets whose hashes lie one after another in `h`, `n` of each; all zero for empty sets."""
    out = np.zeros((len(n), PARTS), np.uint64)
    full = np.flatnonzero(n)
    at = (np.cumsum(n) - n)[full]
    for j in range(PARTS if len(full) else 0):
        out[full, j] = np.minimum.reduceat(h * _FACTORS[j], at)
    return (mix64(out) >> np.uint64(48)).astype(np.uint16)


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n (size of the set), sig1 and sig2 (equal for equal sets), sig (the parts), in one pass over whole texts."""

    def run(it):
        for batch in it:
            ids = batch.column("doc_id")
            for first, x, off in batches(batch.column("text")):
                own, h = shingle_hashes(x, off, words)
                n = np.bincount(own, minlength=len(off) - 1)
                at = np.r_[0, np.cumsum(n)]
                sums = []
                for c in _SUMS:
                    total = np.r_[np.uint64(0), np.cumsum(mix64(h ^ np.uint64(c)))]
                    sums.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
                sig = signatures_of(h, n).view(np.int16)
                parts = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * PARTS, pa.int32()), pa.array(sig.ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(n)), pa.array(n.astype(np.int64)), *map(pa.array, sums), parts], ["doc_id", "n", "sig1", "sig2", "sig"])
        release()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, sig1 long, sig2 long, sig array<short>")


def keys_of(sig: np.ndarray) -> np.ndarray:
    """The keys of signatures, a row for each: of each chunk, the parts but one."""
    parts = sig.view(np.uint16).astype(np.uint64).reshape(len(sig), PARTS // CHUNK, CHUNK)
    out = np.empty((len(sig), PARTS // CHUNK, CHUNK), np.uint64)
    salt = mix64(np.arange(1, PARTS + 1, dtype=np.uint64)).reshape(-1, CHUNK)
    for i in range(CHUNK):
        four = np.zeros(out.shape[:2], np.uint64)
        for j in range(CHUNK):
            if j != i:
                four = four << np.uint64(16) | parts[:, :, j]
        out[:, :, i] = mix64(four ^ salt[:, i])
    return out.reshape(len(sig), PARTS)


KEYS, STRAIGHT, MARKS = 0, 1, 2  # keys to group; entries of keys that many of a task's documents have; such keys


def _send(docs: list[tuple], buckets: int, hot_here: int) -> pa.RecordBatch:
    """The keys of a task's documents, dealt to buckets in equal shares of their range."""
    ids, n, sig = (np.concatenate(x) for x in zip(*docs))
    h = keys_of(sig).ravel()
    o = np.argsort(h, kind="stable")
    h, row = h[o], o // PARTS
    begin = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
    size = np.diff(np.r_[begin, len(h)])
    bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    hot = np.repeat(size > hot_here, size)
    out: list[tuple[int, int, bytes]] = []

    def deal(kind: int, to: np.ndarray, cols: list[np.ndarray]) -> None:
        cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]][: len(to)])
        for a, b in zip(cuts, [*cuts[1:], len(to)]):
            key, *rest = (c[a:b] for c in cols)
            low = [c.min() for c in rest]
            out.append((int(to[a]), kind, pack(np.diff(key, prepend=np.uint64(0)), *[c - x for c, x in zip(rest, low)], *[np.full(len(key), x) for x in low])))

    deal(KEYS, bucket[~hot], [h[~hot], ids[row[~hot]], n[row[~hot]]])
    if hot.any():
        first = begin[size > hot_here]
        deal(MARKS, bucket[first], [h[first]])
        o = np.argsort(row[hot] % buckets, kind="stable")  # a hot key's documents go to all buckets
        deal(STRAIGHT, (row[hot] % buckets)[o], [h[hot][o], ids[row[hot]][o], n[row[hot]][o]])
    b, k, d = zip(*out)
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(k, pa.int32()), pa.array(d, pa.binary())], ["bucket", "kind", "data"])


def _deal(buckets: int, hot_here: int):
    def run(it):
        docs, held = [], 0
        for batch in it:
            n = batch.num_rows
            if not n:
                continue
            sig = batch.column("sig").flatten().to_numpy(zero_copy_only=False).reshape(n, PARTS)
            docs.append((batch.column("lead").to_numpy(zero_copy_only=False), batch.column("n").to_numpy(zero_copy_only=False), sig))
            held += n * PARTS
            if held >= FLUSH:
                yield _send(docs, buckets, hot_here)
                docs, held = [], 0
        if docs:
            yield _send(docs, buckets, hot_here)
        docs = None
        release()

    return run


def _shared(table: pa.Table) -> pa.Table:
    """Entries of the keys that several documents have."""
    got, straight, marks = [], [], [np.zeros(0, np.uint64)]
    for kind, data in zip(table.column("kind").to_pylist(), table.column("data").to_pylist()):
        d, *rest = unpack(data)
        if kind == MARKS:
            marks.append(np.cumsum(d))
        else:
            doc, n, low_doc, low_n = rest
            (got if kind == KEYS else straight).append((np.cumsum(d), doc + low_doc, n + low_n))
    if got:
        h, doc, n = (np.concatenate(x) for x in zip(*got))
        o = np.argsort(h, kind="stable")
        h, doc, n = h[o], doc[o], n[o]
        begin = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
        size = np.diff(np.r_[begin, len(h)])
        keep = np.repeat((size > 1) | np.isin(h[begin], np.concatenate(marks)), size)
        straight.append((h[keep], doc[keep], n[keep]))
    h, doc, n = (np.concatenate(x) for x in zip(*straight)) if straight else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return pa.table({"h": h.view(np.int64), "doc_id": doc, "n": n})


def shared_keys(classes: DataFrame, hot_here: int = HOT_HERE) -> DataFrame:
    """(h, doc_id, n): the entries of every key that more than one document of `classes` (lead, n, sig) has."""
    buckets = sized_buckets(classes, BUCKET_BYTES)
    dealt = classes.select("lead", "n", "sig").mapInArrow(_deal(buckets, hot_here), "bucket long, kind int, data binary")
    return dealt.groupBy("bucket").applyInArrow(trimmed(_shared), "h long, doc_id long, n long")


def _near(pairs: DataFrame, sigs: DataFrame, far: int) -> DataFrame:
    """Pairs (u, v) whose signatures differ in `far` parts at most."""
    for key, sig in (("u", "x"), ("v", "y")):
        pairs = pairs.join(sigs.select(F.col("doc_id").alias(key), F.col("sig").alias(sig)), key)
    differ = F.aggregate(F.zip_with("x", "y", lambda a, b: (a != b).cast("int")), F.lit(0), lambda s, d: s + d)
    return pairs.where(differ <= far).select("u", "v")


def _uncrowded(entries: DataFrame, sets: DataFrame, crowd: int, total: int) -> DataFrame:
    """(h, doc_id, n, pos): entries (h, doc_id, n) of the keys that at most `crowd` documents have, and finer ones in the place of others.

    Two documents that link also share one of the rarest shingles of either, of so
    many as prefix_length says. So those that a crowded key brings together meet at
    these, each of which few of them have, and no link between them is lost.
    """
    crowded = materialize(narrow(entries.groupBy("h").count().where(F.col("count") > crowd).select("h"), total))
    own = materialize(narrow(entries.join(crowded, "h", "left_semi").select("doc_id").distinct(), total))
    rare = sets.join(own, "doc_id", "left_semi").select("doc_id", "n", F.posexplode(F.slice("shared", F.lit(1), F.col("prefix"))).alias("i", "h"), "unshared")
    few = entries.join(crowded, "h", "left_anti").select("h", "doc_id", "n", F.lit(0).cast("long").alias("pos"))
    return few.unionByName(rare.select("h", "doc_id", "n", (F.col("unshared") + F.col("i")).alias("pos")))


def near_duplicates(
    docs: DataFrame, words: int = WORDS, threshold: Fraction = THRESHOLD, hot_here: int = HOT_HERE, growth: int = GROWTH, far: int = FAR, crowd: int = CROWD
) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links), kept (whether that is its own).

    Words are runs of bytes other than space, tab and line breaks, with A-Z
    lower-cased; a document's set is its distinct runs of `words` words, the whole
    sequence where it has fewer. Documents link when their sets' Jaccard similarity
    reaches the threshold, which is confirmed on full sets. Documents without words, null
    and empty texts are linked with nothing. Rows without an id are left out, of
    repeated ids one row counts (see one_row_per_id). Other columns are ignored. An
    empty table gives none. Sets are compared by 56-bit hashes of their shingles.

    Documents of equal sets are one class, whose first document stands for it, so a group
    of copies of any size is a row. The entries of a key meet its leaders in rounds (see
    leader_rounds), never each other all at once. A key that very many documents have
    isn't gathered in a task, and one that more than `crowd` have is split by their rare shingles.
    """
    docs = one_row_per_id(docs.select("doc_id", "text"))
    sets = materialize(signatures(docs, words))
    groups = sets.where("n > 0").groupBy("sig1", "sig2", "n", "sig").agg(F.min("doc_id").alias("lead"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(groups)
    entries, total = materialize_counted(shared_keys(classes, hot_here))
    live = materialize(entries.select(F.col("doc_id").alias("_live")).distinct())
    full = shingle_sets(docs.join(live, F.col("doc_id") == F.col("_live"), "left_semi"), words, threshold, hot_here)
    can, size = materialize_counted(full.where("prefix > 0").join(classes.select("lead", "sig"), F.col("doc_id") == F.col("lead")).drop("lead"))
    entries, total = materialize_counted(narrow(entries.join(can.select("doc_id"), "doc_id", "left_semi"), total))
    entries = narrow(_uncrowded(entries, can, crowd, total).join(can.select("doc_id", "bins"), "doc_id"), total)
    labels = leader_rounds(
        materialize(entries), total, size, threshold, growth,
        lambda pairs, rows: narrow(_near(pairs, can, far), rows),
        lambda pairs, rows: verify_pairs(pairs, can, threshold, rows=rows, size=size),
    )
    out = of_all_copies(sets, classes, labels)
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
