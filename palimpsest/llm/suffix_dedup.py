"""Exact substring dedup by suffix arrays over the places where a repeat is possible.

A string of LENGTH bytes holds LENGTH - K + 1 K-grams; its anchor is the leftmost
of least hash. Equal strings have equal anchors at equal offsets, so strings need
comparing only within an anchor's K-gram. Runs of strings with one anchor form a
piece. Pieces whose K-gram has two different pieces are sorted as suffixes (two
stages, then adjacent common prefixes); equal pieces repeat as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import batches, materialize, mix64, n_buckets, on_release, one_row_per_id, pack, ranges, release, sized_buckets, trimmed, unpack
from palimpsest.llm.suffix_array import adjacent_equal, two_stage

K = 28
SLICE = 1 << 20  # longer texts are searched in slices that share LENGTH - 1 bytes
FLUSH = 2_000_000  # pieces that a task holds before it sends them
HOT = (2048, 32_768)  # different pieces of one K-gram, in a task and in all, beyond which strings go out one by one
PER_BUCKET = 4 << 20  # stored bytes for each bucket of K-grams, at least as many as n_buckets gives
PART = 1 << 22  # bytes of texts that are cut together


@dataclass(frozen=True)
class Anchors:
    """Pieces of a batch: K-gram hash, hash of the piece, text number, first string, end of the last string."""

    gram: np.ndarray
    piece: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray


_rng = np.random.default_rng(20_240_501)
_BYTE = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, b in enumerate((_BASE, _INVERSE)):
            p = np.full(n + (1 << 16), b, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


on_release.append(lambda: _powers.__setitem__(slice(None), [np.ones(1, np.uint64)] * 2))


def find_anchors(x: np.ndarray, off: np.ndarray, length: int) -> Anchors:
    """Pieces of the texts x[off[i]:off[i + 1]], concatenated in `x`."""
    n, w = len(x), length - K + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return Anchors(none.astype(np.uint64), none.astype(np.uint64), none, none, none)
    power, inverse = _power(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[x] * power[:n], out=prefix[1:])
    gram = mix64((prefix[K:] - prefix[:-K]) * inverse[: n - K + 1])
    low = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    span = 1
    while span * 2 <= w:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < w:
        low = np.minimum(low[: len(low) - (w - span)], low[w - span :])
    anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of the string at each position
    size = np.diff(off)
    count = np.maximum(size - length + 1, 0)
    at = ranges(off[:-1], count)
    if not len(at):
        return Anchors(none.astype(np.uint64), none.astype(np.uint64), none, none, none)
    text, a = np.repeat(np.arange(len(size)), count), anchor[at]
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (text[1:] != text[:-1])])
    last = np.r_[new[1:], len(at)] - 1
    start, end, a, text = at[new], at[last] + length, a[new], text[new]
    body = (prefix[end] - prefix[start]) * inverse[start]
    piece = mix64(body + (a - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + (end - start).astype(np.uint64) * np.uint64(0x165667B19E3779F9))
    return Anchors(gram[a], piece, text, start - off[text], end - off[text])


def _sliced(ids: np.ndarray, text: pa.Array, length: int):
    """(ids, bases, bytes, offsets) of batches; a long text comes as slices that share length - 1 bytes."""
    for first, x, off in batches(text):
        n = len(off) - 1
        if n == 1 and len(x) > SLICE:
            for base in range(0, max(len(x) - length + 1, 1), SLICE):
                part = x[base : base + SLICE + length - 1]
                yield ids[first : first + 1], np.array([base]), part, np.array([0, len(part)])
        else:
            yield ids[first : first + n], np.zeros(n, np.int64), x, off


def merge_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document that touch or overlap become one."""
    if not len(doc):
        return doc, start, end
    o = np.lexsort((start, doc))
    doc, start, end = doc[o], start[o], end[o]
    begin = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    rank = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(doc)]))
    step = np.int64(max(int(end.max()), 0) + 1)
    reach = np.maximum.accumulate(end + rank * step) - rank * step
    new = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])]
    at = np.flatnonzero(new)
    return doc[at], start[at], reach[np.r_[at[1:], len(doc)] - 1]


_BLOBS = "bucket long, kind int, data binary"
_FOUND = "kind int, doc_id long, start long, end long, gram long"
COVERED, NEEDED, NEEDED_HOT, PIECES = 0, 1, 2, 3


def _by_bucket(bucket: np.ndarray) -> np.ndarray:
    """The stable order of bucket numbers, by their low and then their high 16 bits: those are sorted in linear time."""
    bucket = bucket - bucket.min(initial=0)
    o = np.argsort(bucket.astype(np.uint16), kind="stable")
    return o[np.argsort((bucket[o] >> 16).astype(np.uint16), kind="stable")] if bucket.max(initial=0) >> 16 else o


def _blob_rows(kind: int, bucket: np.ndarray, cols: list[np.ndarray], rows: list) -> None:
    o = _by_bucket(bucket)
    bucket, cols = bucket[o], [c[o] for c in cols]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
    for a, b in zip(cuts, [*cuts[1:], len(bucket)]):
        rows.append((int(bucket[a]), kind, pack(*[c[a:b] for c in cols])))


def _to_batch(rows: list) -> pa.RecordBatch:
    b, k, d = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(k, pa.int32()), pa.array(d, pa.binary())], ["bucket", "kind", "data"])


def _local(parts: list[tuple], buckets: int, hot_here: int):
    """A task's pieces: repeats within the task are settled here, the rest goes to the K-gram's bucket."""
    gram, piece, doc, start, end = (np.concatenate(c) for c in zip(*parts))
    o = np.argsort(gram)
    g = gram[o]
    twice = np.zeros(len(g), bool)
    twice[1:] = g[1:] == g[:-1]
    twice[:-1] |= twice[1:]
    own = o[twice]  # most K-grams are met once: only the others have an order to settle
    o[twice] = own[np.lexsort((start[own], doc[own], piece[own], gram[own]))]
    gram, piece, doc, start, end = gram[o], piece[o], doc[o], start[o], end[o]
    first = np.r_[True, (gram[1:] != gram[:-1]) | (piece[1:] != piece[:-1])]
    rows: list = []
    d, s, e = merge_spans(doc[~first], start[~first], end[~first])
    _blob_rows(COVERED, d % buckets, [d, s, e], rows)
    gram, piece, doc, start, end = gram[first], piece[first], doc[first], start[first], end[first]
    begin = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    size = np.diff(np.r_[begin, len(gram)])
    hot = np.repeat(size > hot_here, size)
    bucket = lambda g: (g % np.uint64(buckets)).astype(np.int64)
    if hot.any():
        _blob_rows(NEEDED_HOT, doc[hot] % buckets, [doc[hot], start[hot], end[hot]], rows)
        mark = gram[begin[size > hot_here]]  # tells the bucket that this K-gram's strings go out one by one
        _blob_rows(PIECES, bucket(mark), [mark, np.zeros(len(mark), np.uint64), np.zeros(len(mark), np.int64), np.zeros(len(mark), np.int64), np.full(len(mark), -1)], rows)
    cold = ~hot
    _blob_rows(PIECES, bucket(gram[cold]), [gram[cold], piece[cold], doc[cold], start[cold], (end - start)[cold]], rows)
    return rows


def _find_pieces(length: int, buckets: int, hot_here: int):
    def run(it):
        parts, held = [], 0
        for batch in it:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for own, base, x, off in _sliced(ids, batch.column("text"), length):
                f = find_anchors(x, off, length)
                if len(f.gram):
                    parts.append((f.gram, f.piece, own[f.text], f.start + base[f.text], f.end + base[f.text]))
                    held += len(f.gram)
                if held >= FLUSH:
                    yield _to_batch(_local(parts, buckets, hot_here))
                    parts, held = [], 0
        if parts:
            yield _to_batch(_local(parts, buckets, hot_here))
        parts = None
        release()

    return run


def _found(rows: list[tuple]) -> pa.Table:
    """Rows of _FOUND from (kind, doc, start, end, gram) columns."""
    cols = [np.concatenate([np.full(len(r[1]), r[0], np.int32) for r in rows])] + [np.concatenate([r[i] for r in rows]).astype(np.int64) for i in range(1, 5)]
    return pa.table(cols, ["kind", "doc_id", "start", "end", "gram"])


def _judge_bucket(table: pa.Table, hot_all: int) -> pa.Table:
    """All pieces of some K-grams: later copies are covered; K-grams with several pieces need their bytes."""
    kinds, blobs = table.column("kind").to_numpy(), table.column("data")
    zero = np.zeros(0, np.int64)
    rows = [(COVERED, zero, zero, zero, zero)]
    pieces = []
    for kind, blob in zip(kinds, blobs):
        cols = unpack(blob.as_py())
        if kind == PIECES:
            pieces.append(cols)
        else:
            rows.append((kind, *cols, np.zeros(len(cols[0]), np.int64)))
    if pieces:
        gram, piece, doc, start, size = (np.concatenate(c) for c in zip(*pieces))
        marked = np.unique(gram[size < 0])
        gram, piece, doc, start, size = (c[size >= 0] for c in (gram, piece, doc, start, size))
        # only K-grams met twice matter
        o = np.argsort(gram, kind="stable")
        g = gram[o]
        same = np.zeros(len(g), bool)
        same[1:] = g[1:] == g[:-1]
        same[:-1] |= same[1:]
        keep = o[same | np.isin(g, marked)]
        gram, piece, doc, start, size = gram[keep], piece[keep], doc[keep], start[keep], size[keep]
        o = np.lexsort((start, doc, piece, gram))
        gram, piece, doc, start, end = gram[o], piece[o], doc[o], start[o], (start + size)[o]
        first = np.r_[True, (gram[1:] != gram[:-1]) | (piece[1:] != piece[:-1])][: len(gram)]
        rows.append((COVERED, *merge_spans(doc[~first], start[~first], end[~first]), None))
        rows[-1] = (*rows[-1][:4], np.zeros(len(rows[-1][1]), np.int64))
        gram, doc, start, end = gram[first], doc[first], start[first], end[first]
        begin = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]][: len(gram)])
        count = np.diff(np.r_[begin, len(gram)])
        count = np.repeat(count, count)
        hot = (count > hot_all) | np.isin(gram, marked)
        cold = (count > 1) & ~hot
        for kind, m in ((NEEDED, cold), (NEEDED_HOT, hot)):
            rows.append((kind, doc[m], start[m], end[m], gram[m].view(np.int64)))
    return _found(rows)


_PIECE_ROWS = "bucket long, data binary, bytes binary"


def _cut_pieces(length: int, buckets: int):
    """Texts with their needed spans: the bytes of each piece, or of each string where the K-gram is hot, to their bucket.

    Of equal strings of a hot K-gram a task sends the first only; the others are
    covered, and go as spans to buckets below zero, by document.
    """

    def run(it):
        pieces: list[tuple] = []  # columns (bucket, doc, start, size, bytes of all)
        first: dict[bytes, tuple] = {}  # string -> (doc, start, bucket)
        later: list[tuple] = []
        size = 0

        def flush():
            if first:
                d, s, b = np.array(list(first.values()), np.int64).T
                pieces.append((b, d, s, np.full(len(b), length), np.frombuffer(b"".join(first), np.uint8)))
            bucket, doc, start, n, data = (np.concatenate(c) for c in zip(*pieces))
            o = _by_bucket(bucket)
            data = data[ranges((np.cumsum(n) - n)[o], n[o])]
            bucket, doc, start, n = bucket[o], doc[o], start[o], n[o]
            ends = np.r_[0, np.cumsum(n)]
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            out = [(int(bucket[a]), pack(doc[a:b], start[a:b], n[a:b]), pack(data[ends[a] : ends[b]])) for a, b in zip(cuts, [*cuts[1:], len(bucket)])]
            if later:
                spans: list = []
                d, s = np.array(later, np.int64).T
                d, s, e = merge_spans(d, s, s + length)
                _blob_rows(COVERED, -1 - d % buckets, [d, s, e], spans)
                out += [(bucket, data, b"") for bucket, _, data in spans]
            pieces.clear(), first.clear(), later.clear()
            x, y, z = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.binary()), pa.array(z, pa.binary())], ["bucket", "data", "bytes"])

        for batch in it:
            ids, needs = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64), batch.column("needs")
            for at, x, off in batches(batch.column("text"), PART):
                mine = needs.slice(at, len(off) - 1)
                owner = np.repeat(np.arange(len(mine)), mine.value_lengths().to_numpy(zero_copy_only=False))
                start, end, gram, kind = (mine.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("start", "end", "gram", "kind"))
                doc = ids[at + owner]
                cold = kind == NEEDED
                n = (end - start)[cold]
                pieces.append((gram[cold] % buckets, doc[cold], start[cold], n, x[ranges(off[owner[cold]] + start[cold], n)]))
                size += int(n.sum())
                for i in np.flatnonzero(~cold).tolist():
                    a, b, base, own = int(start[i]), int(end[i]), int(off[owner[i]]), int(doc[i])
                    raw = x[base + a : base + b].tobytes()
                    part = np.lib.stride_tricks.sliding_window_view(x[base + a : base + b], length)
                    keys = (mix64((_BYTE[part] * _power(length)[0]).sum(1, dtype=np.uint64)) % np.uint64(buckets)).astype(np.int64).tolist()
                    for p, key in enumerate(keys):
                        body, place = raw[p : p + length], (own, a + p, key)
                        least = min(first.setdefault(body, place), place)
                        if least is place and first[body] is place:
                            size += length
                        else:
                            later.append(max(first[body], place)[:2])
                            first[body] = least
                            size += 16
                if size >= 32 << 20:
                    yield flush()
                    size = 0
        if pieces or first:
            yield flush()
        release()

    return run


def repeated_spans(data: np.ndarray, doc: np.ndarray, start: np.ndarray, size: np.ndarray, length: int):
    """Merged spans (doc, start, end) of the strings in the pieces that occur at a smaller (doc, start) in another piece."""
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(len(size)), size)
    inside = np.arange(len(data)) + length <= ends[owner]
    sa = two_stage(data, length, inside)
    sa = sa[inside[sa]]
    zero = np.zeros(0, np.int64)
    if len(sa) < 2:
        return zero, zero, zero
    equal = adjacent_equal(data, sa, length)
    group = np.concatenate([[0], np.cumsum(~equal)])
    size_of = np.bincount(group)
    sa, group = sa[size_of[group] > 1], group[size_of[group] > 1]
    p = owner[sa]
    d, at = doc[p], start[p] + sa - (ends - size)[p]
    o = np.lexsort((at, d, group))
    d, at, group = d[o], at[o], group[o]
    begin = np.r_[True, group[1:] != group[:-1]][: len(group)]
    lead = np.maximum.accumulate(np.where(begin, np.arange(len(group)), 0))
    later = (d != d[lead]) | (at != at[lead])
    return merge_spans(d[later], at[later], at[later] + length)


def _sort_bucket(length: int):
    def run(table: pa.Table) -> pa.Table:
        meta = [unpack(x.as_py()) for x in table.column("data")]
        if table.column("bucket")[0].as_py() < 0:  # spans that are covered already
            d, s, e = (np.concatenate(c) for c in zip(*meta))
            return _found([(COVERED, d, s, e, np.zeros(len(d), np.int64))])
        doc, start, size = (np.concatenate(c) for c in zip(*meta))
        data = np.concatenate([unpack(x.as_py())[0] for x in table.column("bytes")])
        d, s, e = repeated_spans(data, doc, start, size, length)
        return _found([(COVERED, d, s, e, np.zeros(len(d), np.int64))])

    return run


def covered_spans(docs: DataFrame, length: int = 100, hot: tuple[int, int] = HOT) -> DataFrame:
    """doc_id, spans: for each document with repeats, array of (start, end) bytes, unmerged across origins."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text")
    buckets = max(n_buckets(spark), sized_buckets(texts, PER_BUCKET))
    blobs = texts.mapInArrow(_find_pieces(length, buckets, hot[0]), _BLOBS)
    found = materialize(blobs.groupBy("bucket").applyInArrow(trimmed(lambda t: _judge_bucket(t, hot[1])), _FOUND))
    needs = found.where(F.col("kind") != COVERED).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "gram", "kind")).alias("needs"))
    cut = texts.join(needs.hint("shuffle_hash"), "doc_id").mapInArrow(_cut_pieces(length, buckets), _PIECE_ROWS)
    sorted_ = cut.groupBy("bucket").applyInArrow(trimmed(_sort_bucket(length)), _FOUND)
    spans = found.where(F.col("kind") == COVERED).select("doc_id", "start", "end").union(sorted_.select("doc_id", "start", "end"))
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def suffix_dedup(docs: DataFrame, length: int = 100, hot: tuple[int, int] = HOT) -> DataFrame:
    """All columns of `docs` with n_bytes, spans (maximal removed runs of bytes) and kept (binary, what is left).

    A byte is removed if a string of `length` bytes over it also starts earlier: in
    a document of smaller doc_id, or in the same at a smaller offset. Strings are
    judged on the input and never cross documents; overlaps count. Ids are
    integers; rows without one are left out; of repeated ids one row counts (see
    one_row_per_id). Null texts are empty and kept; texts shorter than `length`
    are kept whole. `hot`: see HOT; it moves work, not results. Columns named n_bytes, spans or kept are replaced.
    """
    docs = one_row_per_id(docs.drop("n_bytes", "spans", "kept"))
    joined = docs.join(covered_spans(docs, length, hot).hint("shuffle_hash"), "doc_id", "left")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.BinaryType())])
    names = docs.columns

    def run(it):
        for batch in it:
            spans = batch.column("spans").fill_null([])
            for at, x, off in batches(batch.column("text"), PART):
                mine = spans.slice(at, len(off) - 1)
                owner = np.repeat(np.arange(len(mine)), mine.value_lengths().to_numpy(zero_copy_only=False))
                owner, s, e = merge_spans(owner, *(mine.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("start", "end")))
                edge = np.zeros(len(x) + 1, np.int8)  # runs of a text never touch, but the last of one text may touch the first of the next
                np.add.at(edge, off[owner] + s, 1)
                np.add.at(edge, off[owner] + e, -1)
                kept = x[np.cumsum(edge[:-1], dtype=np.int8) == 0]
                left = np.diff(off) - np.bincount(owner, e - s, len(mine)).astype(np.int64)
                count = lambda n: pa.array(np.r_[0, np.cumsum(n)], pa.int32())
                runs = pa.ListArray.from_arrays(count(np.bincount(owner, minlength=len(mine))), pa.StructArray.from_arrays([pa.array(s, pa.int64()), pa.array(e, pa.int64())], ["start", "end"]))
                rest = pa.Array.from_buffers(pa.binary(), len(mine), [None, count(left).buffers()[1], pa.py_buffer(kept)])
                cols = [batch.column(c).slice(at, len(mine)) for c in names] + [pa.array(np.diff(off), pa.int64()), runs, rest]
                yield pa.RecordBatch.from_arrays(cols, [*names, "n_bytes", "spans", "kept"])
        release()

    return joined.select(*names, "spans").mapInArrow(run, schema)
