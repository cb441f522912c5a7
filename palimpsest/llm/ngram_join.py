"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters; links become components.

One pass over the texts deals each document's distinct shingles to buckets of
shingles, which count documents and answer those that share a shingle. A document
whose rare-first prefix is unshared needs nothing more. The others' prefixes are
joined in rounds, the entries of a shingle with a few leaders among them; what
passes the filters is verified on its shared shingles, once for each pair, and
pairs that verified links have connected already are not candidates any more.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce
from itertools import count as counting

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import batches, materialize, materialize_counted, materialize_with, mix64, n_buckets, narrow, one_row_per_id, pack, release, sized_buckets, trimmed, unpack
from palimpsest.llm.components import connected_components
from palimpsest.llm.suffix_dedup import _BYTE, SLICE, _power

WORDS = 5
THRESHOLD = Fraction(4, 5)
HASH_BITS = 56
FLUSH = 1_200_000  # shingles that a task holds before it sends them
HOT_HERE = 4096  # documents of a task that share a shingle, beyond which the shingle counts as saturated everywhere
SATURATED = (1 << 31) - 1
GROWTH = 8  # a round has so many times the leaders of the round before
BINS = 16  # equal parts of the hash space that the suffix filter counts
GROUP_PAIRS = 2000  # pairs whose sets are verified together
BUCKET_BYTES = 5 << 20  # of stored text, whose shingles a task holds at a time

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _cuts(x: np.ndarray):
    """Borders of slices of about SLICE bytes of a long text, each at a space."""
    a = 0
    while a < len(x):
        b = a + SLICE
        while b < len(x) and not (gap := _SPACE[x[b : b + SLICE]]).any():
            b += SLICE
        b = b + int(gap.argmax()) if b < len(x) else len(x)
        yield a, b
        a = b


def word_hashes(x: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the words of the texts x[off[i]:off[i + 1]], in their order."""
    n = len(x)
    if n > SLICE and len(off) == 2:
        parts = [word_hashes(x[a:b], np.array([0, b - a, b - a]))[1] for a, b in _cuts(x)]
        w = np.concatenate(parts)
        return np.zeros(len(w), np.int64), w
    x = _LOWER[x]
    word = ~_SPACE[x]
    edge = np.zeros(n + 1, bool)  # where a text begins
    edge[off] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | edge[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    power, inverse = _power(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[x] * power[:n], out=prefix[1:])
    return np.searchsorted(off, s, "right") - 1, mix64((prefix[e] - prefix[s]) * inverse[s] + (e - s).astype(np.uint64))


def shingle_hashes(x: np.ndarray, off: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct shingles of the texts x[off[i]:off[i + 1]], sorted by text and hash.

    A text of fewer words has its whole sequence as one shingle; one without words none.
    """
    texts = len(off) - 1
    text, w = word_hashes(x, off) if len(x) else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    if not len(w):
        return text, w
    count = np.bincount(text, minlength=texts)
    first = np.cumsum(count) - count
    base = np.uint64(0xA24BAED4963EE407)
    h = np.zeros(0, np.uint64)
    own = np.zeros(0, np.int64)
    if len(w) >= words:
        h = w[: len(w) - words + 1].copy()
        for k in range(1, words):
            h = h * base + w[k : len(w) - words + 1 + k]
        whole = text[: len(h)] == text[words - 1 :]
        h, own = mix64(h[whole] + np.uint64(words)), text[: len(whole)][whole]
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        few = w[first[short]]
        for k in range(1, words - 1):
            more = count[short] > k
            few[more] = few[more] * base + w[first[short[more]] + k]
        h, own = np.concatenate([h, mix64(few + count[short].astype(np.uint64))]), np.concatenate([own, short])
    h = h >> np.uint64(64 - HASH_BITS)
    o = np.argsort(h)
    o = o[np.argsort(own[o].astype(np.int32), kind="stable")]
    h, own = h[o], own[o]
    keep = np.r_[True, (h[1:] != h[:-1]) | (own[1:] != own[:-1])][: len(h)]
    return own[keep], h[keep]


_BLOBS = "bucket long, kind int, data binary"
SHINGLES, DOCS, SHARED, MARKS = 0, 1, 2, 3


def _rows(kind: int, bucket: np.ndarray, cols: list[np.ndarray], out: list, sort: np.ndarray | None = None) -> None:
    o = np.argsort(bucket, kind="stable") if sort is None else sort
    bucket = bucket[o]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
    for a, b in zip(cuts, [*cuts[1:], len(bucket)]):
        part = [c[o[a:b]] for c in cols]
        if kind == SHINGLES:  # sorted hashes as differences, ids as offsets
            part[0] = np.diff(part[0], prepend=np.uint64(0))
            low = part[1].min()
            part = [part[0], part[1] - low, np.full(len(part[1]), low, np.int64)] if len(part[1]) else part
        out.append((int(bucket[a]), kind, pack(*part)))


def _batch(rows: list) -> pa.RecordBatch:
    b, k, d = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(k, pa.int32()), pa.array(d, pa.binary())], ["bucket", "kind", "data"])


def _send(docs: list[tuple], shingles: list[tuple], buckets: int, chunks: int, hot_here: int) -> list:
    """A task's documents and the shingles of one document of each set of equal ones."""
    ids, n, sig1, sig2 = (np.concatenate(c) for c in zip(*docs))
    out: list = []
    _rows(DOCS, buckets + ids % chunks, [ids, n, sig1, sig2], out)
    o = np.lexsort((ids, sig2, sig1))
    lead = ids[o][np.r_[True, (sig1[o][1:] != sig1[o][:-1]) | (sig2[o][1:] != sig2[o][:-1])]]
    doc, h = (np.concatenate(c) for c in zip(*shingles))
    lead.sort()
    keep = lead[np.minimum(np.searchsorted(lead, doc), len(lead) - 1)] == doc
    doc, h = doc[keep], h[keep]
    o = np.argsort(h, kind="stable")
    doc, h = doc[o], h[o]
    begin = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
    size = np.diff(np.r_[begin, len(h)])
    # equal shares of the hash space: the order by hash is the order by bucket
    bucket = lambda h: ((h >> np.uint64(HASH_BITS - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    if (size > hot_here).any():
        hot = np.repeat(size > hot_here, size)
        _rows(SHARED, buckets + doc[hot] % chunks, [doc[hot], h[hot], np.full(hot.sum(), SATURATED, np.int64)], out)
        mark = h[begin[size > hot_here]]
        _rows(MARKS, bucket(mark), [mark], out)
        doc, h = doc[~hot], h[~hot]
    _rows(SHINGLES, bucket(h), [h, doc], out, np.arange(len(h)))
    return out


def _find_shingles(words: int, buckets: int, chunks: int, hot_here: int):
    def run(it):
        docs, shingles, held = [], [], 0
        for batch in it:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for first, x, off in batches(batch.column("text")):
                own = ids[first : first + len(off) - 1]
                text, h = shingle_hashes(x, off, words)
                n = np.bincount(text, minlength=len(own))
                sums = []
                for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                    total = np.r_[np.uint64(0), np.cumsum(mix64(h ^ np.uint64(c)))]
                    at = np.r_[0, np.cumsum(n)]
                    sums.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
                docs.append((own, n.astype(np.int64), *sums))
                shingles.append((own[text], h))
                held += len(h) + len(own)
                if held >= FLUSH:
                    yield _batch(_send(docs, shingles, buckets, chunks, hot_here))
                    docs, shingles, held = [], [], 0
        if docs:
            yield _batch(_send(docs, shingles, buckets, chunks, hot_here))
        docs = shingles = None
        release()

    return run


def _answer(buckets: int, chunks: int):
    """Each document that shares a shingle learns of it and of how many documents have it."""

    def run(table: pa.Table) -> pa.Table:
        out, got, marks = [], [], [np.zeros(0, np.uint64)]
        for bucket, kind, data in zip(*(table.column(c).to_pylist() for c in ("bucket", "kind", "data"))):
            if kind == SHINGLES:
                d, doc, low = unpack(data)
                got.append((np.cumsum(d), doc + low))
            elif kind == MARKS:
                marks += unpack(data)
            else:
                out.append((bucket, kind, data))
        if got:
            h, doc = (np.concatenate(c) for c in zip(*got))
            o = np.argsort(h, kind="stable")
            h, doc = h[o], doc[o]
            begin = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
            size = np.diff(np.r_[begin, len(h)])
            marked = np.isin(h[begin], np.concatenate(marks))
            shared = np.repeat((size > 1) | marked, size)
            df = np.repeat(np.where(marked, SATURATED, size), size)[shared]
            doc, h = doc[shared], h[shared]
            _rows(SHARED, buckets + doc % chunks, [doc, h, df.astype(np.int64)], out)
        if not out:
            return pa.table({"bucket": pa.array([], pa.int64()), "kind": pa.array([], pa.int32()), "data": pa.array([], pa.binary())})
        return pa.Table.from_batches([_batch(out)])

    return run


_SETS = "doc_id long, n long, sig1 long, sig2 long, unshared long, prefix int, shared array<long>, bins array<int>"


def prefix_length(n: np.ndarray, threshold: Fraction = THRESHOLD) -> np.ndarray:
    """Two sets of a sufficient overlap share one of so many first elements of either."""
    return n - -(-n * threshold.numerator // threshold.denominator) + 1


def _assemble(threshold: Fraction):
    """Each document with the shingles that it shares, rarest first, if its prefix holds any of them."""

    def run(table: pa.Table) -> pa.Table:
        docs, shared = [], []
        for kind, data in zip(table.column("kind").to_pylist(), table.column("data").to_pylist()):
            (docs if kind == DOCS else shared).append(unpack(data))
        ids, n, sig1, sig2 = (np.concatenate(c) for c in zip(*docs))
        o = np.argsort(ids, kind="stable")
        ids, n, sig1, sig2 = ids[o], n[o], sig1[o], sig2[o]
        doc, h, df = (np.concatenate(c) for c in zip(*shared)) if shared else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        o = np.lexsort((h, df, doc))
        doc, h = doc[o], h[o]
        a, b = np.searchsorted(doc, ids), np.searchsorted(doc, ids, "right")
        unshared = n - (b - a)
        prefix = np.where(b > a, prefix_length(n, threshold) - unshared, 0)
        live = prefix > 0
        b = np.where(live, b, a)
        size = b - a
        at = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(h[at].astype(np.int64)))
        row = np.repeat(np.cumsum(live) - 1, size)
        bins = np.bincount(row * BINS + (h[at] >> np.uint64(HASH_BITS - 4)).astype(np.int64), minlength=int(live.sum()) * BINS).astype(np.int32)
        bins = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(live * BINS)].astype(np.int32)), pa.array(bins))
        return pa.table({"doc_id": ids, "n": n, "sig1": sig1, "sig2": sig2, "unshared": unshared, "prefix": np.where(live, prefix, 0).astype(np.int32), "shared": lists, "bins": bins})

    return run


def shingle_sets(docs: DataFrame, words: int = WORDS, threshold: Fraction = THRESHOLD, hot_here: int = HOT_HERE) -> DataFrame:
    """doc_id, n, sig1, sig2, unshared, prefix, shared, bins for each document; see _assemble.

    The numbers of buckets and chunks follow the stored size of the texts. A bucket
    answers a chunk in one row, if it has anything to say: so there are never more
    such rows than occurrences of shared shingles.
    """
    buckets = sized_buckets(docs, BUCKET_BYTES)
    chunks = buckets
    blobs = docs.select("doc_id", "text").mapInArrow(_find_shingles(words, buckets, chunks, hot_here), _BLOBS)
    answered = blobs.groupBy("bucket").applyInArrow(trimmed(_answer(buckets, chunks)), _BLOBS)
    return answered.groupBy("bucket").applyInArrow(trimmed(_assemble(threshold)), _SETS)


def _possible(threshold: Fraction):
    """Length and positional filters of two prefix entries (n, pos) and (m, at)."""
    p, q = threshold.numerator, threshold.denominator
    need = F.ceil(F.lit(p) * (F.col("n") + F.col("m")) / F.lit(p + q))
    rest = F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("at"))
    return (F.least("n", "m") * q >= F.greatest("n", "m") * p) & (rest >= need)


def _verify_bucket(threshold: Fraction):
    p, q = threshold.numerator, threshold.denominator

    def run(table: pa.Table) -> pa.Table:
        lead, salt, doc, n = (table.column(c).to_numpy() for c in ("u", "salt", "doc_id", "n"))
        lists = table.column("shared").combine_chunks()
        flat, off = lists.values.to_numpy(), lists.offsets.to_numpy()
        links = []
        order = np.lexsort((doc != lead, salt, lead))  # a leader before its partners
        own = None
        for i in order:
            s = np.sort(flat[off[i] : off[i + 1]])
            if doc[i] == lead[i]:
                own, size = s, int(n[i])
                continue
            at = np.searchsorted(own, s)
            at[at == len(own)] = 0
            both = int((own[at] == s).sum()) if len(own) else 0
            if q * both >= p * (size + int(n[i]) - both):
                links.append((lead[i], doc[i]))
        u, v = zip(*links) if links else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def verify_pairs(pairs: DataFrame, sets: DataFrame, threshold: Fraction = THRESHOLD, group: int = 256, rows: int | None = None, size: int | None = None) -> DataFrame:
    """Those (u, v) whose sets reach the threshold. A leader u with many partners is dealt to several groups.

    `rows` and `size` are about the numbers of pairs and of sets; they are counted if not given.
    """
    rows = pairs.count() if rows is None else rows
    size = sets.count() if size is None else size
    buckets = max(n_buckets(pairs.sparkSession), -(-rows // GROUP_PAIRS))
    count = pairs.groupBy("u").count().select("u", F.ceil(F.col("count") / group).alias("parts"))
    dealt = narrow(pairs.join(materialize(narrow(count, rows)), "u").select("u", F.pmod(F.xxhash64("v"), "parts").alias("salt"), "v"), rows)
    body = sets.select("doc_id", "n", "shared")
    partners = dealt.join(body, dealt["v"] == body["doc_id"]).select("u", "salt", "doc_id", "n", "shared")
    leaders = narrow(dealt.select("u", "salt").distinct(), rows).join(body, F.col("u") == body["doc_id"]).select("u", "salt", "doc_id", "n", "shared")
    dealt_sets = narrow(partners, rows + size, 2000).union(narrow(leaders, rows + size, 2000)).withColumn("bucket", F.pmod(F.xxhash64("u", "salt"), F.lit(buckets)))
    return narrow(dealt_sets.groupBy("bucket").applyInArrow(trimmed(_verify_bucket(threshold)), "u long, v long"), rows + size, 4000)


def _enough(most, threshold: Fraction):
    """Whether two sets of n and m elements can link that have `most` in common, at most."""
    p, q = threshold.numerator, threshold.denominator
    return (p + q) * most >= p * (F.col("n") + F.col("m"))


def _suffixes_allow(pairs: DataFrame, sets: DataFrame, threshold: Fraction, rows: int) -> DataFrame:
    """Suffix filter: pairs whose sets can share enough, by what each part of the hash space holds of either."""
    for key, n, bins in (("u", "n", "x"), ("v", "m", "y")):
        slim = sets.select(F.col("doc_id").alias(key), F.col("n").alias(n), F.col("bins").alias(bins))
        pairs = narrow(pairs.join(slim, key), rows)
    most = F.aggregate(F.zip_with("x", "y", lambda a, b: F.least(a, b)), F.lit(0), lambda s, x: s + x)
    return pairs.where(_enough(most, threshold)).select("u", "v")


def links_and_components(sets: DataFrame, threshold: Fraction = THRESHOLD, growth: int = GROWTH) -> DataFrame:
    """(node, component) over the given sets, one document of each class of equal sets."""
    entries = sets.select("doc_id", "n", F.posexplode(F.slice("shared", F.lit(1), F.col("prefix"))).alias("i", "h"), "unshared")
    entries = entries.select("h", "doc_id", "n", (F.col("unshared") + F.col("i")).alias("pos"))
    size, total = sets.agg(F.count(F.lit(1)), F.coalesce(F.sum("prefix"), F.lit(0))).first()
    return leader_rounds(
        entries, total, size, threshold, growth,
        lambda pairs, rows: _suffixes_allow(pairs, sets, threshold, rows),
        lambda pairs, rows: verify_pairs(pairs, sets, threshold, rows=rows, size=size),
    )


def leader_rounds(entries: DataFrame, total: int, size: int, threshold: Fraction, growth: int, plausible, verify) -> DataFrame:
    """(node, component) of the documents that verified links connect; documents meet where their entries (h, doc_id, n, pos) share h.

    Entries may carry bins as well: then the suffix filter is a condition of meeting.

    A round pairs the entries of each h with its leaders: the first in
    an order of documents that is the same for all h, one in the first round,
    `growth` times as many in each that follows. Then leaders have met all others of
    their h and leave it; those whose entries one component holds are
    settled. Rounds go on until none is left, so no link between components is
    missed, and are logarithmic in the largest number of entries of an h.
    `plausible` drops pairs (u, v) that can't be links, `verify` gives those that are;
    either gets the number of rows too.

    What is counted for an h is written before it is joined back: a join of
    two written tables lets Spark split the rows of a hot key.
    """
    own = [c for c in entries.columns if c == "bins"]
    entries = entries.select("h", "doc_id", "n", "pos", *own, (F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5).alias("order"))
    can_link = _possible(threshold)
    if own:
        can_link &= _enough(sum(F.least(F.get("bins", F.lit(i)), F.get("theirs_bins", F.lit(i))) for i in range(BINS)), threshold)
    tried, labels = [], None
    for r in counting():
        rest = entries.withColumn("component", F.col("doc_id"))
        if labels is not None:
            rest = entries.join(labels, entries["doc_id"] == labels["node"], "left").select(*entries.columns, F.coalesce("component", "doc_id").alias("component"))
            rest = narrow(rest, total)
        groups = rest.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("component").alias("a"), F.max("component").alias("b"), F.min("order").alias("low"))
        last = F.col("low") + (growth**r - 1) * (1 - F.col("low")) / F.col("c")
        groups = groups.where("a <> b").select("h", last.alias("last"), "c")
        groups, (meet,) = materialize_with(narrow(groups, total), F.sum(F.col("c") * F.least("c", F.lit(growth**r))))
        rest = rest.join(groups.select("h", "last"), "h").withColumn("leads", F.col("order") <= F.col("last")).drop("last")
        rest, total = materialize_counted(narrow(rest, total))
        if not total:
            break
        meet = max(total, meet or 0)  # pairs of an entry and a leader, about
        leaders = rest.where("leads").select("h", F.col("doc_id").alias("u"), F.col("n").alias("m"), F.col("pos").alias("at"), F.col("component").alias("theirs"), *[F.col(c).alias(f"theirs_{c}") for c in own])
        met = rest.join(leaders, "h").where(F.col("component") != F.col("theirs")).where(can_link)
        # a pair can meet at several h, and two leaders from either side
        pairs = met.groupBy(F.least("u", "doc_id").alias("a"), F.greatest("u", "doc_id").alias("b")).agg(F.min("u").alias("u"))
        pairs = narrow(pairs, meet)
        if tried:
            pairs = narrow(pairs.join(reduce(DataFrame.union, tried), ["a", "b"], "left_anti"), meet)
        pairs = pairs.select("u", F.when(F.col("u") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("v"))
        pairs, n = materialize_counted(plausible(pairs, meet))
        if n:
            tried.append(pairs.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")))
            links = verify(pairs, n)
            if labels is not None:  # what is connected already stands for its links
                links = links.union(labels.where("node <> component").select("node", "component"))
            labels = connected_components(links, n + size)
        entries = rest.where("not leads").select(*entries.columns)
    if labels is None:
        return entries.sparkSession.createDataFrame([], "node long, component long")
    return labels


def of_all_copies(sets: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of `sets` (doc_id, n, sig1, sig2), from the components of one document of each class (sig1, sig2, lead, copies) of equal sets."""
    several = classes.where("copies > 1").select("sig1", "sig2", "lead")
    several = materialize(narrow(several, sets.count()))  # apart, so that the copies of a hot document can be split
    found = sets.select("doc_id", "n", "sig1", "sig2").join(several, ["sig1", "sig2"], "left")
    found = found.withColumn("lead", F.when(F.col("n") > 0, F.coalesce("lead", "doc_id")).otherwise(F.col("doc_id")))
    found = found.join(labels, F.col("lead") == F.col("node"), "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "lead").alias("component_id"))


def ngram_join(docs: DataFrame, words: int = WORDS, threshold: Fraction = THRESHOLD, hot_here: int = HOT_HERE, growth: int = GROWTH) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable over links, itself included.

    Words are runs of bytes other than space, tab and line breaks, with A-Z
    lower-cased; a document's set is its distinct runs of `words` words. Two
    documents link when their sets' Jaccard similarity reaches the threshold.
    Documents without words, null and empty texts are linked with nothing. Ids are
    integers of any sign, rows without one are left out, of repeated ids one row
    counts (see one_row_per_id). Other columns are ignored. Sets are compared by 56-bit hashes
    of their shingles.
    """
    docs = one_row_per_id(docs.select("doc_id", "text"))
    sets = materialize(shingle_sets(docs, words, threshold, hot_here))
    classes = sets.where("n > 0").groupBy("sig1", "sig2").agg(F.min("doc_id").alias("lead"), F.count(F.lit(1)).alias("copies"))
    leads = classes.select("lead")
    live = materialize(sets.where("prefix > 0").join(leads, F.col("doc_id") == F.col("lead"), "left_semi"))
    labels = links_and_components(live, threshold, growth)
    return of_all_copies(sets, classes, labels)
