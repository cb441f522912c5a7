"""The multi-index Hamming join against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import minhash, ngram_join
from tests.llm import brute

DOCS = "doc_id long, text string"


def test_chunks_and_constants():
    assert minhash.PARTS % minhash.CHUNK == 0 and minhash.SURE < minhash.FAR < minhash.PARTS


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, minhash.SURE))
def test_signatures_within_the_distance_share_a_key(seed, errors):
    """The guarantee: no way to spread SURE errors leaves all keys different."""
    r = np.random.default_rng(seed)
    a = r.integers(-(2**15), 2**15, minhash.PARTS).astype(np.int16)
    b = a.copy()
    b[r.permutation(minhash.PARTS)[:errors]] += 1
    x, y = minhash.keys_of(np.array([a, b]))
    assert (x == y).any()


def test_errors_beyond_the_distance_can_hide():
    a = np.arange(minhash.PARTS, dtype=np.int16)
    b = a.copy()
    b[:: minhash.CHUNK] += 1
    b[1 :: minhash.CHUNK] += 1
    x, y = minhash.keys_of(np.array([a, b]))
    assert not (x == y).any() and len(set(x.tolist())) == minhash.PARTS


def test_distance_follows_similarity():
    """Parts differ with the probability of 1 - J, for large and for very small sets."""
    r = np.random.default_rng(5)
    for both, own in ((80, 10), (8, 1), (4, 0)):
        got = []
        for _ in range(400):
            h = ngram_join.mix64(r.integers(0, 2**63, both + 2 * own, dtype=np.uint64)) >> np.uint64(8)
            a, b = np.sort(h[: both + own]), np.sort(np.r_[h[:both], h[both + own :]])
            x, y = minhash.signatures_of(np.concatenate([a, b]), np.array([len(a), len(b)]))
            got.append((x != y).sum())
        assert abs(np.mean(got) / minhash.PARTS - 2 * own / (both + 2 * own)) < 0.01 and max(got) <= minhash.FAR


def test_signatures_of_empty_sets():
    h = np.array([3, 9], np.uint64)
    sig = minhash.signatures_of(h, np.array([0, 2, 0]))
    assert (sig[0] == sig[2]).all() and (sig[1] != sig[0]).any()
    assert minhash.signatures_of(h[:0], np.array([0])).shape == (1, minhash.PARTS)


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def want(docs):
    shingles = {d: brute.shingles(t, 4) for d, t in docs}
    parts = brute.join(shingles)
    return {d: (len(s), parts[d], parts[d] == d) for d, s in shingles.items()}


def texts(seed, n=300):
    """Originals, chains of edits, copies, shared passages and short texts."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    common = [r.choice(words) for _ in range(60)]
    out = []
    for _ in range(n):
        t = [r.choice(words) for _ in range(r.choice([1, 3, 4, 5, 6, 20, 80, 200]))]
        if out and r.random() < 0.6:
            t = r.choice(out).split(" ")
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                t[r.randrange(len(t))] = r.choice(words)
        elif r.random() < 0.3:
            t += common
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("seed, hot, growth, crowd", [(1, 4096, 8, 32), (2, 3, 2, 1), (3, 0, 8, 4)])
def test_equals_brute_force(spark, seed, hot, growth, crowd):
    docs = [(i * 7 - 900, t.upper() if i % 5 == 0 else t) for i, t in enumerate(texts(seed))]
    df = spark.createDataFrame(docs, DOCS).repartition(5)
    assert got(minhash.near_duplicates(df, hot_here=hot, growth=growth, crowd=crowd)) == want(docs)


def test_nulls_empty_repeated_long_and_clashing_columns(spark):
    long = " ".join(f"x{i}" for i in range(60_000))
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  b"), (6, "a b c"), (7, long), (8, long + " y"), (9, "é ü"), (10, "é  ü "), (11, None)]
    df = spark.createDataFrame([(*d, 1, 2, "s", 3) for d in docs] + [(None, "a b", 1, 2, "s", 3)], DOCS + ", n int, h int, sig string, lead int")
    out = minhash.near_duplicates(df)
    assert got(out) == want(docs) and out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert minhash.near_duplicates(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "b"), (1, "a b c d"), (2, "a b c d")], DOCS)
    assert got(minhash.near_duplicates(twice)) == {1: (1, 1, True), 2: (1, 2, True)}


def test_a_key_of_many_documents_is_not_gathered(spark):
    """Entries of a hot key go straight to all buckets, and nothing is lost or given twice."""
    sig = np.random.default_rng(3).integers(-99, 99, (200, minhash.PARTS)).astype(np.int16)
    sig[:150, : minhash.CHUNK] = 7
    batch = minhash._send([(np.arange(200), np.full(200, 9), sig)], 10, 50)
    kinds = batch.column("kind").to_pylist()
    assert kinds.count(minhash.STRAIGHT) == 10 and minhash.MARKS in kinds
    rows = []
    for b in range(10):
        t = pa.Table.from_batches([batch]).filter(pa.compute.equal(batch.column("bucket"), b))
        rows += [(r["h"], r["doc_id"]) for r in minhash._shared(t).to_pylist()]
    keys = minhash.keys_of(sig).view(np.int64)
    having = {}
    for d, row in enumerate(keys.tolist()):
        for k in row:
            having.setdefault(k, []).append(d)
    assert sorted(rows) == sorted((k, d) for k, ds in having.items() if len(ds) > 1 for d in ds)


def test_groups_of_near_copies_are_met_by_leaders_only(spark, monkeypatch):
    """400 near copies: the pairs that are compared grow with the group, not with its square."""
    r = random.Random(4)
    base = [f"w{r.randrange(10**6)}" for _ in range(300)]
    docs = []
    for i in range(400):
        t = list(base)
        t[r.randrange(300)] = f"e{i}"
        docs.append((i, " ".join(t)))
    seen, real = [], minhash._near
    monkeypatch.setattr(minhash, "_near", lambda pairs, *a: (seen.append(pairs.count()), real(pairs, *a))[1])
    parts = got(minhash.near_duplicates(spark.createDataFrame(docs, DOCS)))
    assert {c for _, c, _ in parts.values()} == {0} and sum(seen) < 20 * 400
