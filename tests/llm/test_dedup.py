import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import components, ngram_join, suffix_array, suffix_dedup
from palimpsest.llm.common import batches, pack, unpack
from tests.llm import brute

DOCS = "doc_id long, text string"


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=300), st.integers(0, 3))
def test_suffix_array_is_sorted(text, copies):
    text = text * (copies + 1)
    sa = suffix_array.two_stage(np.frombuffer(text, np.uint8), 100)
    heads = [(text[i : i + 100] + bytes(100))[:100] for i in sa]
    assert sorted(sa.tolist()) == list(range(len(text))) and heads == sorted(heads)


def test_suffix_array_sorts_directly_what_is_smaller_than_its_successor():
    t = np.frombuffer(b"mississippi", np.uint8)
    assert suffix_array._smaller_than_successor(t).tolist() == [t[i:].tobytes() < t[i + 1 :].tobytes() for i in range(len(t))]
    assert suffix_array.two_stage(t, 100).tolist() == sorted(range(11), key=lambda i: t[i:].tobytes())


def test_stage_one_sorts_only_what_the_wanted_suffixes_come_from(monkeypatch):
    r = np.random.default_rng(3)
    t = np.tile(r.integers(0, 4, 700, np.uint8), 3)
    wanted, sorted_, sort = r.random(len(t)) < 0.1, [], suffix_array._sort_directly
    monkeypatch.setattr(suffix_array, "_sort_directly", lambda pos, *a: sorted_.append(len(pos)) or sort(pos, *a))
    whole = suffix_array.two_stage(t, 100)
    sa = suffix_array.two_stage(t, 100, wanted)
    heads = [t[i : i + 100].tobytes() for i in sa]
    assert heads == sorted(heads) and len(set(sa.tolist())) == len(sa) and set(np.flatnonzero(wanted)) <= set(sa.tolist())
    assert len(whole) == len(t) and sorted_[1] < 0.5 * sorted_[0]


def test_a_boilerplate_line_in_a_thousand_surroundings_stays_in_pieces():
    """A hundred bytes for each string cost 27 times a piece's bytes: that is for K-grams that a bucket can't hold."""
    n = np.arange(1000)
    part = (np.full(1000, 7, np.uint64), n.astype(np.uint64), n, np.full(1000, 5), np.full(1000, 141))
    kinds = {kind for _, kind, _ in suffix_dedup._local([part], 8, suffix_dedup.HOT[0])}
    assert kinds == {suffix_dedup.PIECES}


def test_adjacent_prefixes():
    t = np.frombuffer(b"abcdefghijk-abcdefghijz", np.uint8)
    sa = suffix_array.two_stage(t, 10)
    sa = sa[sa + 10 <= len(t)]
    equal = suffix_array.adjacent_equal(t, sa, 10)
    assert {tuple(sorted((int(sa[i]), int(sa[i + 1])))) for i in np.flatnonzero(equal)} == {(0, 12)}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(-(2**40), 2**40)), max_size=50))
def test_pack(rows):
    a, b = np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64)
    x, y = unpack(pack(a, b))
    assert (x == a).all() and (y == b).all() and x.dtype == np.uint64


def mixed_docs(seed=3, n=250):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdefgh é") for _ in range(400)) for _ in range(6)]
    docs = [(5, None), (7, ""), (8, "é" * 300), (9, "é" * 300), (10, "x" * 5000), (11, "y" + "x" * 90)]
    for i in range(n):
        a, b = r.choice(base)[: r.randint(0, 400)], r.choice(base)[r.randint(0, 300) :]
        docs.append((100 + i, a + b + "x" * r.choice([0, 0, 150]) + "".join(r.choice("ab") for _ in range(r.randint(0, 150))) + r.choice(base)[50:250]))
    return docs


def suffix_result(df):
    rows = df.select("doc_id", "n_bytes", "spans", "kept").collect()
    return {x.doc_id: (x.n_bytes, sum(s.end - s.start for s in x.spans), len(x.spans), hashlib.sha256(bytes(x.kept)).hexdigest()) for x in rows}


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, (1, 3), (512, 4)])
def test_suffix_dedup(spark, hot):
    """Also where K-grams count as hot, in a task or in all: results do not change."""
    docs = mixed_docs()
    df = spark.createDataFrame(docs, DOCS).repartition(5)
    assert suffix_result(suffix_dedup.suffix_dedup(df, hot=hot)) == brute.suffix_dedup(docs)


def test_suffix_dedup_long_text_in_slices(monkeypatch):
    r = random.Random(1)
    part = "".join(r.choice("abcdefghij ") for _ in range(3000))
    docs = [(1, part + "".join(r.choice("klm") for _ in range(500)) + part), (2, part[1000:2500])]
    found = []
    monkeypatch.setattr(suffix_dedup, "SLICE", 700)
    monkeypatch.setattr(suffix_dedup, "batches", lambda text: batches(text, 600))
    for own, base, x, off in suffix_dedup._sliced(np.array([d[0] for d in docs]), pa.array([d[1] for d in docs]), 100):
        f = suffix_dedup.find_anchors(x, off, 100)
        found += list(zip(own[f.text], f.start + base[f.text], f.end + base[f.text]))
    for doc, text in docs:
        strings = sorted(p for d, a, b in found if d == doc for p in range(a, b - 99))
        assert strings == list(range(len(text) - 99))


def test_suffix_dedup_of_a_hot_passage_and_a_long_text(spark):
    """A passage that many documents hold in other surroundings, its strings one by one; negative ids; a text of many slices."""
    r = random.Random(6)
    word = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    passage = word(260)
    docs = [(i - 60, word(r.randint(0, 150)) + passage[r.randint(0, 40) :] + word(r.randint(0, 150))) for i in range(120)]
    docs.append((1000, word(200_000) + passage + word(1000) + passage))
    df = spark.createDataFrame(docs, DOCS).repartition(4)
    for hot in (suffix_dedup.HOT, (1, 2)):
        assert suffix_result(suffix_dedup.suffix_dedup(df, hot=hot)) == brute.suffix_dedup(docs)


def test_suffix_dedup_edges(spark):
    assert suffix_result(suffix_dedup.suffix_dedup(spark.createDataFrame([], DOCS))) == {}
    long = "0123456789" * 20
    df = spark.createDataFrame([(1, long, "a", 9), (1, None, "b", 8), (None, long, "c", 7), (2, long, None, None)], "doc_id long, text string, spans string, bucket int")
    out = suffix_dedup.suffix_dedup(df)
    got = {r.doc_id: (bytes(r.kept), r.bucket) for r in out.collect()}
    assert got == {1: (b"0123456789", 9), 2: (b"", None)}
    assert out.columns == ["doc_id", "text", "bucket", "n_bytes", "spans", "kept"]


def test_shingles_of_a_long_text_in_slices(monkeypatch):
    r = random.Random(4)
    text = " ".join("".join(r.choice("abcXé") for _ in range(r.randint(1, 9))) for _ in range(900)) + "y" * 300 + " \t z  "
    x = np.frombuffer(text.encode(), np.uint8)
    whole = ngram_join.shingle_hashes(x, np.array([0, len(x)]))
    assert len(whole[1]) == len(brute.shingles(text))
    for size in (1, 7, 100, 5000):
        monkeypatch.setattr(ngram_join, "SLICE", size)
        assert all((a == b).all() for a, b in zip(whole, ngram_join.shingle_hashes(x, np.array([0, len(x)]))))


def near_docs(seed=3, n=300):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    base = [[r.choice(words) for _ in range(r.randint(3, 60))] for _ in range(12)]
    docs = [(5, None), (6, ""), (7, " \t"), (8, "A b"), (9, "a  B"), (10, "a b c d E"), (11, "a b c d"), (12, " ".join(f"u{i}" for i in range(20_000)))]
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 3)):
            j = r.randrange(len(w))
            w[j : j + r.randint(0, 1)] = [r.choice(words)] * r.randint(0, 2) or ["z"]
        docs.append((100 + i, " ".join(w)))
    return docs


@pytest.mark.parametrize("how", [{}, {"hot_here": 2}, {"growth": 2}, {"growth": 1000, "hot_here": 5}])
def test_ngram_join(spark, how):
    """Also with saturated shingles, and with more rounds, or with all entries as leaders in the second: results do not change."""
    docs = near_docs()
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.ngram_join(df, **how).collect()} == brute.ngram_join(docs)


@pytest.mark.parametrize("hot_here", [2, ngram_join.HOT_HERE])
def test_ngram_join_with_negative_ids(spark, hot_here):
    docs = [(d - 250, t) for d, t in near_docs(4)]
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.ngram_join(df, hot_here=hot_here).collect()}
    assert got == brute.ngram_join(docs) and any(c < 0 < d for d, (_, c) in got.items())


def test_ngram_join_of_one_large_group(spark):
    """Near-copies of one text, of which many link with few others only: chains and stars of links are found whole."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(260):
        w = list(base)
        for j in r.sample(range(120), r.choice([1, 2, 3, 4, 6])):
            w[j] = f"x{r.randint(0, 40)}"
        docs.append((i - 100, " ".join(w)))
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.ngram_join(df).collect()}
    assert got == brute.ngram_join(docs) and len({c for _, c in got.values()}) > 1


def test_ngram_join_edges(spark):
    assert ngram_join.ngram_join(spark.createDataFrame([], DOCS)).count() == 0
    text = "one two three four five six"
    df = spark.createDataFrame([(3, text, 1, "x"), (2, text, 2, None), (2, text, 2, None), (None, text, 1, "")], "doc_id long, text string, n int, component string")
    assert sorted(map(tuple, ngram_join.ngram_join(df).collect())) == [(2, 2, 2), (3, 2, 2)]


def test_threshold_is_inclusive(spark):
    words = [f"w{i}" for i in range(13)]  # 9 shingles
    docs = [(1, " ".join(words)), (2, " ".join(words[:12]))]  # 8 of 9
    ten = [f"v{i}" for i in range(14)]  # 10 shingles; 8 of 10 shared is exactly 0.8
    docs += [(3, " ".join(ten)), (4, " ".join(ten[:12]))]
    got = {x.doc_id: x.component_id for x in ngram_join.ngram_join(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3}


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(7, 7)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(30)]
    got = {x.node: x.component for x in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    top = {}
    for a, b in edges:
        if a != b:
            x, y = top.setdefault(a, {a}), top.setdefault(b, {b})
            if x is not y:
                x |= y
                top.update(dict.fromkeys(y, x))
    assert got == {k: min(v) for k, v in top.items()}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_rare_first_prefix_suffices():
    """Sets at the threshold share an element of their prefixes in any common order."""
    r = random.Random(5)
    for _ in range(300):
        n = r.randint(1, 40)
        a = set(range(n))
        b = set(list(a)[r.randint(0, n // 5) :]) | {1000 + i for i in range(r.randint(0, 3))}
        if not b or 5 * len(a & b) < 4 * len(a | b):
            continue
        order = {x: r.random() for x in a | b}
        cut = lambda s: set(sorted(s, key=order.get)[: int(ngram_join.prefix_length(np.array([len(s)]))[0])])
        assert cut(a) & cut(b)
