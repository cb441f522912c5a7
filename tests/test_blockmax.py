"""Block-max search against scoring everything."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.operators import blockmax, bm25
from palimpsest.plans.store import RetrievalStore
from palimpsest.sources.schemas import ROUND, VECTOR_ROW


def corpus(n=900, seed=1):
    """Words of very different frequency, exact copies, empty texts."""
    r = random.Random(seed)
    words = [f"w{i}x" for i in range(400)]
    weight = [1 / (i + 1) for i in range(400)]
    docs = [(f"d{i:04}", " ".join(r.choices(words, weight, k=r.choice([0, 3, 20, 60])))) for i in range(n)]
    return docs + [(f"e{i:04}", docs[5][1]) for i in range(40)], [(f"q{i}", " ".join(r.choices(words, weight, k=8)) + f" w{300 + i}x") for i in range(12)] + [("none", "zzz"), ("blank", ""), ("copies", docs[5][1])]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    docs, queries = corpus()
    d, q = spark.createDataFrame(docs, "k string, t string"), spark.createDataFrame(queries, "query string, text string")
    postings, lengths = bm25.postings(d, "k", "t"), bm25.doc_lengths(d, "k", "t")
    terms = bm25.query_terms(q, "query", "text")
    whole = {}
    for r in bm25.score_index(postings, lengths, terms, "k", "query").collect():
        whole.setdefault(r.query, {})[r.k] = r.score
    path = f"file://{tmp_path_factory.mktemp('blocks')}"
    blockmax.write(d, "k", "t", path, size=64)
    return blockmax.read(spark, path), terms, whole


def same(got, scores, k):
    """The k best, and all that tie with the last of them."""
    floor = sorted(scores.values(), reverse=True)[:k][-1] * (1 - blockmax.TIES) if len(scores) >= k else 0
    want = {d: s for d, s in scores.items() if s >= floor}
    return {d: round(s, 9) for d, s in got.items()} == {d: round(s, 9) for d, s in want.items()}


@pytest.mark.parametrize("k", [1, 10, 2000])
def test_equals_scoring_everything(made, k):
    index, terms, whole = made
    got = {}
    for r in blockmax.best(index, terms, k).collect():
        got.setdefault(r.query, {})[r.key] = r.score
    assert index.ranges > blockmax.FIRST and set(got) == set(whole)
    assert all(same(got[q], whole[q], k) for q in whole)
    assert k > 1 or len(got["copies"]) == 41


def test_a_scope_comes_before_the_floor(spark, made):
    index, terms, whole = made
    scope = spark.createDataFrame([(f"d{i:04}",) for i in range(0, 900, 7)], "key string")
    inside = {r.key for r in scope.collect()}
    got = {}
    for r in blockmax.best(index, terms, 5, scope).collect():
        got.setdefault(r.query, {})[r.key] = r.score
    for q, scores in whole.items():
        part = {d: s for d, s in scores.items() if d in inside}
        assert same(got.get(q, {}), part, 5) if part else q not in got


def test_blocks_are_skipped(made):
    """Later ranges open fewer blocks than they have, and no table of queries and documents comes about."""
    index, terms, whole = made
    hits = blockmax.hits(index, terms.where("query <> 'copies'"), 3)
    opened, held = hits.where(F.col("range") % blockmax.FIRST != 0).agg(F.sum("opened"), F.sum("blocks")).first()
    assert 0 < opened < 0.9 * held
    assert hits.count() < 0.5 * sum(len(s) for q, s in whole.items() if q != "copies")


def test_turns_of_queries(made, monkeypatch):
    index, terms, whole = made
    once = sorted(map(tuple, blockmax.best(index, terms, 4).collect()))
    monkeypatch.setattr(blockmax, "TERMS", 30)
    assert [x[:2] for x in sorted(map(tuple, blockmax.best(index, terms, 4).collect()))] == [x[:2] for x in once]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 6), st.floats(0, 12))
def test_a_range_keeps_all_that_reaches_the_floor(seed, k, floor):
    r = np.random.default_rng(seed)
    n, blocks, whole = 30, {}, np.zeros(30)
    terms = [(f"t{i}", float(r.uniform(0.1, 5))) for i in range(6)]
    for t, idf in terms[:5]:
        places = np.sort(r.choice(n, r.integers(1, n), replace=False))
        gains = r.uniform(0.1, 2.2, len(places))
        blocks[t] = (places, gains, float(gains.max()))
        whole[places] += idf * gains
    wanted = r.random(n) < 0.8
    found, score, opened = blockmax.best_of_range(blocks, wanted, terms, floor, k)
    able = np.flatnonzero(wanted & (whole > 0) & (whole >= floor + 1e-9))
    best = able[np.argsort(-whole[able])][:k]
    assert set(best) <= set(found.tolist()) and opened <= 5 and np.allclose(score, whole[found])


def test_empty_corpus_and_queries(spark, tmp_path):
    d = spark.createDataFrame([], "k string, t string")
    index = blockmax.stored(d, "k", "t", f"file://{tmp_path}/i")
    q = bm25.query_terms(spark.createDataFrame([("q", "cat")], "query string, text string"), "query", "text")
    assert index.n == 0 and blockmax.best(index, q).count() == 0


def test_blocks_are_written_anew_for_other_texts(spark, tmp_path):
    docs = spark.createDataFrame([("a", "cat dog"), ("b", None), ("c", "cat cat")], "k string, t string")
    path = f"file://{tmp_path}/i"
    index = blockmax.stored(docs, "k", "t", path)
    assert (index.n, index.ranges, index.avgdl) == (3, 1, 4 / 3)
    assert sorted(map(tuple, index.members.select("key", "dl").collect())) == [("a", 2), ("b", 0), ("c", 2)]
    files = sorted(tmp_path.rglob("*.parquet"))
    blockmax.stored(docs, "k", "t", path)
    assert sorted(tmp_path.rglob("*.parquet")) == files
    index = blockmax.stored(docs.withColumn("t", F.lit("owl")), "k", "t", path)
    assert [tuple(r) for r in index.terms.collect()] == [("owl", 3)]


def scored(spark, docs, terms):
    d = spark.createDataFrame(docs, "k string, t string")
    out = {}
    for r in bm25.score_index(bm25.postings(d, "k", "t"), bm25.doc_lengths(d, "k", "t"), terms, "k", "query").collect():
        out.setdefault(r.query, {})[r.k] = r.score
    return out


def agrees(spark, index, docs, terms, k=3):
    whole, got = scored(spark, docs, terms), {}
    for r in blockmax.best(index, terms, k).collect():
        got.setdefault(r.query, {})[r.key] = r.score
    assert set(got) == set(whole) and index.n == len(docs)
    for query, scores in whole.items():
        same(got[query], scores, k)


def test_an_index_grows_by_turns(spark, tmp_path):
    """New, edited, deleted and returning documents: each turn's answers are those of an index made anew."""
    docs, queries = corpus(500, 3)
    terms = bm25.query_terms(spark.createDataFrame(queries, "query string, text string"), "query", "text")
    path = f"file://{tmp_path}/i"
    text = dict(docs)
    store = lambda: blockmax.stored(spark.createDataFrame(sorted(text.items()), "k string, t string"), "k", "t", path, 64)
    index = store()
    agrees(spark, index, text.items(), terms)
    steps = [
        lambda: text.update({f"n{i}": docs[i][1] + " w7x w399x" for i in range(30)}),
        lambda: [text.pop(f"d{i:04}") for i in range(0, 120, 3)],
        lambda: text.update({f"d{i:04}": f"w{i}x w1x" for i in range(200, 290)} | {"d0001": None, "d0002": ""}),
        lambda: text.update({f"d{i:04}": docs[i][1] for i in range(0, 120, 3)}),
    ]
    for turn, step in enumerate(steps, 2):
        step()
        index = store()
        assert index.turns == turn
        agrees(spark, index, text.items(), terms)
    assert index.gone == 40 + 92 and store().turns == 5
    scope = spark.createDataFrame([("d0003",), ("d0200",)], "key string")
    assert {r.key for r in blockmax.best(index, terms, 3, scope).collect()} <= {"d0003", "d0200"}
    df = {r.term: r.df for r in index.terms.collect()}
    assert df == {r.term: r.df for r in bm25.postings(spark.createDataFrame(sorted(text.items()), "k string, t string"), "k", "t").groupBy("term").agg(F.count("*").alias("df")).collect()}


def test_a_turn_writes_what_has_changed(spark, tmp_path):
    docs, _ = corpus(4000, 4)
    path = f"file://{tmp_path}/i"
    blockmax.stored(spark.createDataFrame(docs, "k string, t string"), "k", "t", path)
    more = [(f"n{i}", docs[i][1]) for i in range(40)]
    index = blockmax.stored(spark.createDataFrame(docs + more, "k string, t string"), "k", "t", path)
    posted = lambda turn: spark.read.parquet(f"{path}/blocks/turn={turn}").agg(F.sum(F.size("places"))).first()[0]
    assert index.turns == 2 and 0 < posted(1) <= 0.02 * posted(0)
    assert spark.read.parquet(f"{path}/members/turn=1").count() == 40


def test_half_a_turn_does_not_count(spark, tmp_path):
    """A turn that ended before its members were written, with other documents gone than in the next attempt."""
    path, schema = f"file://{tmp_path}/i", "k string, t string"
    first = [(f"k{i}", f"cat w{i}") for i in range(8)]
    blockmax.stored(spark.createDataFrame(first, schema), "k", "t", path)
    blockmax.stored(spark.createDataFrame(first[1:] + [("new", "cat owl")], schema), "k", "t", path)
    (tmp_path / "i/members/turn=1/_SUCCESS").unlink()
    assert blockmax.read(spark, path).n == 8
    terms = bm25.query_terms(spark.createDataFrame([("q", "cat owl w0")], "query string, text string"), "query", "text")
    docs = first + [("other", "owl")]
    index = blockmax.stored(spark.createDataFrame(docs, schema), "k", "t", path)
    assert (index.turns, index.gone) == (2, 0)
    agrees(spark, index, docs, terms, 20)


def test_written_anew_when_most_is_gone_or_after_many_turns(spark, tmp_path, monkeypatch):
    path, schema = f"file://{tmp_path}/i", "k string, t string"
    docs = [(None, "cat")] + [(f"k{i}", "cat") for i in range(9)]
    store = lambda rows: blockmax.stored(spark.createDataFrame(rows, schema), "k", "t", path)
    assert store(docs).turns == 1 and store(docs).turns == 1  # a null key is a key
    index = store(docs[:6])
    assert (index.turns, index.gone, index.n) == (2, 4, 6)
    index = store(docs[:4])
    assert (index.turns, index.gone, index.n) == (1, 0, 4)
    assert store([]).n == 0 and store(docs).turns == 2
    monkeypatch.setattr(blockmax, "TURNS", 2)
    assert [store(docs + [("x", str(i))]).turns for i in range(3)] == [1, 2, 1]


def test_an_edited_text_is_not_fresh(spark, tmp_path):
    docs = spark.createDataFrame([("a", "cat"), ("b", None)], "round_file string, text string")
    bm25.write_index(docs, "round_file", "text", f"file://{tmp_path}/i")
    read = lambda d: bm25.read_index(spark, f"file://{tmp_path}/i", d)
    assert read(docs) is not None
    assert read(docs.withColumn("text", F.lit("dog"))) is None and read(docs.where("round_file = 'a'")) is None


def test_store_searches_by_blocks(spark):
    rounds = [(f"r{i}", f"question {i} about cats", "answer " + "cat " * i) for i in range(15)]
    df = spark.createDataFrame(rounds, "round_file string, userPrompt string, responseSequence string")
    have = set(df.columns)
    for f in ROUND.fields if hasattr(ROUND, "fields") else spark.createDataFrame([], ROUND).schema.fields:
        if f.name not in have:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    store = RetrievalStore(spark, df, spark.createDataFrame([], VECTOR_ROW))
    q = spark.createDataFrame([("q", "cat")], "query string, text string")
    whole = bm25.normalize(store.lexical(q), "query").collect()
    want = sorted(((-r.normalized, r.round_file) for r in whole if r.normalized >= 0.25))[:5]
    got = store.search("cat", mode="text-match").collect()
    assert [(r.round_file, round(r.score, 9)) for r in got] == [(f, round(-s, 9)) for s, f in want]
    assert [r.round_file for r in store.search("cat", mode="text-match", rounds=("r3",)).collect()] == ["r3"]
    assert math.isclose(got[0].score, -want[0][0])
