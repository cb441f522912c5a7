"""Searches that send the best of a batch or a range, against tables of all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import words
from palimpsest.functions.text import bm25_tokens
from palimpsest.functions.words import term_counts
from palimpsest.operators import blockmax, bm25, chain, golden, nearest, search, toolsearch
from palimpsest.plans.queries import QUERIES
from tests.conftest import DATA

VECTORS = "round_file string, suffix string, model string, vector array<double>"


def made(spark, n=700):
    r = random.Random(4)
    v = lambda size=3: [round(r.uniform(-1, 1), 2) for _ in range(size)]
    rows = [(f"r{i // 2}", f":{i % 2}", r.choice([None, "a", "b"]), r.choice([v(), v(), [0.5, 0.5, 0.5], v(2), [1.0, None, 0.0], None])) for i in range(n)]
    return spark.createDataFrame(rows, VECTORS).repartition(3), spark.createDataFrame([(f"q{i}", m, v()) for i in range(9) for m in ("a", "b")], "query string, model string, vector array<double>")


def ranked(rows, k):
    return sorted(map(tuple, search.top(search.best_per_round(rows).withColumn("score", F.round("score", 6)), k).select("query", "rank", "round_file", "score").collect()))


def test_words_are_those_of_the_expression(spark):
    texts = ["", None, "Cats and dogs/running-fast v1.2:3 ...", "İstanbul K-boxes ΣΑΣ flies", "a./b classes ed ing bedding\u0000x", "-:/. _a_ __"]
    for t, want in spark.createDataFrame([(t,) for t in texts], "t string").select("t", bm25_tokens("t")).collect():
        got = term_counts(t)
        assert {w: want.count(w) for w in want} == got


def test_texts_of_a_range_are_inverted_together():
    texts = ["", None, " ", "Cats and dogs/running-fast v1.2:3 ...", "İstanbul K-boxes ΣΑΣ flies", "a./b classes ed ing bedding\u0000x", "-:/. _a_ __", "a\x1fb\x0bc\x85d ties tie sing using ings es s as ass ies", "cats"]
    for some in (texts, texts[:1], []):
        number, at, places, tf, lengths = words.invert(some)
        got = [{t: int(n) for t, i in number.items() for p, n in zip(places[at[i] : at[i + 1]], tf[at[i] : at[i + 1]]) if p == x} for x in range(len(some))]
        assert got == [words.term_counts(t) for t in some] and lengths.tolist() == [sum(words.term_counts(t).values()) for t in some]


@pytest.mark.parametrize("share", [0.0, 0.05, 2.0])
def test_common_and_rare_terms_of_many_queries_add_up_as_one_by_one(monkeypatch, share):
    monkeypatch.setattr(words, "SHARE", share)
    r = np.random.default_rng(1)
    has = r.random((30, 50)) < r.random((30, 1))
    at, places, gains = np.r_[0, np.cumsum(has.sum(1))], np.nonzero(has)[1], r.random(has.sum())
    asked = [r.permutation(40)[: r.integers(0, 40)] - 10 for _ in range(20)]  # blocks below 0 are elsewhere
    asked = [np.where(a < 0, -1, a) for a in asked]
    weights = r.random(30)
    begin, block = np.r_[0, np.cumsum([len(a) for a in asked])], np.concatenate(asked)
    s = words.RangeScores(at, places, gains, 50, (begin, block, np.where(block < 0, 9.0, weights[block])))
    got, n = s.of(3, 17)
    want = [words.whole_scores(at, places, gains, 50, a[a >= 0], weights[a[a >= 0]]) for a in asked[3:17]]
    assert np.allclose(got, want, rtol=1e-12) and n.tolist() == [(a >= 0).sum() for a in asked[3:17]]


def test_a_task_of_hybrid_search_sends_less_from_its_later_ranges():
    """Rounds of several ranges, the best first: what can't be among the k best of those seen stays where it is."""
    run = nearest._fused([("q", None, [1.0])], blockmax.Asked([], np.zeros(1, int), np.zeros(0, int), pa.array([], pa.string()), np.zeros(0)), {}, 1.0, 0.5, 2)
    none = pa.table({"range": pa.array([], pa.int64()), "term": pa.array([], pa.string()), "places": pa.array([], pa.list_(pa.int32())), "tf": pa.array([], pa.list_(pa.int32()))})
    rows = lambda i: pa.table({"range": [i] * 9, "place": [-1] * 9, "dl": [0] * 9, "round_file": [f"r{i}{j}" for j in range(9)], "model": pa.array([None] * 9, pa.string()), "vector": [[1.0 / (1 + i + j)] for j in range(9)]})
    assert [run(none, rows(i)).num_rows for i in (0, 1, 5)] == [2, 1, 0]


def test_ranges_are_wider_where_there_are_many(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blockmax, "RANGES", 4)
    for n, ranges in ((30, 4), (300, 10)):
        blockmax.write(spark.range(n).selectExpr("string(id) k", "'a b' t"), "k", "t", f"file://{tmp_path}/{n}", size=8)
        assert blockmax.read(spark, f"file://{tmp_path}/{n}").ranges == ranges


@pytest.mark.parametrize("k", [1, 7, 400])
def test_nearest_equals_all_pairs_and_sends_few(spark, monkeypatch, k):
    monkeypatch.setattr(nearest, "ROWS", 97)
    v, q = made(spark)
    rows = nearest.nearest(v, q, k, "a").cache()
    assert ranked(rows, k) == ranked(search.semantic_rows(v, q, "a").selectExpr("query", "round_file", "semantic score", "semantic", "0D lexical"), k)
    assert k > 1 or rows.count() < 0.2 * search.semantic_rows(v, q, "a").count()
    rows.unpersist()


def test_every_equals_all_pairs(spark):
    v, q = made(spark)
    x = lambda rows: sorted((r.query, r.round_file, round(r.score, 9)) for r in rows.collect())
    assert x(nearest.every(v, q, "a")) == x(search.similarity(v, q, "a"))
    assert x(nearest.every(v, q.where("model = 'a'").drop("model"))) == x(search.similarity(v, q.where("model = 'a'").drop("model")))


def test_equal_vectors_do_not_all_move(spark):
    v = spark.range(5000).selectExpr("concat('r', id) round_file", "array(1D, 0D) vector").coalesce(1)
    rows = nearest.nearest(v, spark.createDataFrame([("q", [1.0, 0.0])], "query string, vector array<double>"), 3)
    assert rows.count() <= 3 * 4 * 3
    assert [r[2] for r in ranked(rows, 3)] == ["r0", "r1", "r10"]


@pytest.mark.parametrize("scoped", [False, True])
def test_hybrid_equals_scoring_everything(spark, tmp_path, scoped):
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    docs = [(f"r{i}", " ".join(r.choices(words, [1 / (j + 1) for j in range(60)], k=r.choice([0, 4, 30])))) for i in range(300)]
    v, q = made(spark)
    v = v.union(spark.createDataFrame([("untold", ":0", "a", [0.9, 0.9, 0.9])], VECTORS))
    d = spark.createDataFrame(docs, "round_file string, text string")
    texts = [(f"q{i}", " ".join(r.choices(words, k=6 if i % 2 else 150))) for i in range(7)]
    terms = bm25.query_terms(spark.createDataFrame([*texts, ("q8", "nothing")], "query string, text string"), "query", "text")
    path = f"file://{tmp_path}/i"
    blockmax.write(d, "round_file", "text", path, size=16)
    index = blockmax.read(spark, path)
    scope = d.where("round_file like '%7%' or round_file like '%1%'").select(F.col("round_file").alias("key")) if scoped else None
    lexical = bm25.score_index(bm25.postings(d, "round_file", "text"), bm25.doc_lengths(d, "round_file", "text"), terms, "round_file", "query")
    assert {(x.query, x.key): round(x.score, 9) for x in blockmax.scores(index, terms).collect()} == {(x.query, x.round_file): round(x.score, 9) for x in lexical.collect()}
    if scoped:
        lexical = search.in_scope(lexical, scope.withColumnRenamed("key", "round_file"))
        v = search.in_scope(v, scope.withColumnRenamed("key", "round_file"))
    got = nearest.hybrid(index, v, q, terms, 6, 0.6, "a", scope).cache()
    want = search.fuse(search.semantic_rows(v, q, "a"), bm25.normalize(lexical, "query"), 0.6)
    assert ranked(got, 6) == ranked(want, 6)
    got.unpersist()


def test_keyword_channel_without_pairs(spark, monkeypatch):
    r = random.Random(6)
    words = [f"w{i}" for i in range(30)]
    t = spark.createDataFrame([(f"d{i}", " ".join(r.choices(words, k=r.choice([0, 5, 12])))) for i in range(500)] + [("null", None)], "round_file string, text string")
    q = spark.createDataFrame([(f"q{i}", " ".join(r.choices(words, k=6))) for i in range(6)] + [("none", "zzz"), ("blank", "")], "query string, prompt string")
    monkeypatch.setattr(bm25, "BATCH", 70)
    pairs = q.join(t).select("query", "round_file")
    x = lambda df: sorted(map(tuple, df.select("query", "rank", "round_file", "score").collect()))
    assert x(golden.keyword_channel(q, t)) == x(golden.keyword_channel(q, t, pairs))


def test_trees_are_split_and_links_never_join(spark, monkeypatch):
    monkeypatch.setattr(chain, "PAIRS", 40)
    monkeypatch.setattr(chain, "BUCKET", 20)
    r = random.Random(7)
    rows = [("root", None), ("lost", "gone"), ("blank", ""), ("a", "b"), ("b", "a"), ("into", "a"), ("own", "own")]
    for i in range(120):
        rows.append((f"x{i}", r.choice([x[0] for x in rows])))
    d = spark.createDataFrame(rows, "round_file string, parentId string")
    t = spark.createDataFrame([(x[0],) for x in rows] + [("x3",), ("nowhere",)], "target string")
    x = lambda df: sorted(map(tuple, df.select("target", "depth", "round_file", "missing").collect()))
    assert x(chain.walk_chain(t, d)) == x(chain._walk_to_root(t, d))
    some = t.where("target like '%1%'")
    assert x(chain.walk_chain(some, d)) == x(chain._walk_to_root(some, d))


def test_calls_that_read_alike_meet_keywords_once(spark):
    rows = spark.createDataFrame([("r", 0, "n", "alpha beta")] * 50 + [("r", 1, "m", "alpha")], "round_file string, tool_index int, tool_name string, searchable string")
    x = toolsearch.search_tools(rows, spark.createDataFrame([("q", "alpha beta none")], "query string, text string"))
    assert [(r.matched, r.total, [t.name for t in r.tools]) for r in x.collect()] == [(2, 3, ["n", "m"])]
    assert "Expand" not in x._jdf.queryExecution().optimizedPlan().toString()


def test_a_written_index_reads_as_its_postings(spark, tmp_path):
    d = spark.createDataFrame([("a", "cats cat dog"), ("b", None), ("c", "cat v1.2")], "k string, t string")
    bm25.write_index(d, "k", "t", f"file://{tmp_path}/i")
    index, lengths = bm25.read_index(spark, f"file://{tmp_path}/i", d, "k", "t")
    x = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    assert x(index, "k", "term", "tf") == x(bm25.postings(d, "k", "t"), "k", "term", "tf")
    assert x(lengths, "k", "dl") == x(bm25.doc_lengths(d, "k", "t"), "k", "dl")


def test_texts_of_the_relevance_list_are_looked_up_where_they_lie(spark):
    plan = QUERIES["context_select"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan and "rightHint=(strategy=broadcast)" in plan
