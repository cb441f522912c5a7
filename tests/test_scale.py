"""Chains by doubling, and counts of what came before, against plain versions."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import chain, evaluate

ROUNDS = "round_file string, parentId string, fault double"


def profile(rows, target):
    """The chain of `target` link by link."""
    of = {r: (p, f or 0.0) for r, p, f in rows}
    links, at = [], target
    while at in of and at not in links:
        links.append(at)
        at = of[at][0]
    clean, shares = 1.0, []
    for r in reversed(links):
        shares.append((clean * of[r][1], r))
        clean *= 1 - of[r][1]
    most = max(p for p, _ in shares)
    top = "outside_chain" if clean > most else next(r for p, r in shares if p == most)
    terms = [p for p, _ in shares] + [clean]
    return len(links), clean, -sum(p * math.log(p) for p in terms if p > 0), top, shares[-1][0]


def check(spark, rows, targets):
    got = {r.target: r for r in chain.origin_profiles(spark.createDataFrame([(t,) for t in targets], "target string"), spark.createDataFrame(rows, ROUNDS)).collect()}
    stored = {r[0] for r in rows}
    assert set(got) == {t for t in targets if t in stored}
    for t, r in got.items():
        n, outside, entropy, top, last = profile(rows, t)
        assert (r.length, r.top) == (n, top)
        assert (r.p_outside, r.entropy, r.p_last) == pytest.approx((outside, entropy, last), abs=1e-9)


def test_profiles_of_trees(spark):
    """Forks, a hot parent, missing and empty parents, sure and impossible faults, targets that repeat or aren't stored."""
    r = random.Random(2)
    rows = [("root", None, 0.2), ("lost", "gone", 0.5), ("blank", "", None), ("sure", "root", 1.0), ("after", "sure", 0.4), ("none", "after", 0.0)]
    names = [x[0] for x in rows]
    for i in range(300):
        rows.append((f"r{i}", r.choice(["root", *names[-3:]]), r.choice([0.0, 0.1, 0.5, r.random()])))
        names.append(f"r{i}")
    check(spark, rows, [*names, "root", "nowhere"])


def test_profiles_where_parents_run_in_a_circle(spark):
    rows = [("a", "b", 0.1), ("b", "c", 0.2), ("c", "a", 0.3), ("into", "b", 0.4), ("own", "own", 0.5), ("free", None, 0.6), ("leaf", "free", 0.7)]
    check(spark, rows, [r[0] for r in rows])


def test_a_chain_of_100_000_links(spark):
    n = 100_000
    i = F.col("id")
    rows = spark.range(n).select(i.cast("string").alias("round_file"), F.when(i > 0, (i - 1).cast("string")).alias("parentId"), F.when(i == 70_000, 0.9).otherwise(1e-5).alias("fault"))
    got = chain.origin_profiles(spark.createDataFrame([(str(n - 1),), ("0",)], "target string"), rows).orderBy("length").collect()
    assert [x.length for x in got] == [1, n] and got[1].top == "70000"
    assert got[1].p_outside == pytest.approx(0.1 * (1 - 1e-5) ** (n - 1), rel=1e-9)


def test_no_rounds_or_targets(spark):
    rows = spark.createDataFrame([("a", None, 0.5)], ROUNDS)
    t = spark.createDataFrame([], "target string")
    assert chain.origin_profiles(t, rows).count() == 0
    assert chain.origin_profiles(spark.createDataFrame([("a",)], "target string"), rows.limit(0)).count() == 0


def test_earlier_counts(spark):
    """A hot key, equal times, null keys and times; other columns stay."""
    r = random.Random(3)
    rows = [(i, r.choice(["hot"] * 8 + ["b", None]), r.choice([None, *range(40)]) if i % 3 else r.random() * 40) for i in range(3000)]
    rows = [(i, g, None if t is None else float(t)) for i, g, t in rows]
    got = {x.id: x.n for x in evaluate.earlier_counts(spark.createDataFrame(rows, "id int, user string, ts double"), "user").collect()}
    at = Counter((g, t) for _, g, t in rows if t is not None)
    assert got == {i: None if t is None else sum(c for (h, u), c in at.items() if h == g and u < t) for i, g, t in rows}
    assert evaluate.earlier_counts(spark.createDataFrame([], "id int, user string, ts double"), "user").count() == 0


@pytest.mark.parametrize("turn, k", [(2048, 3), (2, 1), (2048, 500)])
def test_rank_as_of(spark, monkeypatch, turn, k):
    """Ties, several rows of a round over several batches, other sizes, nulls, equal times, the query among the rounds."""
    monkeypatch.setattr(evaluate, "TURN", turn)
    r = random.Random(4)
    vector = lambda: [r.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]
    rounds = [(f"r{i}", None if i % 17 == 0 else i // 2) for i in range(120)]
    rows = [(f"r{i}", vector()) for i in range(120) for _ in range(i % 3)] + [("r5", [1.0, 2.0]), ("r6", None), ("r7", [None, 1.0, 1.0, 1.0]), ("gone", vector()), ("r8", [])]
    queries = [(f"r{i}", i // 2, vector()) for i in range(0, 120, 9)] + [("new", 1000, vector()), ("short", 50, [1.0, 1.0]), ("blank", 50, None), ("never", None, vector())]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = evaluate.rank_as_of(
            spark.createDataFrame(queries, "query string, ts int, vector array<double>"), spark.createDataFrame(rows, "round_file string, vector array<double>"), spark.createDataFrame(rounds, "round_file string, ts int"), k
        ).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    times, want = dict(rounds), []
    for q, ts, v in queries:
        best = {}
        for f, x in rows:
            at = times.get(f)
            if v and x and None not in x and len(x) == len(v) and at is not None and ts is not None and at < ts and f != q:
                best[f] = max(best.get(f, -math.inf), sum(a * b for a, b in zip(v, x)))
        want += [(q, f, s, n) for n, (f, s) in enumerate(sorted(best.items(), key=lambda z: (-z[1], z[0]))[:k], 1)]
    assert sorted((x.query, x.round_file, x.score, x["rank"]) for x in got) == sorted(want)
