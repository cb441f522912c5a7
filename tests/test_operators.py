import json
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.operators import bm25, chain, context, details, evaluate, golden, grouping, maintain, memory, search, sessions, toolsearch
from palimpsest.operators.search import SearchParams


def test_normalized_by_the_median(spark):
    s = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 2.0), ("q", "c", 4.0)], "query string, round_file string, score double")
    got = {r.round_file: r.normalized for r in bm25.normalize(s, "query").collect()}
    sigma = lambda x: 1 / (1 + 2.718281828459045**-x)
    assert got == pytest.approx({"a": sigma(0.5), "b": sigma(1), "c": sigma(2)})


def test_bm25_counts_empty_documents(spark):
    d = spark.createDataFrame([("a", "cat dog"), ("b", ""), ("c", "cat")], "k string, t string")
    q = spark.createDataFrame([("q", "cats")], "query string, text string")
    got = bm25.score(d, "k", "t", q, "query", "text").collect()
    stored = bm25.score_index(bm25.postings(d, "k", "t"), bm25.doc_lengths(d, "k", "t"), bm25.query_terms(q, "query", "text"), "k", "query").collect()
    assert {r.k for r in got} == {"a", "c"} and bm25.corpus_stats(bm25.doc_lengths(d, "k", "t")).first().n == 3
    assert sorted((r.k, round(r.score, 9)) for r in got) == sorted((r.k, round(r.score, 9)) for r in stored)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "round_file string, suffix string, model string, vector array<double>")


def test_models_and_fallback(spark):
    v = vectors(spark, [("a", ":prompt", None, [1.0, 0.0]), ("a", ":response", "m", [0.0, 1.0]), ("b", ":prompt", "x", [1.0, 0.0])])
    q = spark.createDataFrame([("q", "base", [0.6, 0.8]), ("q", "m", [0.0, 0.5])], "query string, model string, vector array<double>")
    assert [(r.round_file, r.score) for r in search.similarity(v, q, "base").collect()] == [("a", 0.6)]


def test_lexical_hit_can_win_and_none_leaves_semantic(spark):
    v = vectors(spark, [("a", ":prompt", None, [0.9, 0.0]), ("b", ":prompt", None, [0.6, 0.0])])
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query string, vector array<double>")
    lex = spark.createDataFrame([("q", "b", 1.0)], "query string, round_file string, normalized double")
    top = lambda x: [r.round_file for r in search.top(x, 5).orderBy("rank").collect()]
    assert top(search.similarity(v, q, lexical=lex, alpha=0.5)) == ["b", "a"]
    assert top(search.similarity(v, q, lexical=lex.limit(0), alpha=0.0)) == ["a", "b"]


def test_other_dimensions_drop_out(spark):
    v = vectors(spark, [("a", ":prompt", None, [1.0, 0.0, 0.0])])
    assert search.similarity(v, spark.createDataFrame([("q", [1.0])], "query string, vector array<double>")).count() == 0


def test_params():
    assert SearchParams(alpha=7, mode="nonsense", query="").alpha == 1.0 and SearchParams(mode="nonsense").mode == "similarity"


def test_selection_stops_at_the_first_that_does_not_fit(spark):
    r = spark.createDataFrame([("q", i, 1 - i / 10, c) for i, c in enumerate([3, 5, 9, 1], 1)], "query string, rank int, score double, c int")
    got = search.select_in_budget(r, F.col("c"), F.lit(10)).orderBy("rank").collect()
    assert [x["rank"] for x in got] == [1, 2]


def test_newest_is_always_kept(spark):
    c = spark.createDataFrame([("s", 1, "x", 50), ("s", 2, "y", 500)], "session string, pos int, topic string, c int")
    got = search.select_recent(c, F.col("c"), F.lit(1), budget=10).collect()
    assert [(x["pos"], x["index"], x["group_no"]) for x in got] == [(2, 1, 1)]


def test_tool_coverage(spark):
    rows = spark.createDataFrame([("a", 0, "t", "foo bar"), ("b", 0, "t", "foo"), ("b", 1, "t", "foo")], "round_file string, tool_index int, tool_name string, searchable string")
    q = spark.createDataFrame([("q", "foo BAR"), ("twice", "foo foo"), ("none", " ")], "query string, text string")
    got = {(r.query, r.round_file): (r.score, len(r.tools)) for r in toolsearch.search_tools(rows, q).collect()}
    assert got == {("q", "a"): (1.0, 1), ("q", "b"): (0.5, 2), ("twice", "a"): (0.5, 1), ("twice", "b"): (0.5, 2)}


def test_metrics(spark):
    labels = spark.createDataFrame([("q", "a"), ("q", "b"), ("late", "c")], "query string, label string")
    ranked = spark.createDataFrame([("q", "a", 2), ("q", "b", 5), ("late", "c", 6)], "query string, round_file string, rank int")
    got = {r.query: (r.hit, r.recall, r.mrr, r.first_hit_rank) for r in evaluate.query_metrics(labels, ranked).collect()}
    assert got == {"q": (1, 1.0, 0.5, 2), "late": (0, 0.0, pytest.approx(1 / 6), 6)}
    queries = spark.createDataFrame([("q",), ("late",), ("blank",)], "query string")
    m = evaluate.macro_mean(evaluate.query_metrics(labels, ranked), queries).first()
    assert (m.query_count, m.empty_label_count, m.hit_at_5) == (2, 1, 0.5)


def test_as_of_is_strict(spark):
    r = spark.createDataFrame([("q", 5), ("same", 5), ("old", 4), ("blank", None)], "round_file string, ts long")
    q = spark.createDataFrame([("q", 5)], "query string, ts long")
    assert [x.round_file for x in evaluate.candidates_as_of(q, r).collect()] == ["old"]
    assert evaluate.excluded_without_time(r, q).first().excluded == 1


def test_noise(spark):
    p = spark.createDataFrame([(4, 2), (2, 0)], "presentedCount long, readCount long")
    assert evaluate.noise_rate(p).first()[0] == pytest.approx(2 / 3)
    assert evaluate.noise_rate(p.limit(0)).first()[0] is None


def test_topics():
    t = grouping.Topics(0.77)
    assert [t.assign(v) for v in ([1.0, 0.0], [0.0, 1.0], [0.9, 0.1], None, [0.95, 0.05])] == [0, 1, 0, 2, 0]
    before = t.centroids[1].copy()
    assert t.assign(None, forced=1) == 1 and (t.centroids[1] == before).all()
    assert t.assign([1.0, 0.0], forced=9) == 0


def one_topic_at_a_time(rounds, threshold=0.77):
    """(session, pos, topic) by the definition: lists of centroids, one product after the other."""
    out, state = [], {}
    for session, pos, vector, forced in sorted(rounds, key=lambda r: (str(r[0]), r[1])):
        topics = state.setdefault(session, [])
        at = forced if forced is not None and 0 <= forced < len(topics) else None
        if at is None and vector is not None:
            near = [(sum(a * b for a, b in zip(c, vector)) if len(c) == len(vector) else -1.0, -i) for i, (c, _) in enumerate(topics)]
            best = max([x for x in near if x[0] >= threshold], default=None)
            at = -best[1] if best else None
        if at is None:
            topics.append((list(vector or []), 1))
            at = len(topics) - 1
        else:
            c, n = topics[at]
            topics[at] = ([x + (y - x) / (n + 1) for x, y in zip(c, vector)] if len(vector or []) == len(c) else c, n + 1)
        out.append((session, pos, at))
    return sorted(out, key=str)


def test_topics_as_rounds_pass_by(spark):
    """Sessions that end within batches and batches that end within sessions, odd rounds among them."""
    r = random.Random(5)
    angle = lambda: r.choice([0.1, 1.2, 2.3, 4.0]) + r.gauss(0, 0.2)
    rounds = []
    for session in ["a", "b", "long", None, ""]:
        for pos in range(400 if session == "long" else 23):
            x = angle()
            vector = r.choice([[math.cos(x), math.sin(x)]] * 8 + [None, [], [0.0, 0.0], [1.0, 0.0, 0.0]])
            rounds.append((session, pos, vector, r.choice([None] * 6 + [0, 2, 99, -1])))
    df = spark.createDataFrame(r.sample(rounds, len(rounds)), "session string, pos int, vector array<double>, forced int")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(map(tuple, grouping.topics(df).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == one_topic_at_a_time(rounds)
    assert grouping.topics(df.limit(0)).count() == 0


def test_topics_of_one_session_of_many_rounds(spark):
    """No frame or cell holds the session: its rounds come in batches, sorted before."""
    x = F.pmod(F.col("id"), F.lit(3))
    rounds = spark.range(300_000).select(F.lit("s").alias("session"), F.col("id").alias("pos"), F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: (x == i).cast("double")).alias("vector"), F.lit(None).cast("int").alias("forced"))
    df = grouping.topics(rounds)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "Window" not in plan
    assert {tuple(r) for r in df.groupBy("topic", (F.col("pos") % 3).alias("kind")).count().collect()} == {(i, i, 100_000) for i in range(3)}


def test_golden_selection_and_interleave(spark):
    got = golden.select_golden([(f"q{i}", ("miss", "hard", "control")[i % 3]) for i in range(30)], 10, 1)
    assert len(got) == len(set(got)) == 10
    ch = spark.createDataFrame([("q", 1, 1, "a"), ("q", 1, 2, "b"), ("q", 2, 1, "a"), ("q", 2, 2, "a"), ("q", 1, 3, "c")], "query string, channel int, rank int, round_file string")
    assert [r.round_file for r in golden.interleave(ch).orderBy("position").collect()] == ["a", "b", "c"]
    barren = spark.createDataFrame([("q", 1, 1, "a"), ("q", 1, 2, "a"), ("q", 1, 3, "c")], "query string, channel int, rank int, round_file string")
    assert [r.round_file for r in golden.interleave(barren).collect()] == ["a"]


def test_prunes(spark):
    r = spark.createDataFrame([("k", "live", False, 9), ("k", "rec1", True, 1), ("k", "rec2", True, 7), ("x", "single", True, 1)], "key string, filename string, recovered boolean, mtime long")
    got = maintain.duplicate_plan(r, 5).collect()
    assert [(x.keeper, x.filename) for x in got] == [("live", "rec2")]


def test_coverage(spark):
    long = " ".join(["w"] * 25)
    rounds = spark.createDataFrame([("a", long), ("b", "short"), ("c", long), ("d", long)], "round_file string, userPrompt string")
    v = spark.createDataFrame(
        [("a", ":prompt", "old"), ("a", ":prompt", None), ("a", ":response", "new"), ("b", ":prompt", "old"), ("b", ":response", "new"), ("c", ":prompt", "old"), ("c", ":summary", "new")],
        "round_file string, suffix string, model string",
    )
    got = {r.round_file: (r.has_row, r.has_stale, r.covered) for r in maintain.classify_rounds(rounds, v, "new").collect()}
    assert got == {"a": (True, True, True), "b": (True, False, True), "c": (True, True, False), "d": (False, False, False)}


def test_chain_stops_at_cycles_and_gaps(spark):
    r = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "gone")], "round_file string, parentId string")
    got = chain.walk_chain(spark.createDataFrame([("a",), ("c",)], "target string"), r).orderBy("target", "depth").collect()
    assert [(x.target, x.round_file, x.missing) for x in got] == [("a", "a", False), ("a", "b", False), ("c", "c", False), ("c", "gone", True)]


@pytest.mark.parametrize("depth", [None, 0])
def test_chain_reaches_the_root(spark, depth):
    line = [(str(i), str(i - 1) if i else "") for i in range(150)]
    knot = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("x", "gone")]
    r = spark.createDataFrame(line + knot, "round_file string, parentId string")
    ask = spark.createDataFrame([("149",), ("70",), ("0",), ("a",), ("x",), ("lost",)], "target string")
    got = {}
    for x in chain.walk_chain(ask, r, depth).orderBy("target", "depth").collect():
        got.setdefault(x.target, []).append((x.depth, x.round_file, x.missing))
    want = {str(n): [(d, str(n - d), False) for d in range(n + 1)] for n in (149, 70, 0)}
    want |= {"a": [(d, y, False) for d, y in enumerate("abcd")], "x": [(0, "x", False), (1, "gone", True)], "lost": [(0, "lost", True)]}
    assert got == want


def test_origin(spark):
    df = spark.createDataFrame([([0.5, 0.5],)], "f array<double>")
    assert df.select(chain.origin_posterior(F.col("f"))).first()[0] == [0.5, 0.25, 0.25]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=3), st.text(max_size=3)), max_size=20))
def test_memory_keeps_seven(items):
    m = memory.WorkingMemory()
    ids = [m.add(a, b) for a, b in items]
    assert sorted(m.slots) == ids[-7:]


def test_memory_operations():
    m = memory.WorkingMemory()
    i = m.add("s", "c", "r.json")
    assert str(m.get(i)) == "[id: 1] s\nSource round: r.json\n\nc"
    assert m.update(i, "t", "d").source_round == "r.json" and m.update(9, "", "") is None
    assert m.take(i).summary == "t" and m.take(i) is None and not m.delete(i)


def test_pages_and_matches(spark):
    df = spark.createDataFrame([("k", "one\ntwo\nthree\ntwo", "ask two")], "k string, t string, p string")
    p = details.page(df, "k", "t", 2, 2).first()
    assert (p.page, p.last_line, p.next_line) == ("two\nthree", 3, 4)
    assert details.page(df, "k", "t", 9, 2).first().page == "(empty)"
    m = details.match_lines(df, "k", "t", "^two", 1, 5).orderBy("match_no").collect()
    assert [(x.line_no, x.context) for x in m] == [(2, "two\nthree"), (4, "two")]
    u = details.match_lines(df, "k", "t", "two", 0, 5, prompt="p").collect()
    assert [(x.source, x.total) for x in u] == [("user", 3)]


def test_providers():
    r = context.Registry("app")
    P, E = context.Provider, context.Edge

    def bad(sections, tokens):
        raise ValueError("no")

    assert r.register(P("app.a", lambda s, t: "A", priority=2)) == "registered"
    assert r.register(P("app.b", bad, priority=1)) == "registered"
    assert r.register(P("app.c", lambda s, t: s["app.a"] + "c", depends_on=(E("app.a"),))) == "registered"
    assert r.register(P("app.d", lambda s, t: "D", depends_on=(E("app.b"),))) == "registered"
    assert r.register(P("app.e", lambda s, t: None, depends_on=(E("app.b", False), E("app.zz", False)))) == "registered"
    assert r.register(P("app.f", lambda s, t: "F", depends_on=(E("app.missing"),))) == "registered"
    assert r.register(P("app.a", lambda s, t: "")) == "duplicate-identity"
    assert r.register(P("nope", lambda s, t: "")) == "invalid-identity"
    assert r.register(P("app.v", lambda s, t: "", api_version=9)) == "unsupported-api-version"
    assert r.register(P("app.self", lambda s, t: "", depends_on=(E("app.self"),))) == "circular-dependency"
    out = r.render()
    assert out.sections == {"app.a": "A", "app.c": "Ac"}
    assert {i: s for i, s, _ in out.outcomes} == {"app.a": "rendered", "app.b": "dropped", "app.c": "rendered", "app.d": "skipped-dependency", "app.e": "empty", "app.f": "skipped-dependency"}
    assert [m["content"][0]["text"] for m in context.assemble({"relevance": "r", "architecture": "a"})] == ["a", "r"]


def log(*entries):
    return "\n".join(e if isinstance(e, str) else json.dumps(e) for e in entries)


def test_host_log(spark):
    text = lambda t: [{"type": "text", "text": t}]
    content = log(
        {"type": "message", "id": "0", "message": {"role": "assistant", "content": text("before")}},
        {"type": "message", "id": "1", "message": {"role": "user", "timestamp": 10, "content": text(" ask ")}},
        "{broken",
        {"type": "message", "message": {"role": "assistant", "content": [*text("hm"), {"type": "toolCall", "id": "x", "name": "Read", "arguments": {"p": 1}}, {"type": "toolCall", "id": "y", "name": "Bash"}]}},
        {"type": "message", "message": {"role": "toolResult", "toolCallId": "x", "toolName": "Read", "content": text("r" * 400)}},
        {"type": "message", "message": {"role": "toolResult", "content": text("late")}},
        {"type": "message", "message": {"role": "assistant", "content": text("done\nround_needs_followup")}},
        {"type": "message", "id": "2", "message": {"role": "user", "timestamp": 20, "content": text("next")}},
    )
    got = sessions.parse_logs(spark.createDataFrame([("s", content)], "path string, content string"), now=99).orderBy("turnIndex").collect()
    a, b = got
    assert (a.id, a.userPrompt, a.responseSequence, a.needsFollowup, a.responseEndTimestamp) == ("1", "ask", "hm\n\ndone", True, 20)
    assert [(c["name"], len(c["result_summary"]), len(c["result_full"])) for c in a.toolCalls] == [("Read", 300, 400), ("Bash", 4, 4)]
    assert a.toolCallNames == ["Read", "Bash"] and a.toolCalls[0]["arguments"] == '{"p":1}'
    assert (b.userPrompt, b.responseSequence, b.responseEndTimestamp) == ("next", "", 99)


def test_import_log(spark):
    answer = "a long enough answer here"
    good = log(
        {"type": "user", "timestamp": "2024-01-01T00:00:00Z", "sessionId": "s", "message": {"content": "ask"}},
        {"type": "assistant", "isSidechain": True, "message": {"content": [{"type": "text", "text": "side"}]}},
        {"type": "assistant", "timestamp": "2024-01-01T00:00:05Z", "message": {"content": [{"type": "text", "text": answer}, {"type": "tool_use", "id": "t", "name": "Read", "input": {}}]}},
        {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "t", "content": "out"}]}},
        {"type": "user", "timestamp": "x", "message": {"content": "no answer"}},
    )
    got = sessions.parse_logs(spark.createDataFrame([("good", good), ("bad", "{}\n{x")], "path string, content string"), "import").orderBy("session").collect()
    assert got[0].error.startswith("line 2") and got[0].round_file is None and len(got) == 2
    assert (got[1].userPrompt, got[1].responseSequence, got[1].toolCalls[0]["result_summary"], got[1].responseEndTimestamp - got[1].userTimestamp) == ("ask", answer, "out", 5000)


def test_stream_equals_batch(spark, tmp_path):
    from palimpsest.streaming.rounds import store_stream, stream_rounds, stream_topics

    rows = [(s, p, ("user", "assistant", "system")[(s * 7 + p * p) % 3], f"text {s} {p}") for s in range(5) for p in range(12)]
    m = spark.createDataFrame(rows, "session long, pos long, role string, text string")
    for i in range(3):
        m.where(f"pos div 4 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store_stream(stream_rounds(src), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    cols = ["session", "turn_index", "round_file", "n_messages"]
    want = sessions.rounds_of(m, "session", "pos").where("responseEndTimestamp is not null").select(*cols)
    got = spark.read.parquet(str(tmp_path / "out")).select(*cols)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 5
    v = spark.createDataFrame([(s, p, [float((s + p) % 3 == 0), float((s + p) % 3 == 1)]) for s in range(3) for p in range(8)], "session long, pos long, vector array<double>")
    v.coalesce(1).write.parquet(str(tmp_path / "v"))
    q = stream_topics(spark.readStream.schema(v.schema).parquet(str(tmp_path / "v"))).writeStream.format("memory").queryName("topics_out").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = grouping.topics(v.withColumn("forced", F.lit(None).cast("int")))
    assert sorted(map(tuple, spark.table("topics_out").collect())) == sorted(map(tuple, batch.collect()))


def test_worksheet():
    pool = [{"query": f"q{i}.json", "prompt": "a\nb", "difficulty": "hard", "candidates": [{"file": f"{c}.json", "excerpt": "e"} for c in "xyz"]} for i in range(2)]
    sheet = golden.render_worksheet(pool)
    assert {k: v[0] for k, v in golden.parse_worksheet(sheet).items()} == {"q0.json": [], "q1.json": []}
    ticked = sheet.replace("- [ ] x.json", "- [x] x.json", 1).replace("- [ ] y.json", "- [ ] y.json (primary)", 1).replace("- [ ] z.json", "- [?] z.json", 1)
    labels, primary, warnings = golden.parse_worksheet(ticked)["q0.json"]
    assert (labels, primary, len(warnings)) == (["x.json", "y.json"], "y.json", 2)
    with pytest.raises(ValueError):
        golden.parse_worksheet(ticked.replace("- [x] x.json", "- [x] x.json (primary)"))


def test_labels_outside_the_pool(spark):
    pool = spark.createDataFrame([("q", "a")], "query string, round_file string")
    assert [r.label for r in golden.check_labels(spark.createDataFrame([("q", "a"), ("q", "b")], "query string, label string"), pool).collect()] == ["b"]


def test_backlog(spark):
    schema = "script string, shard string, n_rows long, rounds array<string>, recorded_at string"
    b = spark.createDataFrame([("s", "old", 1, ["a"], "t0"), ("other", "x", 1, [], "t0")], schema)
    b = maintain.record_backlog(b, "s", spark.createDataFrame([("new", 2, ["b"])], "shard string, n_rows long, rounds array<string>"), "t1")
    assert sorted((r.script, r.shard) for r in b.collect()) == [("other", "x"), ("s", "new")]
    assert [r.shard for r in maintain.clear_backlog(b, "s", ["new"]).collect()] == ["x"]


def test_reads_meet_what_was_presented(spark):
    chains = [("s", 1, i, f"r{i}") for i in range(7)] + [("s", 2, 0, "r6"), ("s", 2, 1, ""), ("t", 1, 0, "r6")]
    shown = evaluate.presented(spark.createDataFrame(chains, "session string, shown int, pos int, round_file string"))
    reads = [("s", 1, "r6"), ("s", 1, "r6"), ("s", 1, "r0"), ("s", 2, "r6"), ("t", 1, "r5"), ("t", 1, None)]
    got = evaluate.read_positions(shown, spark.createDataFrame(reads, "session string, shown int, hash string")).orderBy("position").collect()
    assert [tuple(r) for r in got] == [(1, 2, 2), (2, 2, 1), (3, 1, 0), (4, 1, 0), (5, 1, 0)]


def test_indexed_rounds_count_once(spark):
    keys = spark.createDataFrame([("a.json:prompt",), ("a.json:response",), ("b.json:prompt",)], "key string")
    assert evaluate.indexed_rounds(keys).first()[0] == 2
