import math

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import envelope, leaves, noise, prng
from palimpsest.functions import text as X


def one(spark, value, *cols):
    return tuple(spark.createDataFrame([(value,)], "t string").select(*cols).first())


@pytest.mark.parametrize("text, tokens", [("queries", ["query"]), ("", []), ("é", []), ("a: B", ["a:", "a", "b"])])
def test_tokens(spark, text, tokens):
    assert one(spark, text, X.bm25_tokens("t"))[0] == tokens


def test_compound_tokens(spark):
    assert one(spark, "src/index.ts", X.bm25_tokens("t"))[0] == ["src/index.t", "src", "index", "ts"]


@pytest.mark.parametrize("word, stem", [("walking", "walk"), ("going", "going"), ("used", "used"), ("tested", "test"), ("flies", "fly"), ("boxes", "box"), ("cats", "cat"), ("gas", "gas")])
def test_stem(spark, word, stem):
    assert one(spark, word, X.stem("t"))[0] == stem


def test_golden_tokens(spark):
    assert one(spark, "fooBar_baz-Qux9", X.golden_tokens("t"))[0] == ["foo", "bar", "baz", "qux9"]


def test_followup_mark_needs_its_line(spark):
    assert one(spark, "done \nround_needs_followup", X.strip_followup("t"), X.needs_followup("t")) == ("done", True)
    assert one(spark, "round_needs_followup", X.strip_followup("t"), X.needs_followup("t")) == ("round_needs_followup", False)


def test_truncated_prompt_keeps_lines(spark):
    text = "first line\n" + "x" * 600 + "\nlast line"
    got = one(spark, text, X.truncate_prompt("t"))[0]
    assert got.startswith("first line\n… [") and got.endswith("…\nlast line")
    assert one(spark, "short", X.truncate_prompt("t"))[0] == "short"


def test_hash_has_no_separators(spark):
    import hashlib

    df = spark.createDataFrame([("ab", "c")], "p string, r string")
    assert df.select(X.content_hash("p", "r")).first()[0] == hashlib.md5(b"abc").hexdigest()


def test_response_input_cuts_at_characters(spark):
    for n in range(9, 14):
        got = one(spark, "ééé€€", X.response_input("t", n))[0]
        assert "ééé€€".startswith(got) and len(got.encode()) <= n
    assert one(spark, "[Tool call REDACTED: x]\nok", X.response_input("t"))[0] == "ok"


def test_keys(spark):
    assert one(spark, "dir/abc.json:prompt", *X.key_parts("t")) == ("abc.json", ":prompt")
    assert one(spark, "abc.json", *X.key_parts("t")) == ("abc.json", None)


def test_expanded_round(spark):
    assert [one(spark, a, X.expanded_round("t"))[0] for a in ('["a.json"]', '{"round": "b.json"}', "[5]", "{", "{}")] == ["a.json", "b.json", None, None, None]


def test_noise():
    assert noise.repeats("p" * 201) == "[REPEAT: 'p' × 201]" and noise.repeats("p" * 200) == "p" * 200
    assert noise.long_tokens("ab" * 101) == "[LONG_TOKEN: ~202 chars]"
    dump = '{"a": "' + "x" * 700 + '"}'
    assert noise.json_dumps(f"see {dump} end") == f"see [JSON_DUMP: ~{len(dump)} chars] end"
    body = "\n".join(f"line {i}" for i in range(200)) + "\n"
    assert noise.fences(f"```py\n{body}```") == f'[CODE_BLOCK: ~{len(body)} chars, py, first line: "line 0", last line: "line 199"]'
    assert noise.clean("[" * 50_000).startswith("[REPEAT: '[' × 50000]")
    assert noise.clean("plain text") == "plain text"


def test_envelope():
    listed = '[{"role": "system", "content": "s"}, {"role": "user", "content": [{"type": "text", "text": " hi "}]}]'
    assert envelope.split_prompt(listed) == ("hi", True)
    assert envelope.split_prompt("words\n```json\n" + listed + "\n```") == (f"words\n[MESSAGE_ENVELOPE: ~{len(listed) + 1} chars]", True)
    assert envelope.split_prompt("```\n" + listed + "\n```") == ("hi", True)
    assert envelope.split_prompt('{"a": 1}') == ('{"a": 1}', False)


def test_leaves():
    assert leaves.searchable("Read", '{"path": "A/b", "n": 3, "more": [{"x": "Y\\n z"}]}') == "read a/b y z"
    assert leaves.searchable("Bash", "not json") == "bash not json"


def test_shuffle_is_a_permutation_and_stable():
    a = prng.shuffled(list(range(50)), 1)
    assert sorted(a) == list(range(50)) and a == prng.shuffled(list(range(50)), 1) != prng.shuffled(list(range(50)), 2)
    assert all(0 <= x < 1 for _, x in zip(range(100), prng.mulberry32(7)))


def test_sizes(spark):
    df = spark.createDataFrame([(500,), (2048,), (3 << 20,)], "n int").select(X.size_label("n"))
    assert [r[0] for r in df.collect()] == ["0.49KB", "2KB", "3MB"]


def test_checkpoint(spark):
    df = spark.sql("select named_struct('currentTask', 't', 'progressMade', array('a', 'b'), 'currentState', array(), 'nextSteps', array(), 'keyFindings', array('k')) s")
    assert df.select(X.checkpoint_text("s")).first()[0] == "Current Task: t\nProgress Made:\n- a\n- b\nKey Findings / Decisions:\n- k"


def test_budget_is_monotone(spark):
    from palimpsest.operators.search import context_budget, recency_budget

    got = [r[0] for r in spark.range(101).select(context_budget(F.col("id") / 100)).collect()]
    assert got == sorted(got) and got[0] == 2000 and got[100] == 10_240
    assert recency_budget(1000) == 2000 and not math.isnan(got[50])


def test_last_accepted_checkpoint(spark):
    from palimpsest.sources.schemas import TOOL_CALL, struct

    call = lambda n, a, r: (0, None, n, a, r, None, False)
    ok = '{"currentTask": "%s", "progressMade": ["p"]}'
    calls = [call("x_checkpoint", ok % "one", "Checkpoint recorded"), call("x_checkpoint", ok % "two", "Checkpoint recorded."), call("x_checkpoint", ok % "no", "rejected"), call("x_checkpoint", "{", "Checkpoint recorded")]
    from pyspark.sql import types as T

    got = spark.createDataFrame([(calls,), ([],)], struct(c=T.ArrayType(TOOL_CALL))).select(X.checkpoint_of_calls("c").alias("s")).collect()
    assert (got[0].s.currentTask, got[0].s.progressMade, got[0].s.nextSteps, got[1].s) == ("two", ["p"], [], None)


def test_signals(spark):
    assert [one(spark, t, X.has_signal("t"))[0] for t in ("a search_interactions b", "nothing")] == [True, False]
