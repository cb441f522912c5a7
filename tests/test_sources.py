import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.plans.store import RetrievalStore
from palimpsest.sources import embed, logs, rounds, shards
from palimpsest.sources.schemas import ROUND, VECTOR_ROW


def test_round_folder(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"userPrompt": "p", "responseSequence": "r", "turnIndex": 0}, indent=1))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "index.bm25.json").write_text("{}")
    got = rounds.read_rounds(spark, str(tmp_path)).select("round_file", "userPrompt").collect()
    assert [tuple(r) for r in got] == [("a.json", "p")]


def test_shards(spark, tmp_path):
    enc = lambda v: __import__("base64").urlsafe_b64encode(json.dumps(v).encode()).decode().rstrip("=")
    stamp = "A" * 43
    (tmp_path / "index.csv").write_text(f"{enc([1.0])},a.json:prompt\n\n!!!,b.json:prompt,m\n")
    (tmp_path / "index.host-b").write_text(f"{enc([2.0])},a.json:prompt\n{enc([3.0])},a.json:prompt,m,{stamp}\n")
    (tmp_path / "index.host-b.lock").write_text("x")
    (tmp_path / "index.bm25.json").write_text("{}")
    got = shards.read_index(spark, str(tmp_path)).orderBy("vector").collect()
    assert [(r.round_file, r.suffix, r.model, r.input_hash, r.vector) for r in got] == [("a.json", ":prompt", None, None, [1.0]), ("a.json", ":prompt", "m", stamp, [3.0])]
    assert shards.count_lines(spark, str(tmp_path)) == 4
    lines = shards.parse_lines(shards.shard_lines(spark, str(tmp_path)))
    assert shards.without_files(lines, spark.createDataFrame([("a.json",)], "round_file string")).count() == 1


def test_own_shard_is_replaced_alone(spark, tmp_path):
    rows = spark.createDataFrame([("a", "h1"), ("b", "h2")], "round_file string, shard string")
    shards.write_shards(rows, str(tmp_path / "t"))
    shards.write_shards(spark.createDataFrame([("c", "h1")], "round_file string, shard string"), str(tmp_path / "t"))
    assert sorted(r.round_file for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["b", "c"]


def test_logs_and_tool_lines(spark, tmp_path):
    (tmp_path / "--x").mkdir()
    (tmp_path / "--x" / "s.jsonl").write_text('{"message": {"role": "assistant", "stopReason": "toolUse"}}\n')
    got = logs.read_logs(spark, str(tmp_path))
    assert got.count() == 1 and not got.select(logs.tail_is_closed(F.col("content"))).first()[0]
    t = spark.createDataFrame([("a.json,0,Read,x, y",), ("bad",), ("a,b,c,d",)], "value string")
    assert [tuple(r) for r in logs.parse_tool_lines(t).collect()] == [("a.json", 0, "Read", "x, y")]
    assert logs.format_tool_lines(logs.parse_tool_lines(t)).first()[0] == "a.json,0,Read,x, y"


def test_stats(spark):
    t = spark.createDataFrame([('{"version": 1, "position5": {"presentedCount": 3, "readCount": 1}}',), ("{",)], "value string")
    got = [r.positionScores for r in rounds.read_stats(t).collect()]
    assert got[0][4]["presentedCount"] == 3 and [len(x) for x in got] == [5, 5]


def test_append_is_idempotent(spark, tmp_path):
    r = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "round_file string, t string")
    path = str(tmp_path / "r")
    rounds.append_new(r, r.limit(0), path)
    rounds.append_new(r, spark.createDataFrame(spark.read.parquet(path).collect(), r.schema), path)
    assert spark.read.parquet(path).count() == 2


def test_retries():
    calls, waits = [], []

    def flaky(texts, model):
        calls.append(1)
        if len(calls) < 3:
            raise embed.Transient
        return [[1.0]]

    assert embed.with_retries(flaky, sleep=waits.append)(["a"], "m") == [[1.0]] and waits == [1.0, 2.0]


def store(spark):
    texts = [("a.json", "fix the parser bug in lexer " * 6, "done parser"), ("b.json", "bake a cake with flour " * 6, "cake"), ("c.json", "short", "parser answer text")]
    calls = [(0, None, "Read", '{"path": "src/lexer.ts"}', "x", "x", False)]
    rows = [(None, p, r, i, i, 1, ["Read"], calls, None, None, None, None, False, None, None, f) for i, (f, p, r) in enumerate(texts)]
    data = spark.createDataFrame(rows, T.StructType([*ROUND.fields, T.StructField("round_file", T.StringType())]))
    s = RetrievalStore(spark, data, spark.createDataFrame([], VECTOR_ROW), "stub")
    parsed = data.withColumn("error", F.lit(None).cast("string"))
    new, rows = RetrievalStore(spark, data.limit(0), s.vectors, "stub").ingest(parsed)
    assert new.count() == 3
    return RetrievalStore(spark, data, rows.where("suffix <> ':combined'"), "stub")


def test_store_modes(spark):
    s = store(spark)
    first = lambda **k: [r.round_file for r in s.search("parser bug lexer", **k).collect()]
    assert first(mode="text-match")[0] == "a.json"
    assert first(mode="hybrid", threshold=-1.0)[0] == "a.json"
    assert first(mode="similarity", threshold=-1.0)
    assert set(first(mode="tool")) == {"a.json", "b.json", "c.json"}
    assert first(mode="text-match", rounds=("c.json",)) == ["c.json"]
    assert s.search("", mode="text-match").count() == 0
    q = spark.createDataFrame([("q", "parser bug lexer")], "query string, text string")
    assert s.context(q).count() >= 1
