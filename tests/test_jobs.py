"""The jobs: results against SQL, growing input, repeated and failed runs, odd rows, the command line."""

import json
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import digest as D
from jobs import sweep as S
from jobs.queries import ORACLE, QUERIES
from palimpsest.operators import sessions
from tests.conftest import DATA
from tests.test_oracle import rows

ROOT = Path(__file__).parents[1]
LOGS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_job_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.execute(f"create view {f.removesuffix('.parquet')} as from '{DATA}/{f}'")
    df = QUERIES[name](spark, DATA)
    cur = db.execute(ORACLE[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in cur.description], cur.fetchall())


class Store:
    """A digest's folders, to which files are added."""

    def __init__(self, spark, path):
        self.spark, self.path, self.n = spark, f"file://{path}", 0
        spark.createDataFrame([], LOGS).write.parquet(f"{self.path}/in/empty")
        self.messages = []

    def add(self, messages, schema=LOGS):
        self.n += 1
        self.messages += messages
        self.spark.createDataFrame(messages, schema).coalesce(1).write.parquet(f"{self.path}/in/{self.n}")

    def run(self, **more):
        return D.digest(self.spark, f"{self.path}/in/*", f"{self.path}/store", f"{self.path}/checkpoint", buckets=4, **more)

    def rounds(self):
        r = self.spark.read.parquet(f"{self.path}/store/rounds").select("session", "turn_index", "round_file", "userPrompt", "responseSequence", "parentId", "outcome", "n_messages")
        return sorted(map(tuple, r.collect()))

    def want(self):
        """The rounds of all messages at once: of those at one position the first that came."""
        first = {}
        for c, t, *rest in self.messages:
            if c is not None and t is not None:
                first.setdefault((c, t), rest)
        df = self.spark.createDataFrame([(c, t, r or "", x) for (c, t), (r, x) in first.items()], LOGS)
        r = sessions.with_parent(sessions.rounds_of(df, "conv_id", "turn"))
        outcome = F.when(sessions.is_prompt_only(), "prompt-only").otherwise("stored").alias("outcome")
        return sorted(map(tuple, r.select("session", "turn_index", "round_file", "userPrompt", "responseSequence", "parentId", outcome, "n_messages").collect()))


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, tmp_path)


def talk(conv, turns, tag=""):
    return [(conv, t, "user" if t % 2 == 0 else "assistant", f"{tag}c{conv} t{t}") for t in turns]


def test_two_runs_over_growing_input(store):
    """The second run reads the new files alone; sessions that go on are made anew, late turns find their place."""
    store.add([m for c in range(20) for m in talk(c, range(4))] + talk(50, [4, 5]))
    assert store.run()["messages"] == 82 and store.rounds() == store.want()
    before = {r[0]: r for r in store.rounds()}
    store.add(talk(3, range(4, 7)) + talk(50, [0, 1, 2, 3]) + talk(99, range(2)))
    out = store.run()
    assert out["batches"] == 1 and out["messages"] == 9 and out["log"][0]["sessions"] == 3
    assert store.rounds() == store.want()
    got = [r for r in store.rounds() if r[0] == 3]
    assert [r[6] for r in got] == ["stored", "stored", "stored", "prompt-only"] and before[1] in store.rounds()


def test_a_run_without_new_files_changes_nothing(store):
    store.add(talk(1, range(6)) + talk(2, range(3)))
    store.run()
    folder = Path(store.path.removeprefix("file://")) / "store"
    files = {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}
    assert store.run() == {"batches": 0, "messages": 0, "rejected": 0, "log": []}
    assert {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")} == files


def test_files_in_several_batches_equal_one(store):
    for i in range(5):
        store.add([m for c in range(6) for m in talk(c, [2 * i, 2 * i + 1])])
    assert store.run(files_per_batch=2)["batches"] >= 3
    assert store.rounds() == store.want()


def test_messages_that_come_again_count_once(store):
    store.add(talk(1, range(4)))
    store.run()
    store.add(talk(1, range(4)) + talk(1, [2, 3], "other ") + talk(1, [4, 5]))
    store.run()
    assert store.rounds() == store.want()


@pytest.mark.parametrize("step", ["messages", "rounds", "log"])
def test_a_run_that_fails_at_any_step_is_made_good(store, monkeypatch, step):
    store.add(talk(1, range(4)) + talk(2, range(4)))
    store.run()
    store.add(talk(1, range(4, 8)) + talk(7, range(2)))
    real = D._write

    def fail(df, path, *by, **more):
        real(df, path, *by, **more)
        if path.endswith(step):
            raise RuntimeError("lost")

    monkeypatch.setattr(D, "_write", fail)
    with pytest.raises(Exception, match="lost"):
        store.run()
    monkeypatch.setattr(D, "_write", real)
    assert store.run()["messages"] == 6
    assert store.rounds() == store.want()
    log = store.spark.read.json(f"{store.path}/store/log")
    assert sorted(map(tuple, log.select("batch", "messages").collect())) == [(0, 8), (1, 6)]


def test_odd_messages(store):
    """Null roles and texts, rows that can't be placed, other columns, nothing but answers, an empty file."""
    odd = [(1, 0, None, "x"), (1, 1, "user", None), (1, 2, "assistant", None), (2, 5, "assistant", "late"), (None, 1, "user", "a"), (3, None, "user", "b"), (4, -3, "user", "é" * 200_000), (4, 0, "assistant", " ")]
    store.add([(*m, 1, "s") for m in odd], LOGS + ", bucket int, session string")
    store.messages = odd
    out = store.run()
    assert out["rejected"] == 2 and out["messages"] == 6 and store.rounds() == store.want()
    store.add([(None, 1, "user", "a")])
    assert store.run()["rejected"] == 1 and store.rounds() == store.want()


def sweep(spark, path, texts, vectors, **more):
    base = f"file://{path}"
    spark.createDataFrame(texts, "doc_id long, text string, source string, junk int").write.mode("overwrite").parquet(f"{base}/texts")
    spark.createDataFrame(vectors, "vec_id long, label long").write.mode("overwrite").parquet(f"{base}/vectors")
    out = S.sweep(spark, f"{base}/texts", f"{base}/vectors", f"{base}/out", **more)
    r, v = S.read_plans(spark, f"{base}/out")
    r, v = r.select("id", "action", "keeper", "rows").collect(), v.select("id", "suffix", "action").collect()
    return out, sorted(map(tuple, r), key=str), sorted(map(tuple, v), key=str)


LONG = " ".join(f"w{i}" for i in range(30))
TEXTS = [(1, LONG, "a", 0), (2, f"  {LONG}\n", None, 0), (3, LONG + " x", "a", 0), (4, None, "a", 0), (5, " \t", "b", 0), (6, "few words", "b", 0), (7, "one", "b", 0), (7, "two", "b", 0),
         (8, LONG + " y", "b", 0), (9, LONG + " z", "b", 0), (None, "stray", "c", 0), (None, "stray", "c", 0), (None, None, "c", 0), (10, LONG + " q", "a", 0), (10, LONG + " q", "a", 0)]
#: vec_id: 2 * id, one more for the response; label 1 is model m1, 2 another, 3 none.
VECTORS = [(2, 1), (3, 3), (4, 1), (6, 2), (7, 1), (12, 1), (13, 1), (16, 1), (17, 2), (17, 1), (40, 1), (None, 1)]
ROUNDS = [(1, "keep", None, 1), (10, "embed", None, 2), (2, "duplicate", 1, 1), (3, "reembed", None, 1), (4, "empty", None, 1), (5, "empty", None, 1), (6, "keep", None, 1), (7, "conflict", None, 2),
          (8, "keep", None, 1), (9, "embed", None, 1), (None, "nameless", None, 1), (None, "nameless", None, 2)]


def test_sweep_of_every_case(spark, tmp_path):
    out, r, v = sweep(spark, tmp_path, TEXTS, VECTORS)
    assert r == ROUNDS
    assert v == [(2, ":prompt", "doomed"), (20, ":prompt", "orphan"), (6, ":prompt", "short"), (8, ":response", "stale")]
    assert out["rounds"]["keep"] == 3 and out["vectors"] == {"doomed": 1, "orphan": 1, "short": 1, "stale": 1}
    summary = spark.read.json(f"file://{tmp_path}/out/summary")
    assert summary.agg(F.sum("ids")).first()[0] == len(ROUNDS)


def test_sweep_again_and_with_other_settings(spark, tmp_path):
    first = sweep(spark, tmp_path, TEXTS, VECTORS)
    assert sweep(spark, tmp_path, TEXTS, VECTORS) == first
    out, r, _ = sweep(spark, tmp_path, TEXTS, VECTORS, model="m2", short_words=1)
    assert (1, "reembed", None, 1) in r and "short" not in out["vectors"]
    assert sweep(spark, tmp_path, [], VECTORS)[0] == {"rounds": {}, "vectors": {"orphan": 11}}
    assert sweep(spark, tmp_path, TEXTS, [])[0]["vectors"] == {}


def test_sweep_of_a_hot_text(spark, tmp_path):
    texts = [(i, LONG, "hot", 0) for i in range(3000)] + [(i, f"{LONG} {i}", "s", 0) for i in range(3000, 3100)]
    out, r, _ = sweep(spark, tmp_path, texts, [])
    assert out["rounds"] == {"duplicate": 2999, "embed": 101} and all(k == 0 for _, a, k, _ in r if a == "duplicate")


@pytest.mark.parametrize("job", ["digest", "sweep"])
def test_command_line(spark, tmp_path, job):
    """Settings come from the config file, and from the command line before it."""
    config = json.loads((ROOT / f"jobs/{job}.json").read_text()) | {"output": str(tmp_path / "out")}
    more = {"digest": ["--source", f"{DATA}/conversations.parquet*", "--checkpoint", str(tmp_path / "cp"), "--buckets", "3"], "sweep": ["--rounds", f"{DATA}/documents.parquet", "--vectors", f"{DATA}/embeddings.parquet"]}[job]
    (tmp_path / "own.json").write_text(json.dumps(config))
    env = os.environ | {"PYTHONPATH": str(ROOT)}
    for _ in range(2):
        run = subprocess.run([sys.executable, "-m", f"jobs.{job}", "--config", str(tmp_path / "own.json"), *more], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
        assert run.returncode == 0, run.stderr[-2000:]
        out = json.loads(run.stdout.splitlines()[-1])
    assert "written to" in run.stderr or job == "digest"
    if job == "digest":
        assert out["batches"] == 0 and spark.read.parquet(str(tmp_path / "out/rounds")).count() > 0 and len(list((tmp_path / "out/rounds").glob("bucket=*"))) == 3
    else:
        assert sum(out["rounds"].values()) == spark.read.parquet(f"{DATA}/documents.parquet").count()
