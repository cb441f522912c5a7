import base64
import hashlib
import importlib
import math
import random
import struct
import sys
import zlib
from collections import Counter
from functools import lru_cache

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import bpe, cotraining, queries, toxicity
from palimpsest.llm.common import materialize
from tests.conftest import DATA
from tests.llm import brute
from tests.test_oracle import rows

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache
def table():
    return bpe.BpeTable(PATH, public_tokenizers.PATTERN)


def check(texts, reference):
    t = table()
    ids = t.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [reference.encode_ordinary(x) for x in texts]
    assert t.decode(ids) == [x.encode() for x in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_any_text(reference, texts):
    check(texts, reference)


def test_long_words_and_special_strings(reference):
    r = random.Random(1)
    words = ["".join(r.choice(a) for _ in range(r.randint(60, 2500))) for a in ("abcdeé", "etaoin", "=-", "aab") for _ in range(4)]
    check([*words, "a" * 50_000, "aab" * 9000, "<|endoftext|> x\n\n  y", "", " ", "🙂" * 40], reference)


@pytest.mark.parametrize("piece, overlap", [(6, 2), (8, 1), (40, 30)])
def test_pieces_that_seldom_join(monkeypatch, reference, piece, overlap):
    """Small overlaps make neighbours without a common token, which other pieces then connect."""
    asked, real = [], bpe.BpeTable._merge
    monkeypatch.setattr(bpe, "PIECE", piece)
    monkeypatch.setattr(bpe, "OVERLAP", overlap)
    monkeypatch.setattr(bpe.BpeTable, "_merge", lambda self, pieces: asked.append(len(pieces)) or real(self, pieces))
    r = random.Random(2)
    t = bpe.BpeTable(PATH, public_tokenizers.PATTERN)
    texts = ["".join(r.choice(a) for _ in range(700)) for a in ("ab", "abcdeé", "etaoin", "=-", "aab", "漢字仮名")] + ["abc" * 300, "thequickbrownfox" * 30]
    assert [np.frombuffer(x, "<u4").tolist() for x in t.encode(texts)] == [reference.encode_ordinary(x) for x in texts]
    assert overlap > 2 or len(asked) > 2


@pytest.fixture(scope="module")
def prose():
    texts = [t for (t,) in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' where text is not null").fetchall()]
    return " ".join(texts)


def test_texts_of_ten_megabytes(reference, prose):
    """One text of prose, one of a single word in another script: more tokens than a query may hold."""
    r = random.Random(7)
    cjk = "".join(chr(r.randint(0x4E00, 0x9000)) for _ in range(500_000))
    text = (prose * (10_000_000 // len(prose) + 1))[:10_000_000]
    t = bpe.BpeTable(PATH, public_tokenizers.PATTERN)
    ids = t.encode([text, cjk])
    assert len(ids[0]) > 4 * bpe.QUERY_TOKENS < len(ids[1])
    assert np.frombuffer(ids[0], "<u4").tolist() == reference.encode_ordinary(text)
    assert t.decode(ids) == [text.encode(), cjk.encode()]


def test_many_dense_texts_in_one_batch(spark, reference):
    r = random.Random(8)
    texts = ["".join(chr(r.randint(0x4E00, 0x9000)) for _ in range(1000)) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    out = bpe.encode_decode(df, PATH, public_tokenizers.PATTERN)
    assert out.where(F.col("decoded") == F.encode("text", "utf-8")).count() == 1500
    few = {x.doc_id: np.frombuffer(x.ids, "<u4").tolist() for x in out.where("doc_id < 40").select("doc_id", "ids").collect()}
    assert few == {k: reference.encode_ordinary(texts[k]) for k in range(40)}


@pytest.mark.parametrize("tokens, words, merge", [(1, 1, 1), (3, 7, 5), (1000, 100, 40)])
def test_queries_of_any_size_give_the_same(monkeypatch, reference, tokens, words, merge):
    for name, n in (("QUERY_TOKENS", tokens), ("LOOKUP_BYTES", words), ("QUERY_BYTES", merge)):
        monkeypatch.setattr(bpe, name, n)
    t, texts = bpe.BpeTable(PATH, public_tokenizers.PATTERN), ["", "Hello hello, wörld " * 9, "", "x", "漢字仮名" * 12]
    ids = t.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [reference.encode_ordinary(x) for x in texts]
    assert t.decode(ids) == [x.encode() for x in texts]


def test_spill_folder_is_the_executors(monkeypatch):
    monkeypatch.setenv("SPARK_LOCAL_DIRS", "/a/b,/c")
    assert bpe.spill_folder().startswith("/a/b/")
    monkeypatch.delenv("SPARK_LOCAL_DIRS")
    assert bpe.spill_folder() == ""


def test_query_equals_the_library(spark, reference):
    docs = duckdb.sql(f"select doc_id, coalesce(text, '') from '{DATA}/documents.parquet'").fetchall()
    ids = {d: np.array(reference.encode_ordinary(t), "<u4") for d, t in docs}
    hexed = lambda b: hashlib.sha256(b).hexdigest()
    got = queries.QUERIES["op10_bpe"](spark, DATA).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == {d: (len(ids[d]), hexed(ids[d].tobytes()), hexed(t.encode())) for d, t in docs}


def test_encode_decode_edges(spark, reference):
    df = spark.createDataFrame([(1, None, 3), (2, "", 4), (3, "Hello hello", 5), (3, "Hello hello", 5)], "doc_id long, text string, ids int")
    out = bpe.encode_decode(df, PATH, public_tokenizers.PATTERN)
    got = [(r.doc_id, bytes(r.ids), r.n_tokens, bytes(r.decoded)) for r in out.orderBy("doc_id").collect()]
    ids = np.array(reference.encode_ordinary("Hello hello"), "<u4").tobytes()
    assert got == [(1, b"", 0, b""), (2, b"", 0, b""), (3, ids, len(ids) // 4, b"Hello hello"), (3, ids, len(ids) // 4, b"Hello hello")]
    assert out.columns == ["doc_id", "text", "ids", "n_tokens", "decoded"] and bpe.encode_decode(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "conversations", "pages", "labels", "embeddings"):
        db.execute(f"create view {t} as from '{DATA}/{t}.parquet'")
    cur = db.execute(queries.ORACLE_SQL[name])
    df = queries.QUERIES[name](spark, DATA)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in cur.description], cur.fetchall())


def test_join_query_equals_brute_force(spark):
    docs = duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op2_ngram_join"](spark, DATA).collect()} == brute.ngram_join(docs)


def test_pipeline_stages(spark):
    """Each stage on its predecessor's documents, against plain versions."""
    data = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = materialize(stages["toxicity"](spark, docs, data))
    marked = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    kept = {r.doc_id: r.text for r in clean.collect()}
    toxic = {d for d, t in marked.items() if t}
    assert set(clean.columns) == set(docs.columns) and len(toxic & kept.keys()) <= 2
    assert sum(t == 0 and d not in kept for d, t in marked.items()) <= 2
    near = materialize(stages["ngram_join"](spark, clean, data))
    left = {r.doc_id: r.text for r in near.collect()}
    assert left.keys() == {d for d, (_, c) in brute.ngram_join(list(kept.items())).items() if d == c}
    cut = materialize(stages["suffix_dedup"](spark, near, data))
    want = brute.suffix_dedup(list(left.items()))
    rest = {r.doc_id: r for r in cut.collect()}
    assert rest.keys() == left.keys() and all(r.n_chars == len(r.text) for r in rest.values())
    for d, (n, removed, runs, _) in want.items():
        assert 0 <= n - removed - len(rest[d].text.encode()) <= 6 * runs
    mixed = materialize(stages["mixing"](spark, cut, data))
    assert set(mixed.columns) == set(docs.columns) and mixed.join(cut, "doc_id", "left_anti").isEmpty()
    last = stages["bpe"](spark, mixed, data)
    assert last.count() == mixed.count() and last.where("not decodes").count() == 0


def test_bytes_around_a_removed_run_do_not_fuse(spark):
    same = " ".join(str(i) for i in range(60))
    docs = spark.createDataFrame([(1, f"a é{same}ü", "x", "s", 9), (2, f"b ĩ{same}è c", "x", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    out = dict(corpus_pipeline.STAGES)["suffix_dedup"](spark, docs, "").orderBy("doc_id").collect()
    assert [r.text for r in out] == [f"a é{same}ü", "b  c"] and out[1].n_chars == 4


def test_rows_without_ids_or_with_anothers_stay(spark):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    long = words(9)
    given = [(1, words(1)), (1, words(2)), (2, words(3)), (2, words(3)), (None, words(4)), (None, words(5)), (None, words(1)), (3, long), (None, f"{long} {words(6)} {words(7)}"), (None, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in given], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    near = materialize(stages["ngram_join"](spark, docs, ""))
    left = [(1, words(1)), (1, words(2)), (2, words(3)), (None, words(4)), (None, words(5)), (3, long), (None, f"{long} {words(6)} {words(7)}"), (None, None)]
    order = lambda rows: sorted(rows, key=str)
    assert order((r.doc_id, r.text) for r in near.collect()) == order(left)
    cut = stages["suffix_dedup"](spark, near, "").collect()
    want = [(d, f" {words(6)} {words(7)}" if t and t.startswith(f"{long} ") else t) for d, t in left]
    assert order((r.doc_id, r.text) for r in cut) == order(want)


def test_library_stands_without_this_part(monkeypatch):
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries()
    for name in [n for n in sys.modules if n.startswith(("palimpsest.llm", "corpus_pipeline"))]:
        monkeypatch.setitem(sys.modules, name, None)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    alone = importlib.import_module("__spark_entry__")
    assert alone.queries() and not any(k.startswith("op") and k[2].isdigit() or k == "pipeline" for k in alone.queries())
    assert set(alone.oracle_sql()) <= set(alone.queries())


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, name):
    """Nulls in any column, empty and very long texts, repeated rows, columns of clashing names; then an empty table."""
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(1, None, None, None, None), (None, "", "en", None, 0), (2, long, "en", "s", len(long)), (3, "kind words " * 30, None, "s", None), (3, "kind words " * 30, None, "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    odd = docs.selectExpr("*", "1 ids", "2 spans", "3 component_id", "4 toxicity", "5 rate", "6 _id", "7 decoded", "8 kept", "9 n")
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, odd, DATA)
    columns = ["doc_id", "source", "ids", "n_tokens", "decodes"] if name == "bpe" else docs.columns
    got = out.collect()
    assert out.columns == columns and stage(spark, odd.limit(0), DATA).count() == 0
    if name != "mixing":
        want = {"ngram_join": 4, "toxicity": 5, "suffix_dedup": 5, "bpe": 5}[name]
        assert len(got) == want and {(r.doc_id, r.source) for r in got} == {(r[0], r[3]) for r in rows}
    else:
        assert {(r.doc_id, r.text) for r in got} <= {(r[0], r[1]) for r in rows}


def test_audio_query_equals_plain_version(spark):
    """All columns but `feature`, whose parts have tests of their own, from the texts alone; equal texts have equal rows."""
    docs = duckdb.sql(f"select doc_id, coalesce(text, '') from '{DATA}/documents.parquet'").fetchall()
    want, by_text, texts = {}, {}, dict(docs)
    for d, t in docs:
        raw = t.encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        wav = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, 16_000, 16_000, 1, 8, b"data", len(payload)) + payload
        want[d] = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(wav), hashlib.sha256(wav).hexdigest())
    for r in queries.QUERIES["op5_audio_features"](spark, DATA).collect():
        assert want.pop(r.doc_id) == (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256)
        assert by_text.setdefault(texts[r.doc_id], r.feature) == r.feature
    assert not want and len(set(by_text.values())) > len(by_text) // 2


def plain_bin(gram, n):
    h = 0
    for i, c in enumerate(gram):
        h = ord(c) if i == 0 else (h * 0x9E3779B1 + ord(c) + 1) % 2**32
    return ((h ^ h >> 15) * ((0x85EBCA6B + 2 * n) | 1)) % 2**32 >> 14


def test_toxicity_query_equals_plain_version(spark):
    """Scores from the model's weights, n-gram by n-gram; the model learns from the other folds alone."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, ~F.expr(queries.HELD_OUT))
    blind = toxicity.fit(docs, labels.withColumn("toxic", F.when(~F.expr(queries.HELD_OUT), F.col("toxic")).otherwise(1 - F.col("toxic"))), ~F.expr(queries.HELD_OUT))
    assert (model.weight == blind.weight).all() and model.bias == blind.bias
    got = {r.doc_id: r for r in queries.QUERIES["op7_toxicity_nbsvm"](spark, DATA).collect()}
    for r in docs.collect():
        t = (r.text or "").lower()
        count = Counter(plain_bin(t[i : i + n], n) for n in toxicity.ORDERS for i in range(len(t) - n + 1))
        score = 1 / (1 + math.exp(-max(-40, min(40, model.bias + sum(model.weight[b] * math.log1p(k) for b, k in count.items() if model.weight[b])))))
        x = got.pop(r.doc_id)
        assert abs(x.score - score) < 1e-9 and x.predicted == (x.score >= 0.7) and x.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    assert not got


def test_quality_query_equals_plain_version(spark):
    """Scores from both views' weights, row by row; the model learns from the other folds alone."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    m = cotraining.fit(docs, labels, ~F.expr(queries.HELD_OUT))
    got = {r.doc_id: r for r in queries.QUERIES["op4_quality_cotraining"](spark, DATA).collect()}
    for r in docs.collect():
        logit = 0.0
        for view, x, part in ((m.text, cotraining.text_features(r.text, m.telling), m.share), (m.meta, cotraining.meta_features(r.lang, r.source, r.n_chars), 1 - m.share)):
            margin = sum(float((a - b) / c * w) for a, b, c, w in zip(x, view.mean, view.scale, view.w)) + view.b
            logit += part * (view.a * margin + view.c)
        x = got.pop(r.doc_id)
        assert abs(x.score - 1 / (1 + math.exp(-max(-40, min(40, logit))))) < 1e-6 and x.keep == (x.score >= 0.5)
    assert not got
