import hashlib
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import audio, chat, cotraining, linear, mixing, rp_forest, toxicity, url_reputation
from palimpsest.llm.queries import PROBE, RULES
from tests.conftest import DATA

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = toxicity.fit(docs, labels, ~held)
    x = toxicity.score(docs.where(held).select("doc_id", "text"), model).join(labels, "doc_id").select("toxic", "toxic_predicted", "toxicity").collect()
    hit = sum(r.toxic == r.toxic_predicted for r in x)
    wrong = sum(r.toxic_predicted and not r.toxic for r in x)
    assert hit / len(x) > 0.98 and wrong <= 0.005 * len(x) and all(0 <= r.toxicity <= 1 for r in x)


def test_log_count_ratios_scale_the_features():
    rows = [(f"calm words here {i}", 0) for i in range(40)] + [(f"calm words grumpf {i}", 1) for i in range(40)]
    m = toxicity.train(rows, least_z=2.0)
    assert m.score("grumpf") > 0.8 > 0.5 > m.score("here") and m.score("") == m.score(None)
    assert toxicity.train([]).score("x") == 0.5 and toxicity.train([("a", 1)] * 5).score("a") > 0.5


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "text", 1)], "doc_id long, text string, toxicity int")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, labels))
    assert out.columns == ["doc_id", "text", "toxicity", "toxic_predicted"] and out.count() == 3
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


def test_whole_texts_count():
    m = toxicity.ToxicityModel(np.zeros(linear.BINS), 0.0)
    m.weight[linear.ngram_bins("zqx", (3,))[0]] = 2.0
    assert m.score("a" * 200_000 + "zqx") > m.score("a" * 200_000)


def test_co_training(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    x = cotraining.score(docs, cotraining.fit(docs, labels, ~held)).where(held).join(labels, "doc_id").select("quality", "keep").collect()
    assert sum(r.quality == int(r.keep) for r in x) / len(x) > 0.9


def test_content_that_tells_is_counted():
    texts = [f"some plain words number {i}" for i in range(60)] + [f"some plain words BUYNOW number {i}" for i in range(60)]
    y = np.repeat([1, 0], 60)
    bins = cotraining.telling_bins(texts, y, 3.0)
    hits = lambda t: int(cotraining.text_hits(t, bins).sum())
    assert 0 < len(bins) <= cotraining.TELLING and hits("") == hits(None) == 0 < hits("x buynow y") < hits("buynow " * 5) and 2 * hits(texts[0]) < hits(texts[60])
    assert hits("a" * 200_000 + " buynow ") and len(cotraining.telling_bins(texts, np.ones(120))) == 0
    assert cotraining.meta_bins(None, "a", 1)[0] != cotraining.meta_bins("", "a", 1)[0]


def test_views_teach_each_other():
    r = np.random.default_rng(0)
    y = r.integers(0, 2, 600)
    a, b = r.normal(size=(600, 3)) + 3 * y[:, None], r.normal(size=(600, 2)) + 3 * y[:, None]
    known = np.where(np.arange(600) < 40, y, -1)
    m = cotraining.co_train(a, b, known)
    assert ((m.score(a, b) > 0.5) == y)[40:].mean() > 0.97
    assert cotraining.co_train(a, b, np.full(600, -1)).score(a, b)[0] == 0.5


def test_rare_junk_among_unlabelled_rows_is_learned():
    """Fifty rows, of which one view is sure, but less than of thousands of others, teach the other view a new sign of junk."""
    r = np.random.default_rng(1)
    y, rare = r.integers(0, 2, 5000), np.zeros(5000, bool)
    rare[200:250], y[200:250] = True, 0
    text = np.c_[r.normal(0, 0.3, 5000) + 3 * (y | rare), rare]
    meta = np.c_[r.normal(0, 0.2, 5000) + np.where(rare, -1, 4 * y - 2), r.normal(size=5000)]
    m = cotraining.co_train(text, meta, np.where(np.arange(5000) < 200, y, -1))
    assert m.text.w[1] < -0.01


def test_all_unlabelled_documents_are_in_the_pool(spark, monkeypatch):
    got, none = [], np.zeros(0, np.int64)
    monkeypatch.setattr(cotraining, "_fit_rows", lambda rows, pool: got.append((rows, pool(none))))
    docs = spark.range(0, 7000, 1, 5).selectExpr("nullif(id, 6999) doc_id", "concat('words of document ', id) text", "'en' lang", "'web' source", "20L n_chars")
    labels = spark.range(40).selectExpr("id doc_id", "int(id % 2) quality")
    cotraining.fit(docs, labels)
    rows, pool = got[0]
    yes = [cotraining.View(np.zeros(n), np.ones(n), np.zeros(n), 9.0) for n in (cotraining.SHAPE + cotraining.TELLING, 65)]
    text, meta = pool([yes], [None, None])
    assert len(rows) == 40 and text[:, 0].tolist() == meta[:, 0].tolist() == [0, 6960]
    every = docs.where("doc_id is null or doc_id >= 40").collect()
    xs = np.array([cotraining.text_features(d.text, none) for d in every]), np.array([cotraining.meta_features(d.lang, d.source, d.n_chars) for d in every])
    for a, b in zip(pool([yes], yes), cotraining.pool_sums(xs, [yes], yes, 0.9)):
        assert np.allclose(a, b, rtol=1e-5, atol=1e-3)


def test_co_training_edges(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "x" * 300_000, "en", "s", 1), (1, "", "", "", 0)], DOCS).withColumn("keep", F.lit("x"))
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert cotraining.score(docs, cotraining.fit(docs, labels)).count() == 3
    assert cotraining.score(docs.limit(0), cotraining.fit(docs.limit(0), labels)).count() == 0


# -- audio -----------------------------------------------------------------


@pytest.mark.parametrize("text", [None, "", "a", "é" * 40, "x" * 64, "word " * 30_000])
def test_media_round_trip(text):
    payload = audio.text_payload(text)
    raw = (text or "").encode()
    assert payload.startswith(raw) and len(payload) % 64 == 0 and len(payload) > 0 and len(payload) - len(raw) <= 64
    media = audio.wav_bytes(payload, 16_000)
    samples, rate = audio.wav_samples(media)
    assert samples.tobytes() == payload and rate == 16_000 and struct.unpack_from("<I", media, 40)[0] == len(payload)
    stream, spans = audio.features(samples, rate, audio.AudioParams())
    t = audio.read_tensors(stream)
    assert isinstance(t.schema.field("patch").type, pa.FixedShapeTensorType) and t.schema.field("patch").type.shape == [16, 40]
    assert all(a < b for a, b in spans) and np.isfinite(t["patch"].combine_chunks().to_numpy_ndarray()).all()


@pytest.mark.parametrize("rate, target", [(16_000, 8_000), (16_000, 16_000), (22_050, 8_000), (8_000, 12_000)])
def test_resampling_keeps_a_tone(rate, target):
    n = rate // 4
    tone = lambda r, k: np.sin(2 * np.pi * 440 * np.arange(k) / r)
    y = audio.resample(tone(rate, n), rate, target)
    assert abs(len(y) - n * target / rate) <= 1
    mid = slice(len(y) // 4, 3 * len(y) // 4)
    assert np.abs(y[mid] - tone(target, len(y))[mid]).max() < 0.05


def test_polyphase_equals_zero_stuffing():
    x, h = np.random.default_rng(1).normal(size=200).astype(np.float32), audio._low_pass(3, 2, 24)
    stuffed = np.zeros(600)
    stuffed[::3] = x
    full = np.convolve(stuffed, h)[(len(h) - 1) // 2 :][::2]
    y = audio.resample(x, 2, 3)
    assert np.allclose(y, full[: len(y)], atol=1e-4)


def test_hysteresis():
    e = np.array([-30, -17, -20, -23, -25, -20, -17, -17])
    assert audio.hysteresis(e, -18, -24) == [(1, 4), (6, 8)]
    assert audio.hysteresis(np.array([-50.0]), -18, -24) == []


def test_audio_edges(spark):
    df = spark.createDataFrame([(1, "same", "m"), (2, "same", None), (3, None, "x")], "doc_id long, text string, media string")
    out = audio.audio_features(audio.store_text(df))
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].tensors == rows[2].tensors and rows[1].media == rows[2].media and rows[3].n_bytes == 0
    assert audio.audio_features(audio.store_text(df.limit(0))).count() == 0
    assert audio.audio_features(spark.createDataFrame([(1, None)], "k int, media binary")).first().tensors is None


# -- neighbours ------------------------------------------------------------


def near_rows(spark, n=3000, dim=16, seed=1):
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, dim))
    v[100:400] = v[100]  # a vector that many rows share
    return v, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")


def brute_nearest(v, q, k):
    s = (v[q] * v).sum(1)
    order = [i for i in np.lexsort((np.arange(len(v)), -s)) if i != q][:k]
    return [(i, s[i]) for i in order]


def test_recall_and_order(spark):
    v, df = near_rows(spark)
    got = {}
    for r in rp_forest.nearest(df, F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q in range(0, 3000, 20):
        found = sorted(got[q])
        assert [x[0] for x in found] == list(range(1, 21)) and q not in [x[1] for x in found]
        assert [(-x[2], x[1]) for x in found] == sorted((-x[2], x[1]) for x in found)
        hits += len({x[1] for x in found} & {i for i, _ in brute_nearest(v, q, 20)})
    assert hits / (150 * 20) >= 0.9
    assert [x[1] for x in sorted(got[100])] == list(range(101, 121)) and [x[1] for x in sorted(got[120])] == list(range(100, 120))


def test_recall_on_the_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = sorted(df.collect())
    v = np.array([r.embedding for r in rows], float)
    at = {r.vec_id: i for i, r in enumerate(rows)}
    hits = total = 0
    for r in rp_forest.nearest(df, F.col("vec_id") % 20 == 0, 20).groupBy("query_id").agg(F.collect_list("vec_id").alias("f")).collect():
        best = {rows[i].vec_id for i, _ in brute_nearest(v, at[r.query_id], 20)}
        hits, total = hits + len(best & set(r.f)), total + len(best)
    assert hits / total >= 0.9


@pytest.mark.parametrize("spread, most", [(0.15, 0.6), (None, 4.0)])
def test_what_is_read_follows_the_vectors(spread, most):
    """Clustered vectors need a small share of the rows, without structure most of them: recall is reached on rows of their own."""
    r = np.random.default_rng(3)
    x = r.normal(size=(6000, 32)) if spread is None else r.normal(size=(60, 32))[r.integers(0, 60, 6000)] + spread * r.normal(size=(6000, 32))
    p = rp_forest.ForestParams(trials=60)
    forest = rp_forest.Forest(x[:3000], len(x), p)
    share = forest.share(x[:3000], 10, p)
    assert share <= most and (spread or share > 0.8)
    leaves = forest.leaves(x)
    counts = [np.bincount(leaves[:, t], minlength=leaves[:, t].max() + 1) for t in range(4)]
    hits = 0
    for i in range(3000, 3060):
        found = {f for f in forest.search(x[i], counts, share * len(x))}
        hits += sum(any((t, leaves[j, t]) in found for t in range(4)) for j, _ in brute_nearest(x, i, 10))
    assert hits / 600 >= 0.9


@pytest.mark.parametrize("visits, sharers, batch", [(7, 20, 10000), (64, 1, 9), (1 << 16, 1 << 16, 33)])
def test_blocks_are_copied_and_queries_that_share_a_vector_dealt_out(spark, monkeypatch, visits, sharers, batch):
    """A hundred of the queries have one vector; batches end within a block's rows and within its queries."""
    v, df = near_rows(spark, 600, 8)
    whole = sorted(map(tuple, rp_forest.nearest(df, F.col("vec_id") % 3 == 0, 5).collect()))
    for q in range(0, 600, 3):
        assert [x[2] for x in whole if x[0] == q] == [i for i, _ in brute_nearest(v, q, 5)]
    monkeypatch.setattr(rp_forest, "VISITS", visits)
    monkeypatch.setattr(rp_forest, "SHARERS", sharers)
    monkeypatch.setattr(rp_forest, "BLOCK_ROWS", 100)
    batch_before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        assert sorted(map(tuple, rp_forest.nearest(df, F.col("vec_id") % 3 == 0, 5).collect())) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch_before)


def test_neighbour_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [1.0]), (None, [1.0, 1.0]), (7, [-1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, rp_forest.nearest(df, F.lit(True), 20).collect()))
    assert got == [(0, 1, 1, 1.0), (0, 2, 7, -1.0), (1, 1, 0, 1.0), (1, 2, 7, -1.0), (7, 1, 0, -1.0), (7, 2, 1, -1.0)]
    assert rp_forest.nearest(df.limit(0), F.lit(True)).count() == 0


# -- chat ------------------------------------------------------------------


def test_chat(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "hi <|im_end|> &amp; &lt;|"), (1, 2, "assistant", "yo"), (2, 0, "assistant", None), (3, 0, "user", PROBE), (3, 1, "assistant", PROBE), (None, 0, None, "x"), (4, 0, "us\ner", "a\n"), (4, 0, "us\ner", "a\n")]
    out = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1)))
    back = {r.conv_id: r for r in chat.read_back(out).collect()}
    first = out.where("conv_id = 1").first()
    assert first.formatted.startswith("<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nhi &lt;|im_end|>")
    assert [s.text for s in first.segments if s.loss] == ["yo"] and "".join(s.text for s in first.segments) == first.formatted
    assert [(t.role, t.text) for t in back[1].turns] == [("system", "s"), ("user", "hi <|im_end|> &amp; &lt;|"), ("assistant", "yo")]
    assert (back[1].valid, back[2].valid, back[3].valid, back[3].loss) == (True, False, True, [PROBE])
    assert [(t.role, t.text) for t in back[None].turns] == [("", "x")] and len(back[4].turns) == 2 and back[4].turns[0].role == "us\ner"
    assert chat.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# -- mixing ----------------------------------------------------------------


def poisson_quantile(u, rate):
    k, p = 0, math.exp(-rate)
    c = p
    while c < u:
        k += 1
        p *= rate / k
        c += p
    return k


def test_poisson_replication(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "b").otherwise("a").alias("source"))
    out = mixing.mix(docs, {"a": 1.0, "b": 3.0}, epochs=2.0)
    got = {(r.source): r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(got["a"] / 2000 - 1) < 0.1 and abs(got["b"] / 6000 - 1) < 0.1
    rates = {r.source: r.rate for r in mixing.source_rates(docs, {"a": 1.0, "b": 3.0}, epochs=2.0).collect()}
    assert rates == pytest.approx({"a": 2000 / 3000, "b": 6.0})
    u = lambda i: (int(hashlib.md5(f"1:{i}:0".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert all(counts.get(i, 0) == poisson_quantile(u(i), rates["b" if i % 4 == 0 else "a"]) for i in range(0, 4000, 37))
    assert mixing.mix(docs, {"a": 1.0, "b": 3.0}, epochs=2.0).count() == out.count()


def test_high_rates_and_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "s", 1), (2, "s", 2)], "doc_id long, source string, copy_no int").withColumn("rate", F.lit("x"))
    out = mixing.mix(docs, {"s": 1.0}, epochs=1000.0)
    assert out.columns == ["doc_id", "source", "rate", "copy_no", "shuffle_key"] and abs(out.count() / 4000 - 1) < 0.1
    assert out.where("source is null").count() == 0 and mixing.mix(docs.limit(0)).count() == 0
    even = mixing.mix(docs, alpha=1.0, epochs=50.0)
    assert even.where("source is null").count() > 0


# -- urls ------------------------------------------------------------------


def judge(spark, urls, bad=()):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("mean", F.lit(0))
    out = spark.createDataFrame(list(bad) or [(None, None)], "page_id long, bad int")
    return {r.page_id: r for r in url_reputation.judge_urls(pages, out, RULES).collect()}


def test_rules(spark):
    urls = ["http://A.Example.com/en/x?q#f", "https://www.example.com/en/", "http://example.com/de/", "http://b.net/es/", "http://net/fr/1", "http://com", "http://xcom/", None, "no scheme", "ftp://h?x", "http://notexample.com/en/"]
    got = judge(spark, urls)
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(11)] == [
        ("a.example.com", "/en/x", "example.com/en/", "block"),
        ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("example.com", "/de/", "com/", "allow"),
        ("b.net", "/es/", "net/es/", "block"),
        ("net", "/fr/1", "net/fr/", "block"),
        ("com", "", None, "allow"),
        ("xcom", "/", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("h", "", None, "allow"),
        ("notexample.com", "/en/", "com/", "allow"),
    ]


def test_shrinkage(spark):
    urls = ["http://a.bad.org/"] * 40 + ["http://new.bad.org/"] + ["http://good.org/"] * 200 + ["http://rare.io/"]
    got = judge(spark, urls, [(i, 1) for i in range(40)] + [(i, 0) for i in range(41, 241)] + [(241, 1), (241, None)])
    assert got[0].verdict == "block" and got[41].verdict == "allow"
    assert got[41].mean < got[241].mean < got[0].mean and got[41].mean < got[40].mean < got[0].mean
    assert url_reputation.judge_urls(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "page_id long, bad int"), RULES).count() == 0


def test_repeated_pages_and_long_urls(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x")] * 3 + [(None, "http://a.org/" + "y" * 100_000), (2, "")], "page_id long, url string")
    out = url_reputation.judge_urls(pages, spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, 5)], "page_id long, bad int"), RULES)
    got = sorted((r.page_id or 0, r.host, len(r.path)) for r in out.collect())
    assert got == [(0, "a.org", 100_001), (1, "a.org", 2), (1, "a.org", 2), (1, "a.org", 2), (2, "", 0)]


def test_parts_of_hosts(spark):
    df = spark.createDataFrame([("a.b.co.uk",), ("b.com",), ("com",), ("",), ("x.y.com.mx",), ("me.github.io",), ("gov.uk",), ("a.co.info",)], "h string")
    assert [tuple(r) for r in df.select(*url_reputation.domain_parts(F.col("h"))).collect()] == [
        ("b.co.uk", "co.uk"), ("b.com", "com"), ("com", "com"), ("", ""), ("y.com.mx", "com.mx"), ("me.github.io", "github.io"), ("gov.uk", "gov.uk"), ("co.info", "info"),
    ]


def test_crc_is_the_fold(spark):
    assert spark.range(50).select(F.crc32(F.col("id").cast("string"))).collect() == [(zlib.crc32(str(i).encode()),) for i in range(50)]
