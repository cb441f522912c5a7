"""Quality by co-training: a text view and a metadata view teach each other, then their calibrated scores combine.

The text view has the shape of the whole text and how often those n-grams occur in
it that tell most of the labelled texts apart; the metadata view never sees the text.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import materialize, release
from palimpsest.llm.linear import counted, fit_logistic, ngram_bins, sigmoid, tell_apart

WIDTH = 64  # hashed categories of the metadata view
SHAPE, TELLING = 16, 24  # features of a text's shape, and n-grams that are counted in it
ORDERS = (4, 6)  # characters of an n-gram
_ROW = np.dtype([("shape", "<f4", SHAPE), ("hits", "<u4", TELLING), ("meta", "u1", 5)])  # a row's features, as they are stored


def telling_bins(texts: list[str | None], y: np.ndarray, least_z: float = 6.0) -> np.ndarray:
    """At most TELLING bins of hashed n-grams, those whose shares differ most, and clearly, between the classes of `y`."""
    found = [counted(ngram_bins(t, ORDERS)) for t in texts]
    return np.sort(tell_apart(found, y, TELLING, least_z)[0]) if len(np.unique(y)) == 2 else np.zeros(0, np.int64)


def text_hits(text: str | None, telling: np.ndarray) -> np.ndarray:
    """How often each n-gram of `telling` occurs in the whole text; zeros fill up to TELLING."""
    out = np.zeros(TELLING, np.int64)
    if len(telling):
        for bins in ngram_bins(text, ORDERS):
            at = np.searchsorted(telling, bins)
            at = at[telling[np.minimum(at, len(telling) - 1)] == bins]
            out[: len(telling)] += np.bincount(at, minlength=len(telling))
    return out


def text_rows(shape: np.ndarray, hits: np.ndarray) -> np.ndarray:
    return np.hstack([shape, np.log1p(hits, dtype=float)])


def text_features(text: str | None, telling: np.ndarray) -> np.ndarray:
    return text_rows(text_shape(text), text_hits(text, telling))


def text_shape(text: str | None) -> np.ndarray:
    """Shape of the whole text: lengths, shares of character classes, repetition of words and lines."""
    t = text or ""
    b = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(len(b), 1)
    hist = np.bincount(b, minlength=256) / n
    words = t.split()
    lines = [x for x in t.split("\n") if x.strip()]
    lengths = np.array([len(w) for w in words] or [0])
    p = hist[hist > 0]
    return np.array([
        np.log1p(len(words)) / 8, np.log1p(len(lines)) / 6, lengths.mean() / 10, lengths.max() / 40,
        hist[48:58].sum() * 5, hist[65:91].sum() * 5, hist[97:123].sum(), hist[[33, 35, 36, 37, 38, 42, 64, 94, 95, 126, 124]].sum() * 10,
        hist[[44, 46]].sum() * 10, hist[128:].sum(), hist[32] * 3, hist[10] * 10, len(set(words)) / max(len(words), 1),
        len(set(lines)) / max(len(lines), 1), -(p * np.log(p)).sum() / 5, hist[[123, 125, 60, 62, 59, 61]].sum() * 10,
    ])


def meta_bins(lang: str | None, source: str | None, n_chars: int | None) -> list[int]:
    """Hashed language, source and length class, then the length class itself; nulls are values of their own."""
    bucket = -1 if n_chars is None else int(np.log2(max(int(n_chars), 0) + 1))
    parts = (f"l={lang!r}", f"s={source!r}", f"n={bucket}", f"ln={lang!r}/{bucket}")
    return [*(zlib.crc32(part.encode()) % WIDTH for part in parts), max(bucket, 0)]


def meta_rows(bins: np.ndarray) -> np.ndarray:
    x = np.zeros((len(bins), WIDTH + 1))
    np.add.at(x, (np.arange(len(bins))[:, None], bins[:, :-1]), 1)
    x[:, WIDTH] = bins[:, -1] / 16
    return x


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    return meta_rows(np.array([meta_bins(lang, source, n_chars)]))[0]


@dataclass(frozen=True)
class View:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: float
    a: float = 1.0  # calibration: sigmoid(a * margin + c)
    c: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w + self.b

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.a * self.margin(x) + self.c


def _sums(x: np.ndarray, y: np.ndarray, view: View | None) -> np.ndarray:
    """For class 0, then 1: rows, sums and squares; for a view its loss, gradient and Hessian (intercept last)."""
    out = []
    for c in (0, 1):
        r = x[y == c]
        if view is None:
            out.append(np.r_[len(r), r.sum(0), (r * r).sum(0)])
            continue
        z = np.c_[(r - view.mean) / view.scale, np.ones(len(r))]
        m = z @ np.r_[view.w, view.b]
        p = sigmoid(m)
        out.append(np.r_[np.logaddexp(0, -m if c else m).sum(), z.T @ (p - c), ((z * (p * (1 - p))[:, None]).T @ z).ravel()])
    return np.array(out)


def pool_sums(xs: tuple[np.ndarray, np.ndarray], past: list[list[View]], now: list[View | None], least: float) -> list[np.ndarray]:
    """_sums for either view over the unlabelled rows `xs`, which add up over parts of them.

    A row's pseudo-label for a view is the first of which the other view was sure to `least` in the rounds `past`.
    """
    out = []
    for j, i in ((0, 1), (1, 0)):
        y = np.full(len(xs[j]), -1)
        for views in past:
            p = sigmoid(views[i].margin(xs[i]))
            y[(y < 0) & (p >= least)] = 1
            y[(y < 0) & (1 - p >= least)] = 0
        out.append(_sums(xs[j], y, now[j]))
    return out


def _fit_views(xs: tuple[np.ndarray, np.ndarray], y: np.ndarray, past: list[list[View]], pool, l2: float = 1.0, steps: int = 30) -> list[View]:
    """Both views by Newton's method on labelled rows and on the pool, which is read once a step.

    The pseudo-labels of a class weigh as much as its labelled rows together, at
    most: so a large pool does not drown the labels, nor the classes' shares.
    """
    far = lambda now: pool(past, now) if past else [0.0, 0.0]
    views, weights, total = [], [], []
    for k, (x, other) in enumerate(zip(xs, far([None, None]))):
        own, other = _sums(x, y, None), other + np.zeros((2, 1 + 2 * x.shape[1]))
        weights.append(np.minimum(1, own[:, :1] / np.maximum(other[:, :1], 1)))
        n, s, q = np.split((own + weights[k] * other).sum(0), [1, 1 + x.shape[1]])
        mean = s / n
        scale = np.sqrt(np.maximum(q / n - mean**2, 0)) + 1e-3
        w, b = np.zeros(x.shape[1]), 0.0
        if past:  # begin where the last round ended
            v = past[-1][k]
            w, b = v.w / v.scale * scale, v.b + float((mean - v.mean) / v.scale @ v.w)
        views.append(View(mean, scale, w, b))
        total.append(float(n[0]))
    at, best, step, done = list(views), [np.inf, np.inf], [1.0, 1.0], [False, False]
    move = [np.zeros(x.shape[1] + 1) for x in xs]
    for _ in range(steps):
        got = far(at)
        for k, x in enumerate(xs):
            if done[k]:
                continue
            v, d = at[k], x.shape[1] + 1
            loss, g, h = np.split((_sums(x, y, v) + weights[k] * got[k]).sum(0), [1, 1 + d])
            loss = float(loss[0]) + l2 / 2 * float(v.w @ v.w)
            if loss <= best[k] * (1 + 1e-9):
                h = h.reshape(d, d) + np.diag(np.r_[np.full(d - 1, l2), 1e-6])
                g = g + l2 * np.r_[v.w, 0]
                views[k], best[k], step[k], move[k] = v, loss, 1.0, np.linalg.solve(h, g)
                done[k] = float(g @ move[k]) < 1e-6 * total[k]
            else:
                step[k] /= 2
            u = views[k]
            at[k] = u if done[k] else View(u.mean, u.scale, u.w - step[k] * move[k][:-1], u.b - step[k] * float(move[k][-1]))
        if all(done):
            break
    return views


def _calibrate(view: View, x: np.ndarray, y: np.ndarray) -> View:
    """Platt scaling on rows the view was not fitted on."""
    if len(y) < 10 or y.min() == y.max():
        return view
    w, b = fit_logistic(view.margin(x)[:, None], y, l2=1.0, steps=150)
    return View(view.mean, view.scale, view.w, view.b, max(float(w[0]), 0.0), b)


@dataclass(frozen=True)
class QualityModel:
    text: View | None
    meta: View | None
    share: float  # weight of the text view
    prior: float
    telling: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        if self.text is None:
            return np.full(len(text), self.prior)
        return sigmoid(self.share * self.text.logit(text) + (1 - self.share) * self.meta.logit(meta))


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, rounds: int = 4, least: float = 0.9, pool=None) -> QualityModel:
    """y: 0, 1, or -1 for unlabelled rows. A quarter of the labelled rows is kept for calibration and for the views' weights.

    Each round, either view pseudo-labels all unlabelled rows of which it is sure
    to `least`, for the other view to learn from. `pool` gives pool_sums of
    unlabelled rows that are elsewhere, in the place of those in y.
    """
    known = np.flatnonzero(y >= 0)
    hold = np.zeros(len(y), bool)
    hold[known[::4]] = True
    train = (y >= 0) & ~hold
    if train.sum() < 4 or len(np.unique(y[train])) < 2:
        share = float((y[known] == 1).mean()) if len(known) else 0.5
        return QualityModel(None, None, 0.5, share)
    xs = (text, meta)
    if pool is None:
        free = (text[y < 0], meta[y < 0])
        pool = lambda past, now: pool_sums(free, past, now, least)
    past: list[list[View]] = []
    for _ in range(rounds + 1):
        past.append(_fit_views((text[train], meta[train]), y[train], past, pool))
    views = [_calibrate(v, x[hold], y[hold].astype(float)) for v, x in zip(past[-1], xs)]
    grid = np.linspace(0, 1, 11)
    if hold.sum() >= 10 and len(np.unique(y[hold])) == 2:
        logits = [v.logit(x[hold]) for v, x in zip(views, xs)]
        loss = [np.log1p(np.exp(-(2 * y[hold] - 1) * np.clip(s * logits[0] + (1 - s) * logits[1], -40, 40))).mean() for s in grid]
        share = float(grid[int(np.argmin(loss))])
    else:
        share = 0.5
    return QualityModel(views[0], views[1], share, 0.5)


def fit(docs: DataFrame, labels: DataFrame, fold=None, labelled: int = 3000, least: float = 0.9) -> QualityModel:
    """Train on at most `labelled` rows with labels (a documented bound), the first by a hash of doc_id, and on all documents without."""
    y = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where(F.lit(True) if fold is None else fold)
    y = y.groupBy("doc_id").agg(F.max("quality").alias("_y"))
    ids = docs.select("doc_id").where("doc_id is not null").distinct().join(y, "doc_id")
    sample = F.broadcast(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled))
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars").join(sample, "doc_id").select("text", "lang", "source", "n_chars", "_y")
    got = sorted(map(tuple, rows.collect()), key=lambda r: [(x is not None, x) for x in r])
    return _fit_rows(got, lambda telling: _pool(docs, y, least, telling)) if got else QualityModel(None, None, 0.5, 0.5)


def _columns(batch: pa.RecordBatch) -> tuple[list, list]:
    """Texts, and language, source and length of each row."""
    text, *rest = [batch.column(c).to_pylist() for c in ("text", "lang", "source", "n_chars")]
    return text, list(zip(*rest))


def _pool(docs: DataFrame, y: DataFrame, least: float, telling: np.ndarray):
    """pool_sums over all documents without a label in `y`: their features are stored once, in blocks, and each call is a pass over them."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("row", T.BinaryType())])

    def features(it):
        for batch in it:
            text, meta = _columns(batch)
            rows = np.zeros(len(text), _ROW)
            if len(text):
                rows["shape"], rows["hits"] = [text_shape(t) for t in text], [text_hits(t, telling) for t in text]
                rows["meta"] = [meta_bins(*m) for m in meta]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "row"])
        release()

    def pack(it):
        for batch in it:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(batch.column("row").to_pylist())], pa.binary())], ["rows"])

    def blocks() -> DataFrame:
        rows = docs.select("doc_id", "text", "lang", "source", "n_chars").mapInArrow(features, schema)
        return materialize(rows.join(y, "doc_id", "left_anti").select("row").mapInArrow(pack, "rows binary"))

    stored: list[DataFrame] = []

    def sums(past: list[list[View]], now: list[View | None]) -> list[np.ndarray]:
        def run(it):
            total = None
            for batch in it:
                for block in batch.column("rows").to_pylist():
                    rows = np.frombuffer(block, _ROW)
                    part = pool_sums((text_rows(rows["shape"], rows["hits"]), meta_rows(rows["meta"])), past, now, least)
                    total = part if total is None else [a + b for a, b in zip(total, part)]
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in total], ["text", "meta"])

        if not stored:
            stored.append(blocks())
        parts = stored[0].mapInArrow(run, "text binary, meta binary").collect()
        return [sum((np.frombuffer(r[k]).reshape(2, -1) for r in parts), 0.0) for k in (0, 1)]

    return sums


def _fit_rows(rows, pool) -> QualityModel:
    order = np.array([zlib.crc32((r[0] or "").encode("utf-8", "surrogatepass")) for r in rows]).argsort(kind="stable")
    rows = [rows[i] for i in order]
    y = np.array([r[4] for r in rows])
    own = np.arange(len(rows)) % 4 != 0  # rows that co_train does not keep for calibration
    telling = telling_bins([r[0] for r, o in zip(rows, own) if o], y[own])
    text = np.array([text_features(r[0], telling) for r in rows])
    meta = np.array([meta_features(*r[1:4]) for r in rows])
    return replace(co_train(text, meta, y, pool=pool(telling)), telling=telling)


def score(docs: DataFrame, model: QualityModel, threshold: float = 0.5) -> DataFrame:
    """All columns of `docs` with `quality_score` (0 to 1) and `keep` (score >= threshold), over whole texts.

    Null texts count as empty, null metadata as values of their own; columns of
    those names are replaced; rows are kept one for one, repeated ones score alike,
    and an empty table gives none.
    """
    docs = docs.drop("quality_score", "keep")

    def run(it):
        for batch in it:
            if not batch.num_rows:
                continue
            texts, metas = _columns(batch)
            text, meta = np.array([text_features(t, model.telling) for t in texts]), meta_rows(np.array([meta_bins(*m) for m in metas]))
            s = model.score(text, meta)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array(s >= threshold)], [*batch.schema.names, "quality_score", "keep"])
        release()

    schema = T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType()), T.StructField("keep", T.BooleanType())])
    return docs.mapInArrow(run, schema)
