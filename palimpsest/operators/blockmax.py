"""The best lexical hits of each query, without scoring every document that has one of its words.

Documents are dealt to ranges by a hash. What a range has of a term is a block: the places of its documents and how
often each has the term; the most that it can add to one of them is the block's worth. A range answers all queries by itself: it adds up the
blocks of a query's strongest terms, drops the documents that can't reach the query's floor even with the most that the
other blocks add, and opens those blocks only where documents are left. So a range sends the best few of each query, and
no table of queries and documents comes about.

Some ranges go first, with no floor. The k-th best that they have of a query is the floor of the others: what is below
it isn't among the k best of all. Statistics are the whole corpus's, and the result is that of scoring everything.

A stored index grows by turns. A turn adds ranges for the documents that are new or have a new wording, and notes which
documents are gone (deleted, or in an old wording): these stay in their blocks, where they can only make a bound too
high, but are never found, and counts leave them out. So a turn writes as much as has changed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from palimpsest.functions.words import RangeScores, invert
from palimpsest.operators import bm25
from palimpsest.sources.scratch import delete, exists, scratch_path

RANGE = 1024  # documents of a range, about
WIDER = 4  # times so many where there would be more than RANGES ranges: a term then is fewer blocks
RANGES = 256
FIRST = 8  # one of so many ranges goes first, where there are so many
TIES = 1e-5  # share of a floor down to which documents are kept: equal scores differ in their last digits
QUERIES = 2048  # queries that get the scores of a range together
LONG = 64  # terms of a query from which a range adds up all its blocks at once: skipping them costs more
MANY = 256  # queries from which a range adds up the blocks of all of them, also of short ones
CHUNK = 64  # queries whose scores a range holds at once
TERMS = 2_000_000  # terms of queries that go to the ranges together; more queries go in several turns
_BLOCKS = "range long, term string, places array<int>, tf array<int>"
TURNS = 64  # turns of growth after which the index is written anew, as small turns leave small ranges


@dataclass(frozen=True)
class BlockIndex:
    """blocks (range, term, places, tf), members (range, place, key, dl, stamp, live), terms (term, df), and counts.

    Of the documents that are live: df of terms, n documents, their mean length. Of all: gone documents, ranges, turns.
    """

    blocks: DataFrame
    members: DataFrame
    terms: DataFrame
    n: int
    avgdl: float
    ranges: int
    gone: int
    turns: int


def write(docs: DataFrame, key: str, text: str, path: str, size: int = RANGE) -> None:
    """Writes the blocks of documents (key, text), each key once, in the place of what was at `path`."""
    delete(docs.sparkSession, path)
    _write_turn(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), path, size, 0, 0)


def _packed(key: pa.DataType):
    """Of the documents of one range (range, key, text, stamp): a row for each term with its places and counts, and one without a term that lists the documents by place."""

    def run(docs: pa.Table) -> pa.Table:
        docs = docs.take(pc.sort_indices(docs.column("key")))
        number, at, places, tf, lengths = invert(docs.column("text").to_pylist())
        at, n, m = at.astype(np.int32), len(number), docs.num_rows
        rows = lambda values: pa.concat_arrays([pa.ListArray.from_arrays(pa.array(at), values), pa.nulls(1, pa.list_(values.type))])
        all_ = lambda values: pa.concat_arrays([pa.nulls(n, pa.list_(values.type)), pa.ListArray.from_arrays(pa.array([0, m], pa.int32()), values)])
        keys, stamps = docs.column("key").combine_chunks().cast(key), docs.column("stamp").combine_chunks()
        cols = {"range": pa.array([docs.column("range")[0].as_py()] * (n + 1), pa.int64()), "term": pa.array([*number, None], pa.string()), "places": rows(pa.array(places)), "tf": rows(pa.array(tf))}
        return pa.table(cols | {"keys": all_(keys), "stamps": all_(stamps), "lengths": all_(pa.array(lengths, pa.int64()))})

    return run


def flags(rows: DataFrame, flag: Column) -> DataFrame:
    """(range, flags): of each range what `flag` says of its documents, by place. For all members of the ranges: places have no gaps."""
    by = rows.groupBy("range").agg(F.array_sort(F.collect_list(F.struct("place", flag.alias("f")))).alias("_f"))
    return by.select("range", F.transform("_f", lambda x: x["f"]).alias("flags"))


def counts_of(blocks: DataFrame, flags: DataFrame) -> DataFrame:
    """(term, tf, df, most) over the documents that are flagged: blocks meet the flags of their range, so no posting is a row."""
    own = F.filter(F.arrays_zip("places", "tf"), lambda p: F.get("flags", p["places"]))
    x = blocks.join(flags, "range").select("term", F.transform(own, lambda p: p["tf"]).alias("_t")).where(F.size("_t") > 0)
    total = F.aggregate("_t", F.lit(0).cast("long"), lambda a, t: a + t)
    return x.groupBy("term").agg(F.sum(total).alias("tf"), F.sum(F.size("_t")).alias("df"), F.max(F.array_max("_t")).alias("most"))


def _write_turn(d: DataFrame, path: str, size: int, turn: int, start: int, index: BlockIndex | None = None, gone: DataFrame | None = None) -> None:
    """Adds documents (key, text) in ranges from `start` on, and takes the `gone` (range, place) of `index` out of the counts.

    The texts are dealt to their ranges, the one shuffle: a task counts the words of
    one range after the other, so its memory is that of a range, whatever it is dealt. A
    common term is many blocks, each of one range, so no row and no task holds a
    term's postings. The members come last: a turn without them doesn't count, and
    the next attempt writes over it.
    """
    spark = d.sparkSession
    at = lambda name: f"{path}/{name}/turn={turn}"
    n = d.count()
    ranges = max(1, -(-n // min(WIDER * size, max(size, n // RANGES))))
    placed = d.select((F.pmod(F.xxhash64("key"), F.lit(ranges)) + F.lit(start)).alias("range"), "key", "text", bm25.stamp_of("text"))
    kind = d.schema["key"].dataType
    packed = placed.groupBy("range").applyInArrow(_packed(to_arrow_type(kind)), f"{_BLOCKS}, keys array<{kind.simpleString()}>, stamps array<long>, lengths array<long>")
    packed.write.mode("overwrite").option("compression", "zstd").parquet(at("blocks"))
    both = spark.read.schema(packed.schema).parquet(at("blocks"))
    blocks = both.where("term is not null")
    terms = blocks.groupBy("term").agg(F.sum(F.size("places")).alias("df"))
    lost = d.select(F.lit(0).cast("long").alias("range"), F.lit(0).alias("place")).limit(0)
    if gone is not None:
        gone.write.mode("overwrite").parquet(at("gone"))
        lost = spark.read.parquet(at("gone"))
        here = index.members.join(lost.select("range").distinct(), "range", "left_semi").join(lost.withColumn("_lost", F.lit(True)), ["range", "place"], "left")
        less = counts_of(index.blocks, flags(here, F.col("_lost").isNotNull())).select("term", (-F.col("df")).alias("df"))
        terms = terms.unionByName(less).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
    else:
        lost.write.mode("overwrite").parquet(at("gone"))
    terms.write.mode("overwrite").parquet(at("terms"))
    one = both.where("term is null").select("range", F.posexplode(F.arrays_zip("keys", "stamps", "lengths")).alias("place", "m"))
    one.select("range", "place", F.col("m.keys").alias("key"), F.col("m.lengths").alias("dl"), F.col("m.stamps").alias("stamp")).write.mode("overwrite").parquet(at("members"))


def _turns(spark: SparkSession, path: str) -> int:
    """How many turns are whole."""
    turn = 0
    while exists(spark, f"{path}/members/turn={turn}/_SUCCESS"):
        turn += 1
    return turn


def read(spark: SparkSession, path: str) -> BlockIndex:
    turns = _turns(spark, path)
    blocks = spark.read.schema(f"{_BLOCKS}, turn int").parquet(f"{path}/blocks").where((F.col("turn") < turns) & F.col("term").isNotNull()).drop("turn")
    members, terms, gone = (spark.read.parquet(f"{path}/{x}").where(F.col("turn") < turns).drop("turn") for x in ("members", "terms", "gone"))
    members = members.join(gone.withColumn("_gone", F.lit(True)), ["range", "place"], "left").withColumn("live", F.col("_gone").isNull()).drop("_gone")
    terms = terms.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0") if turns > 1 else terms
    n, avgdl, ranges, dead = members.agg(F.count_if("live"), F.avg(F.when(F.col("live"), F.col("dl"))), F.max("range"), F.count_if(~F.col("live"))).first()
    return BlockIndex(blocks, members, terms, n, avgdl or 1.0, 0 if ranges is None else ranges + 1, dead, turns)


def stored(docs: DataFrame, key: str, text: str, path: str, size: int = RANGE) -> BlockIndex:
    """The index at `path`, brought to these documents in their present wording.

    Documents are compared by key and a stamp of their text, so one that changed is
    a gone and a new one. Where the index is missing, where most of its documents
    would be gone, and after TURNS turns, it is written anew. One writer at a time.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), bm25.stamp_of(text))
    if not _turns(spark, path):
        write(d, "key", "text", path, size)
        return read(spark, path)
    index = read(spark, path)
    same = F.col("a.key").eqNullSafe(F.col("b.key")) & (F.col("a.stamp") == F.col("b.stamp"))
    live = index.members.where("live")
    new = d.alias("a").join(live.select("key", "stamp").alias("b"), same, "left_anti").select("a.key", "a.text")
    gone = live.alias("a").join(d.select("key", "stamp").alias("b"), same, "left_anti").select("a.range", "a.place")
    n_gone = gone.count()
    if not n_gone and new.isEmpty():
        return index
    if index.turns >= TURNS or index.gone + n_gone > index.n - n_gone:
        write(d, "key", "text", path, size)
    else:
        _write_turn(new, path, size, index.turns, index.ranges, index, gone if n_gone else None)
    return read(spark, path)


def weighted(index: BlockIndex, terms: DataFrame) -> DataFrame:
    """(query, term, idf) of the terms of queries that the corpus has."""
    idf = F.log(1 + (F.lit(index.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return index.terms.join(terms, "term").select("query", "term", idf.alias("idf"))


@dataclass(frozen=True)
class Asked:
    """Queries as numbers of their terms, so that millions of them are small: query i has terms[at[i] : at[i + 1]] of the words, each with its idf."""

    names: list[str]
    at: np.ndarray
    terms: np.ndarray
    words: pa.Array
    idf: np.ndarray

    @cached_property
    def number(self) -> dict[str, int]:
        return {w: i for i, w in enumerate(self.words.to_numpy(zero_copy_only=False).tolist())}  # once for all ranges of a task

    def places(self, words: pa.ChunkedArray) -> np.ndarray:
        """Which of `words` each word is, -1 where it isn't there."""
        out, get = np.full(len(self.words), -1), self.number.get
        found = np.array([get(w, -1) for w in words.to_numpy().tolist()], np.int64)
        here = np.flatnonzero(found >= 0)
        out[found[here]] = here
        return out

    def only(self, chosen: np.ndarray) -> Asked:
        """These of the queries."""
        size = np.diff(self.at)[chosen]
        take = np.repeat(self.at[chosen] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return Asked([self.names[i] for i in chosen.tolist()], np.r_[0, np.cumsum(size)], self.terms[take], self.words, self.idf)

    def scores(self, words: pa.ChunkedArray, at: np.ndarray, places: np.ndarray, gains: np.ndarray, n: int) -> RangeScores:
        """Of all queries over the blocks of a range, block i being of words[i]."""
        return RangeScores(at, places, gains, n, (self.at, self.places(words)[self.terms], self.idf[self.terms]))


def asked(weighted: DataFrame) -> Asked:
    """The queries of weighted terms (query, term, idf), fetched as columns."""
    t = weighted.select("query", "term", "idf").toArrow()
    q, w = (t.column(c).combine_chunks().dictionary_encode() for c in ("query", "term"))
    of, terms, idf = q.indices.to_numpy(), w.indices.to_numpy(), np.zeros(len(w.dictionary))
    idf[terms] = t.column("idf").to_numpy()
    return Asked(q.dictionary.to_pylist(), np.r_[0, np.cumsum(np.bincount(of, minlength=len(q.dictionary)))], terms[np.argsort(of, kind="stable")], w.dictionary, idf)


def best_of_range(blocks: dict[str, tuple[np.ndarray, np.ndarray, float]], wanted: np.ndarray, terms: list[tuple[str, float]], floor: float, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, scores, blocks opened) of the k best of a range, and of those that tie with the last, none below the floor.

    `wanted` marks the places that count, `terms` are (term, idf) of one query.
    """
    here = sorted(((idf * b[2], idf, b) for t, idf in terms if (b := blocks.get(t)) is not None), key=lambda x: -x[0])
    rest, score, opened = sum(x[0] for x in here), np.zeros(len(wanted)), 0
    alive = None  # all, until what is left can't bring a document to the floor by itself
    for most, idf, (places, gains, _) in here:
        if rest < floor:
            alive = np.flatnonzero(wanted & (score + rest >= floor)) if alive is None else alive[score[alive] + rest >= floor]
            if not len(alive):
                return alive, score[alive], opened
        score[places] += idf * gains
        opened += 1
        rest -= most
    found = np.flatnonzero(wanted & (score > 0) & (score >= floor)) if alive is None else alive[(score[alive] > 0) & (score[alive] >= floor)]
    if len(found) > k:
        found = found[score[found] >= np.partition(score[found], -k)[-k] * (1 - TIES)]
    return found, score[found], opened


def opened(blocks: pa.Table, length: np.ndarray, avgdl: float) -> tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray]:
    """(number of each term, at, places, gains) of the blocks of a range, `length` being its documents' by place."""
    listed = blocks.column("places").combine_chunks()
    p, tf = listed.flatten().to_numpy(), blocks.column("tf").combine_chunks().flatten().to_numpy()
    gains = tf * (bm25.K1 + 1) / (tf + bm25.K1 * (1 - bm25.B + bm25.B * length[p] / avgdl))
    return {t: i for i, t in enumerate(blocks.column("term").to_numpy().tolist())}, np.r_[0, np.cumsum(listed.value_lengths().to_numpy())], p, gains


_HITS = "query string, range long, place int, score double, opened int, blocks int"


def _best_of_rows(score: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k best of each row, and of those that tie with the last, none below the floor of its row."""
    passed = (score > 0) & (score >= floors[:, None])
    over = np.flatnonzero(passed.sum(1) > k)
    if len(over):
        last = np.partition(np.where(passed[over], score[over], 0.0), -k, axis=1)[:, -k]
        passed[over] &= score[over] >= last[:, None] * (1 - TIES)
    return np.nonzero(passed)


def _answer(queries: Asked, floors: dict[str, float], k: int, avgdl: float):
    sizes = np.diff(queries.at)
    alone = np.flatnonzero(sizes <= LONG) if len(sizes) < MANY else np.zeros(0, np.int64)
    short = {i: [(queries.words[int(t)].as_py(), float(queries.idf[t])) for t in queries.terms[queries.at[i] : queries.at[i + 1]]] for i in alone.tolist()}
    together = np.setdiff1d(np.arange(len(sizes)), alone)
    rest, least = queries.only(together), np.array([floors.get(q, 0.0) for q in queries.names])
    names, kinds = pa.array(queries.names, pa.string()), [pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]

    def run(blocks: pa.Table, members: pa.Table) -> pa.Table:
        found: list[tuple] = []  # columns (query, place, score, opened)
        if blocks.num_rows and members.num_rows:
            o = members.column("place").to_numpy().argsort()
            length, wanted = members.column("dl").to_numpy()[o], members.column("wanted").to_numpy()[o]
            number, at, p, gains = opened(blocks, length, avgdl)
            if short:
                most = np.maximum.reduceat(gains, at[:-1])
                own = {t: (p[at[i] : at[i + 1]], gains[at[i] : at[i + 1]], float(most[i])) for t, i in number.items()}
                for i, terms in short.items():
                    x, score, n = best_of_range(own, wanted, terms, least[i], k)
                    found.append((np.full(len(x), i), x, score, np.full(len(x), n)))
            if len(together):
                scores = rest.scores(blocks.column("term"), at, p, gains, len(wanted))
                for first in range(0, len(together), CHUNK):
                    mine = together[first : first + CHUNK]
                    score, n = scores.of(first, first + len(mine))
                    score *= wanted
                    q, x = _best_of_rows(score, least[mine], k)
                    found.append((mine[q], x, score[q, x], n[q]))
        q, x, score, n = (np.concatenate(c) for c in zip(*found)) if found else [np.zeros(0, np.int64)] * 4
        here = np.full(len(q), blocks.column("range")[0].as_py() if len(q) else 0)
        cols = [names.take(pa.array(q)), here, x, score, n, sizes[q]]
        return pa.table({h.split(" ")[0]: c if isinstance(c, pa.Array) else pa.array(c).cast(t) for h, c, t in zip(_HITS.split(", "), cols, kinds)})

    return run


def _kept(hits: DataFrame, k: int) -> DataFrame:
    """The k best of each query, and what ties with the last."""
    by = W.partitionBy("query").orderBy(F.desc("score"), "range", "place")
    last = F.max(F.when(F.col("_r") == k, F.col("score"))).over(W.partitionBy("query"))
    return hits.withColumn("_r", F.row_number().over(by)).withColumn("_k", F.coalesce(last, F.lit(0.0))).where(F.col("score") >= F.col("_k") * (1 - TIES)).drop("_r", "_k")


def _stored(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "best")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hits(index: BlockIndex, terms: DataFrame, k: int, scope: DataFrame | None = None) -> DataFrame:
    """Rows (query, range, place, score, opened, blocks) that hold the k best documents of each query; see best."""
    w = _stored(weighted(index, terms))
    n, members, done = w.count(), index.members.withColumn("wanted", F.col("live")), None
    if scope is not None:
        inside = scope.select("key").distinct().withColumn("_in", F.lit(True))
        members = index.members.join(inside, "key", "left").withColumn("wanted", F.col("live") & F.coalesce("_in", F.lit(False)))
    turns = -(-n // TERMS)
    for turn in range(turns):
        mine = w.where(F.pmod(F.xxhash64("query"), F.lit(turns)) == turn)
        queries = asked(mine)  # the texts of queries, TERMS of their words at a time
        said = index.blocks.join(F.broadcast(mine.select("term").distinct()), "term", "left_semi")  # TERMS words at most, and blocks stay where they are

        def ask(which: Column, floors: dict[str, float]) -> DataFrame:
            own = members.where(which).select("range", "place", "dl", "wanted")
            return _stored(said.where(which).groupBy("range").cogroup(own.groupBy("range")).applyInArrow(_answer(queries, floors, k, index.avgdl), _HITS))  # noqa: B023

        first = F.col("range") % FIRST == 0
        if index.ranges < FIRST:
            got = ask(F.lit(True), {})
        else:
            got = ask(first, {})
            kth = _kept(got, k).groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
            got = got.unionByName(ask(~first, {r.query: r.floor * (1 - TIES) for r in kth.collect()}))
        done = got if done is None else done.unionByName(got)
    return done if done is not None else index.blocks.sparkSession.createDataFrame([], _HITS)


def _all_scores(queries: Asked, avgdl: float, key: pa.DataType):
    names = pa.array(queries.names, pa.string())

    def run(blocks: pa.Table, members: pa.Table) -> pa.Table:
        out = [pa.table({"query": names[:0], "key": pa.array([], key), "score": pa.array([], pa.float64())})]
        if blocks.num_rows and members.num_rows:
            members = members.take(pc.sort_indices(members.column("place")))
            _, at, p, gains = opened(blocks, members.column("dl").to_numpy(), avgdl)
            scores = queries.scores(blocks.column("term"), at, p, gains, members.num_rows)
            live, keys = members.column("live").to_numpy(), members.column("key").combine_chunks().cast(key)
            for first in range(0, len(names), CHUNK):
                score, _ = scores.of(first, min(first + CHUNK, len(names)))
                q, x = np.nonzero((score > 0) & live)
                out.append(pa.table({"query": names.take(pa.array(first + q)), "key": keys.take(pa.array(x)), "score": pa.array(score[q, x])}))
        return pa.concat_tables(out)

    return run


def scores(index: BlockIndex, terms: DataFrame) -> DataFrame:
    """(query, key, score) of all documents that have a term of a query: each range gives its own, so pairs never move.

    The words of the queries go to every task, in turns of a bounded number of words
    and queries.
    """
    w = _stored(weighted(index, terms))
    n, of = w.agg(F.count(F.lit(1)), F.count_distinct("query")).first()
    turns, out = max(1, -(-n // TERMS), -(-of // QUERIES)), None
    kind = index.members.schema["key"].dataType
    members = index.members.select("range", "place", "key", "dl", "live")
    for turn in range(turns):
        mine = w.where(F.pmod(F.xxhash64("query"), F.lit(turns)) == turn)
        queries = asked(mine)
        said = index.blocks.join(F.broadcast(mine.select("term").distinct()), "term", "left_semi")  # TERMS words at most, and blocks stay where they are
        part = said.groupBy("range").cogroup(members.groupBy("range")).applyInArrow(_all_scores(queries, index.avgdl, to_arrow_type(kind)), f"query string, key {kind.simpleString()}, score double")
        out = part if out is None else out.unionByName(part)
    return out


def best(index: BlockIndex, terms: DataFrame, k: int = 10, scope: DataFrame | None = None) -> DataFrame:
    """(query, key, score): of each query the k best documents, and all that tie with the last of them.

    terms (query, term), distinct. With `scope` (key) only its documents count, while
    the statistics stay the corpus's. Queries without hits have no rows. The words of
    the queries go to every task, in turns of a bounded number.
    """
    found = _kept(hits(index, terms, k, scope), k)
    return found.join(index.members.select("range", "place", "key"), ["range", "place"]).select("query", "key", "score")
