"""Registered queries: each operator over whole tables. `oracle` has the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.functions.envelope import extract_envelope
from palimpsest.functions.noise import prompt_input
from palimpsest.functions.vectors import dot, normalize
from palimpsest.operators import blockmax, bm25, chain, details, evaluate, golden, grouping, maintain, memory, nearest, search, sessions, toolsearch
from palimpsest.plans import catalog as C
from palimpsest.plans import parts
from palimpsest.sources import embed, shards
from palimpsest.sources import rounds as stored
from palimpsest.sources.scratch import scratch_path
from palimpsest.streaming.rounds import store_stream, stream_rounds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def long(c: Column | str) -> Column:
    return X.col(c).cast("long")


# -- lexical ---------------------------------------------------------------


@query
def bm25_tokens(s, d):
    t = C.documents(s, d).select("doc_id", bm25.bm25_tokens("text").alias("t"))
    return t.select("doc_id", long(F.size("t")).alias("n_tokens"), long(F.size(F.array_distinct("t"))).alias("n_terms"), F.md5(F.array_join("t", " ")).alias("digest"))


@query
def bm25_term_freq(s, d):
    return bm25.postings(C.documents(s, d), "doc_id", "text").groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"), F.max("tf").alias("most"))


@query
def bm25_doc_stats(s, d):
    return bm25.corpus_stats(bm25.doc_lengths(C.documents(s, d), "doc_id", "text")).select("n", r6("avgdl").alias("avgdl"))


_blocks: dict[tuple[str, str], str] = {}


def _block_index(s, d) -> blockmax.BlockIndex:
    """The session's stored blocks of the documents, which the first search writes."""
    path = _blocks.setdefault((s.sparkContext.applicationId, d), scratch_path(s, "blocks"))
    return blockmax.stored(C.documents(s, d), "round_file", "text", path)


def _best_hits(s, d, scope: DataFrame | None = None) -> DataFrame:
    """The benchmark's texts and the ten best documents of each, with those that tie: what the top five and the scale need."""
    terms = bm25.query_terms(C.text_queries(s, d), "query", "text")
    return blockmax.best(_block_index(s, d), terms, scope=scope).withColumnRenamed("key", "round_file")


def _scores(s, d):
    x = blockmax.scores(_block_index(s, d), bm25.query_terms(C.text_queries(s, d), "query", "text"))
    return x.withColumnRenamed("key", "round_file")


@query
def bm25_score_unstored(s, d):
    """Scores of the benchmark's texts in one scan of the documents, without an index."""
    x = bm25.score(C.documents(s, d), "round_file", "text", C.text_queries(s, d), "query", "text")
    return x.select("query", "round_file", r6("score").alias("score"))


@query
def lexical_growth(s, d):
    """What the blocks say of each term after three turns: documents in an older wording and some since deleted, then the missing ones as well, then all as they are."""
    docs, path = C.documents(s, d).select("round_file", "text", "doc_id"), scratch_path(s, "blocks")
    older = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("an older wording "), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    before = docs.withColumn("text", older).unionByName(docs.where("doc_id % 11 = 0").withColumn("round_file", F.concat(F.lit("deleted-"), "round_file")))
    for turn in (before.where("doc_id % 7 <> 0"), before, docs):
        index = blockmax.stored(turn, "round_file", "text", path)
    said = blockmax.counts_of(index.blocks, blockmax.flags(index.members, F.col("live"))).select("term", "tf", "most")
    counts = F.lit(index.turns).cast("long").alias("turns"), F.lit(index.n).cast("long").alias("n"), F.round(F.lit(index.avgdl), 6).alias("avgdl")
    return index.terms.join(said, "term").select("term", "tf", "df", long("most").alias("most"), *counts)


@query
def lexical_freshness(s, d):
    """A stored index is read while it has exactly the documents of the store; with one more or one less it is written anew."""
    docs, path = C.documents(s, d).select("round_file", "text"), scratch_path(s, "lexical")
    before = bm25.read_index(s, path, docs)
    bm25.write_index(docs, "round_file", "text", path)
    more = docs.unionByName(s.createDataFrame([("new", "one more text")], "round_file string, text string"))
    states = [("unwritten", before), ("same", bm25.read_index(s, path, docs)), ("added", bm25.read_index(s, path, more)), ("removed", bm25.read_index(s, path, docs.where("round_file <> '0'")))]
    lengths = bm25.stored_index(more, "round_file", "text", path)[1].agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("tokens"))
    return s.createDataFrame([(k, v is not None) for k, v in states], "state string, fresh boolean").join(F.broadcast(lengths))


@query
def bm25_score(s, d):
    return _scores(s, d).select("query", "round_file", r6("score").alias("score"))


@query
def bm25_normalized(s, d):
    scales = bm25.scale(_best_hits(s, d), "query")
    return bm25.normalize(_scores(s, d), "query", F.broadcast(scales)).select("query", "round_file", r6("normalized").alias("normalized"))


@query
def text_match_top5(s, d):
    x = bm25.normalize(_best_hits(s, d), "query").select("query", "round_file", r6("normalized").alias("score"))
    return search.top(x, 5, 0.25)


@query
def text_match_scoped(s, d):
    """The scope (German documents) holds before the scale is taken, but never changes corpus statistics."""
    scope = C.documents(s, d).where("lang = 'de'").select(F.col("round_file").alias("key"))
    x = bm25.normalize(_best_hits(s, d, scope), "query").select("query", "round_file", r6("normalized").alias("score"))
    return search.top(x, 5, 0.25)


@query
def golden_token_counts(s, d):
    t = C.documents(s, d).select("doc_id", X.golden_tokens("text").alias("t"))
    return t.select("doc_id", long(F.size("t")).alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query
def lexical_overlap(s, d):
    """Keyword channel: each query's twelve documents with most of its words."""
    q = C.text_queries(s, d).select("query", F.col("text").alias("prompt"))
    docs = C.documents(s, d).select("round_file", "text")
    x = golden.keyword_channel(q, docs)
    return x.select("query", "round_file", long("score").alias("score"), long("rank").alias("rank"))


# -- vectors ---------------------------------------------------------------


@query
def vector_normalize(s, d):
    """Components scaled by the label (0 gives the zero vector), then brought to unit length."""
    v = C.vectors(s, d).select("vec_id", normalize(F.transform("vector", lambda x: x * F.col("label"))).alias("v"))
    return v.select("vec_id", r6(F.sqrt(dot(F.col("v"), F.col("v")))).alias("norm"), r6(F.get("v", F.lit(0))).alias("first"))


@query
def vector_topk(s, d):
    rows = nearest.nearest(C.vectors(s, d).select(F.col("vec_id").alias("round_file"), "vector"), C.vector_queries(s, d), 12)
    x = search.best_per_round(rows).select("query", "round_file", r6("score").alias("score"))
    return search.top(x, 12).select("query", F.col("round_file").alias("vec_id"), "score", "rank")


@query
def vector_best_per_round(s, d):
    x = nearest.every(C.vectors(s, d), C.vector_queries(s, d))
    return x.select("query", "round_file", r6("score").alias("score"))


def _model_queries(s, d):
    """Each query under two of the three models; the third has no query vector and drops out."""
    q = C.vector_queries(s, d)
    return q.withColumn("model", F.lit("base")).unionByName(q.withColumn("model", F.lit("m1")).withColumn("vector", F.reverse("vector")))


@query
def multi_model_search(s, d):
    x = search.best_per_round(nearest.nearest(C.vectors(s, d), _model_queries(s, d), 5, "base"))
    return search.top(x.select("query", "round_file", r6("score").alias("score")), 5, 0.25)


def _hybrid(s, d, k: int, alpha: float = 0.7):
    """Rows with each query's k best rounds. Queries of the vector set with the text of the document of the same id; a document is the round of its number."""
    q = C.vector_queries(s, d)
    texts = C.documents(s, d).select(F.col("round_file").alias("query"), "text").join(F.broadcast(q.select("query")), "query")  # their vectors go to the driver anyway
    rows = nearest.hybrid(_block_index(s, d), C.vectors(s, d), q, bm25.query_terms(texts, "query", "text"), k, alpha)
    return search.best_per_round(rows)


@query
def hybrid_search(s, d):
    x = _hybrid(s, d, 5).select("query", "round_file", r6("score").alias("score"))
    return search.top(x, 5, 0.25)


@query
def hybrid_no_lexical(s, d):
    """Without a lexical hit the semantic score counts alone, even at alpha 0: the rounds have no texts."""
    none = blockmax.stored(s.createDataFrame([], "round_file string, text string"), "round_file", "text", scratch_path(s, "blocks"))
    x = search.best_per_round(nearest.hybrid(none, C.vectors(s, d), C.vector_queries(s, d), none.terms.select(F.col("term").alias("query"), "term"), 5, 0.0))
    return search.top(x.select("query", "round_file", r6("score").alias("score")), 5)


# -- budgets ---------------------------------------------------------------


@query
def context_budget(s, d):
    x = C.vectors(s, d).select("vec_id", F.abs(F.get("vector", F.lit(0)) * 3).alias("best"))
    return x.select("vec_id", long(search.context_budget(F.col("best"))).alias("budget"), long(search.context_budget(F.col("best"), window=20_000)).alias("small_window"))


@query
def context_select(s, d):
    """The relevance list of each query: entries rendered with their rank, charged to a budget from the best score."""
    path = scratch_path(s, "ranked")
    search.top(_hybrid(s, d, 20).withColumn("score", r6("score")), 20).write.parquet(path)
    ranked = s.read.parquet(path)
    listed = F.broadcast(ranked.select("round_file").distinct())  # 20 names a query at most, whose vectors go to the driver anyway
    texts = C.documents(s, d).select("round_file", "text").join(listed, "round_file", "left_semi")
    x = ranked.join(texts, "round_file", "left").withColumn("text", F.coalesce("text", F.lit("")))
    best = x.groupBy("query").agg(F.max("score").alias("best")).select("query", (search.context_budget(F.col("best"), window=30_000) / 4).alias("budget"))
    entry = X.relevance_entry(F.col("rank"), F.col("round_file"), F.lit(0.5), F.lit("0 tools"), "text")
    kept = search.select_in_budget(x.join(best, "query"), X.token_estimate(entry), "budget", least=0.05)
    return kept.select("query", "round_file", "rank", long("cost").alias("cost"), long("used").alias("used"))


@query
def recency_list_select(s, d):
    """Each user's newest events under a budget; topics are event types; a topic's header costs 5."""
    e = C.event_rounds(s, d).select(F.col("user_id").alias("session"), F.struct("ts", "event_id").alias("pos"), F.col("event_type").alias("topic"), "event_id", "value")
    x = search.select_recent(e, F.ceil("value"), F.lit(5), budget=200, reserved=20)
    return x.select("session", "event_id", long("index").alias("index"), long("group_no").alias("group_no"), long("used").alias("used"))


@query
def prompt_truncate(s, d):
    t = C.documents(s, d).select("doc_id", X.truncate_prompt("text").alias("t"))
    return t.select("doc_id", long(F.length("t")).alias("n"), F.md5("t").alias("digest"), long(X.token_estimate("t")).alias("tokens"))


# -- sessions --------------------------------------------------------------


def _rounds(s, d):
    return sessions.rounds_of(C.messages(s, d), "session", "pos")


@query
def sessionize_rounds(s, d):
    r = _rounds(s, d)
    return r.select("session", "turn_index", "round_file", long(F.length("userPrompt")).alias("prompt_chars"), long(F.length("responseSequence")).alias("response_chars"), "n_messages", "needsFollowup")


@query
def round_content_hash(s, d):
    return _rounds(s, d).select("round_file", F.md5(X.duplicate_key("userPrompt", "responseSequence")).alias("key_digest"))


@query
def round_parent_lag(s, d):
    return sessions.with_parent(_rounds(s, d)).select("session", "turn_index", "parentId")


@query
def response_end_lead(s, d):
    return _rounds(s, d).select("session", "turn_index", "userTimestamp", "responseEndTimestamp")


@query
def prompt_only_rounds(s, d):
    return _rounds(s, d).where(sessions.is_prompt_only()).select("session", "turn_index", "round_file")


@query
def related_parent(s, d):
    """The event before of the same user and type."""
    e = C.event_rounds(s, d).select(F.col("user_id").alias("session"), F.struct("ts", "event_id").alias("turn_index"), "round_file", F.col("event_type").alias("topic"), "event_id")
    return sessions.with_related_parent(e).select("event_id", "relatedParentId")


@query
def word_count_short(s, d):
    return C.documents(s, d).select("doc_id", long(X.word_count("text")).alias("words"), X.is_short("text").alias("short"), F.md5(X.first_words("text")).alias("first_words"))


@query
def topic_grouping(s, d):
    """Vectors in sessions of one label, in the order of their ids; a low threshold, as the vectors are spread."""
    v = C.vectors(s, d).select(F.col("label").alias("session"), F.col("vec_id").alias("pos"), "vector", F.lit(None).cast("int").alias("forced"))
    return grouping.topics(v, 0.3)


# -- tools -----------------------------------------------------------------


def _tool_rows(s, d):
    e = C.event_rounds(s, d)
    calls = F.array(F.struct(F.lit(0).alias("index"), F.col("event_type").alias("name"), F.concat(F.lit('{"tool": "'), F.col("event_type"), F.lit('", "args": ["User '), F.col("user_id").cast("string"), F.lit('", '), F.col("props"), F.lit("]}")).alias("arguments")))
    return toolsearch.tool_rows(e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("round_file"), calls.alias("toolCalls")))


@query
def tool_index_rows(s, d):
    return _tool_rows(s, d).groupBy("round_file", "tool_name", "searchable").agg(F.count(F.lit(1)).alias("n"))


@query
def tool_search(s, d):
    q = s.createDataFrame([("a", "click user error"), ("b", "View view purchase"), ("c", " ")], "query string, text string")
    x = toolsearch.search_tools(_tool_rows(s, d), q)
    return x.select("query", "round_file", "matched", long("total").alias("total"), r6("score").alias("score"), F.array_join(F.transform("tools", lambda t: t["name"]), ",").alias("tools"))


@query
def tool_summary(s, d):
    """Each user's calls by name, in the order of the name's first call, with the bytes of their results."""
    e = C.event_rounds(s, d)
    call = F.struct("ts", "event_id", F.col("event_type").alias("name"), F.lit("").alias("arguments"), F.col("props").alias("result_full"), F.lit("").alias("result_summary"))
    by = e.groupBy("user_id").agg(F.array_sort(F.collect_list(call)).alias("calls"))
    return by.select("user_id", X.tool_summary("calls", F.size("calls")).alias("summary"))


# -- evaluation ------------------------------------------------------------


def _rated(s, d):
    """Vectors as rounds in time (their id); queries every hundredth; what has the same label is relevant."""
    v = C.vectors(s, d).select(F.col("vec_id").cast("string").alias("round_file"), "vec_id", "vector", "label")
    q = v.where("vec_id % 100 = 0").select(F.col("round_file").alias("query"), F.col("vec_id").alias("ts"), "vector", "label")
    ranked = evaluate.rank_as_of(q.drop("label"), v.select("round_file", "vector"), v.select("round_file", F.col("vec_id").alias("ts")), 5)
    labels = q.select("query", "label", "ts").join(v.select(F.col("round_file").alias("_r"), F.col("label").alias("_l"), "vec_id"), (F.col("label") == F.col("_l")) & (F.col("vec_id") < F.col("ts")))
    return q, ranked, labels.select("query", F.col("_r").alias("label"))


@query
def asof_candidates(s, d):
    """How many earlier events of its user each event could be answered from."""
    e = C.event_rounds(s, d).select(F.col("round_file").alias("query"), "ts", "user_id")
    return evaluate.earlier_counts(e, "user_id").where("n > 0").select("query", "n")


@query
def eval_hit_recall_mrr(s, d):
    _, ranked, labels = _rated(s, d)
    m = evaluate.query_metrics(labels, ranked)
    return m.select("query", "n_labels", "hit", r6("recall").alias("recall"), r6("mrr").alias("mrr"), "first_hit_rank")


@query
def eval_macro(s, d):
    q, ranked, labels = _rated(s, d)
    m = evaluate.macro_mean(evaluate.query_metrics(labels, ranked), q)
    return m.select("query_count", "empty_label_count", *[r6(c).alias(c) for c in ("hit_at_5", "recall_at_5", "mrr")])


@query
def eval_golden(s, d):
    """Golden labels: the newest label is the primary one where the query's label is even."""
    q, ranked, labels = _rated(s, d)
    x = labels.join(q.select("query", F.col("label").alias("_l")), "query")
    newest = F.row_number().over(W.partitionBy("query").orderBy(F.desc(F.col("label").cast("long")))) == 1
    x = x.select("query", "label", F.col("label").cast("long").alias("pos"), (newest & (F.col("_l") % 2 == 0)).alias("is_primary"), F.when(F.col("_l") % 3 == 0, "similarity").otherwise("hybrid").alias("mode"))
    m = evaluate.golden_metrics(x, ranked)
    return m.select("mode", "query_count", *[r6(c).alias(c) for c in ("hit_at_5", "recall_at_5", "mrr")])


@query
def eval_skip_counts(s, d):
    """Documents as rounds: embeddings exist under even ids, times for texts in English, labels where `labels` has them."""
    docs = C.documents(s, d).join(C.table(s, d, "labels").select("doc_id", F.lit(True).alias("_l")), "doc_id", "left")
    ts = F.when(F.col("lang") == "en", F.col("doc_id"))
    return evaluate.skip_counts(docs, evaluate.skip_reason("text", F.col("doc_id") % 2 == 0, ts, F.col("_l").isNotNull()))


def _positions(s, d):
    """Of each user the five newest events were presented; those of value over 10 were read."""
    newest = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    e = C.event_rounds(s, d).withColumn("position", newest).where("position <= 5")
    return e.groupBy("position").agg(F.count(F.lit(1)).alias("presentedCount"), F.count_if(F.col("value") > 10).alias("readCount"))


@query
def noise_rate(s, d):
    return evaluate.noise_rate(_positions(s, d)).select(r6("noise_rate").alias("noise_rate"))


@query
def chain_read_positions(s, d):
    p = _positions(s, d)
    return p.select(long("position").alias("position"), "presentedCount", "readCount", long(F.floor(100 * F.col("readCount") / F.col("presentedCount") + 0.5)).alias("percent"))


@query
def stats_upgrade(s, d):
    """Version 1 statistics (from each customer's balance) read as version 2, broken ones as empty."""
    c = C.table(s, d, "customer")
    n = F.floor(F.abs("c_acctbal")).cast("string")
    old = F.concat(F.lit('{"version":1,"position5":{"presentedCount":'), n, F.lit(',"readCount":2}}'))
    x = stored.read_stats(c.select(F.when(F.col("c_custkey") % 7 == 0, "{broken").otherwise(old).alias("value")))
    return x.select(F.col("version"), F.element_at("positionScores", 5)["presentedCount"].alias("presented"), F.element_at("positionScores", 5)["readCount"].alias("read")).groupBy("version", "presented", "read").agg(F.count(F.lit(1)).alias("n"))


# -- pools -----------------------------------------------------------------


@query
def difficulty_classify(s, d):
    p = C.table(s, d, "pages").select("page_id", F.concat(F.lit("see "), F.regexp_extract("url", r"^[a-z]+://[^/]*/?([^?#]*)", 1)).alias("prompt"), F.nullif(F.col("page_id") % 5, F.lit(0)).alias("rank"))
    return p.select("page_id", X.is_path_query("prompt").alias("is_path"), X.difficulty("prompt", "rank").alias("difficulty"))


def _pool(s, d):
    """Channels: nearest vectors, keyword matches (document ids), and the query's neighbours in id."""
    top = vector_topk(s, d).select("query", F.lit(1).alias("channel"), "rank", F.col("vec_id").cast("string").alias("round_file"))
    words = lexical_overlap(s, d).select("query", F.lit(2).alias("channel"), "rank", "round_file")
    near = C.vector_queries(s, d).select("query", F.lit(3).alias("channel"), F.posexplode(F.array(*[(F.col("query").cast("long") + k).cast("string") for k in (1, 2, 3)])).alias("rank", "round_file"))
    near = near.select("query", "channel", F.col("rank") + 1, "round_file")
    return golden.interleave(top.union(words).union(near))


@query
def round_robin_pool(s, d):
    return _pool(s, d).select("query", "round_file", long("position").alias("position"))


@query
def seeded_pool(s, d):
    return golden.shuffle_pool(_pool(s, d), 1)


# -- shards and maintenance ------------------------------------------------


def _doubled(s, d):
    """The vector rows, and a second host's copy of those whose id is divisible by five."""
    v = C.vectors(s, d).select("vec_id", "round_file", "suffix", "model", "shard", "pos")
    return v.unionByName(v.where("vec_id % 5 = 0").withColumn("shard", F.lit("index.a")))


@query
def shard_merge_dedupe(s, d):
    return shards.merge_rows(_doubled(s, d)).select("vec_id", "round_file", "suffix", "model", "shard")


@query
def shard_corrupt_skip(s, d):
    """Rows written as text lines and parsed back; those with label 7 are broken on the way."""
    v = C.vectors(s, d)
    stamp = F.when(F.col("suffix") == ":prompt", X.input_stamp(F.col("vec_id").cast("string")))
    line = shards.format_line(F.col("vector"), F.concat("round_file", F.lit(".json"), "suffix"), F.coalesce("model", F.when(stamp.isNotNull(), F.lit("base"))), stamp)
    lines = v.select(F.when(F.col("label") == 7, F.concat(F.lit("!"), line)).otherwise(line).alias("line"), "shard", F.col("pos").alias("line_no"))
    x = shards.parse_lines(lines)
    return x.select(F.col("pos").alias("vec_id"), "ok", F.when(F.col("ok"), F.col("round_file")).alias("round_file"), F.when(F.col("ok"), F.col("suffix")).alias("suffix"), F.when(F.col("ok"), F.col("model")).alias("model"), F.when(F.col("ok"), F.col("input_hash")).alias("input_hash"), r6(F.get("vector", F.lit(0))).alias("first"))


@query
def shard_summary(s, d):
    x = maintain.shard_summary(_doubled(s, d), "index.h1")
    return x.select("shard", "n_rows", long(F.size("rounds")).alias("n_rounds"), F.md5(F.array_join("rounds", ",")).alias("digest"))


@query
def shard_names(s, d):
    """Which names of a folder are shards: names made from nations with each ending."""
    ends = ["", ".lock", ".tmp.1", ".bak.2", ".json", ".fulltext.csv"]
    heads = ["index.", "index.bm25.", "index-tools.", "other."]
    n = C.table(s, d, "nation").select(F.lower(F.translate("n_name", " #", "__")).alias("n"))
    x = n.select(F.explode(F.array(*[F.concat(F.lit(h), F.col("n"), F.lit(e)) for h in heads for e in ends])).alias("name"))
    return x.select("name", shards.is_shard(F.col("name")).alias("is_shard"))


def _vector_rounds(s, d):
    """Rounds of the vector rows; the prompt is the text of the document of the same number, if there is one."""
    docs = C.documents(s, d).select("round_file", F.col("text").alias("userPrompt"))
    return C.vectors(s, d).select("round_file").distinct().join(docs, "round_file", "left").withColumn("userPrompt", F.coalesce("userPrompt", F.lit("")))


@query
def coverage_classify(s, d):
    return maintain.classify_rounds(_vector_rounds(s, d), C.vectors(s, d), "m1")


@query
def own_shard_stale(s, d):
    return maintain.own_shard_stale(C.vectors(s, d), _vector_rounds(s, d), "index.h1", "m2")


@query
def pending_plan(s, d):
    return maintain.pending(maintain.classify_rounds(_vector_rounds(s, d), C.vectors(s, d), "m1"))


@query
def erase_short(s, d):
    return maintain.erase_short(C.vectors(s, d).select("vec_id", "round_file", "suffix"), _vector_rounds(s, d)).select("vec_id")


@query
def orphan_union(s, d):
    """Rounds are embedded anew: prompt rows are written for every round, response rows are left as they were."""
    old = C.vectors(s, d).select("round_file", "suffix", "model")
    fresh = old.where("suffix = ':prompt'").withColumn("model", F.lit("new"))
    return maintain.reembed(old, fresh)


@query
def indexed_anti_join(s, d):
    """Documents without vector rows."""
    return C.documents(s, d).join(C.vectors(s, d).select("round_file"), "round_file", "left_anti").select("doc_id")


@query
def bag_except(s, d):
    x = _doubled(s, d).select("round_file", "suffix")
    return maintain.concurrent_appends(x, C.vectors(s, d).select("round_file", "suffix"))


def _duplicates(s, d):
    docs = C.documents(s, d)
    key = X.duplicate_key("text", F.lit(""))
    return docs.select(F.md5(key).alias("key"), F.col("round_file").alias("filename"), (F.col("doc_id") % 2 == 1).alias("recovered"), F.col("doc_id").alias("mtime"))


@query
def duplicate_keeper(s, d):
    return maintain.duplicate_plan(_duplicates(s, d), 0).select("keeper", "filename")


@query
def foreign_guard(s, d):
    return maintain.foreign_guard(maintain.duplicate_plan(_duplicates(s, d), 0), C.vectors(s, d), "index.h1").select("keeper", "filename")


def _marked(s, d):
    """Rounds of conversations under their names, and copies that kept a follow-up mark, under another name."""
    r = _rounds(s, d).select("session", "turn_index", "round_file", "userPrompt", "responseSequence").dropDuplicates(["round_file"])
    own = r.where("turn_index <> 2").withColumn("needsFollowup", F.col("turn_index") == 0)
    marked = r.withColumn("responseSequence", F.concat("responseSequence", F.lit(X.FOLLOWUP_MARKER))).withColumn("round_file", F.concat(F.lit("m"), "round_file")).withColumn("needsFollowup", F.lit(True))
    return own.unionByName(marked)


@query
def marker_twin(s, d):
    return maintain.marker_twins(_marked(s, d))


@query
def stale_content(s, d):
    x = maintain.stale_content(_marked(s, d).withColumn("responseSequence", X.strip_followup("responseSequence")))
    return x.select("target", F.array_join("files", ",").alias("files"))


@query
def hash_migration(s, d):
    r = _marked(s, d).withColumn("responseSequence", X.strip_followup("responseSequence"))
    plan, _ = maintain.content_hash_migration(r, r.select("round_file"))
    return plan


@query
def input_stamps(s, d):
    """Stamps of the documents' texts as embedding inputs, and how rows with another document's stamp classify."""
    docs = C.documents(s, d)
    stamp = X.input_stamp("text")
    rows = docs.select("round_file", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("assumed-"), stamp)).when(F.col("doc_id") % 3 == 1, stamp).alias("input_hash"))
    rounds = docs.select("round_file", stamp.alias("current_hash"), (F.col("doc_id") % 2 == 0).alias("has_vec_hash"))
    return maintain.input_staleness(rows, rounds).join(rounds, "round_file").select("round_file", "reason", "current_hash")


@query
def working_memory(s, d):
    e = C.event_rounds(s, d).select(F.col("user_id").alias("session"), F.struct("ts", "event_id").alias("pos"), "event_id")
    return memory.kept_slots(e).select("session", long("id").alias("id"), "event_id")


# -- chains ----------------------------------------------------------------


def _parents(s, d):
    """Each event's parent is the event before of its user."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return C.event_rounds(s, d).select("round_file", F.lag("round_file").over(w).alias("parentId"), "value", "event_id")


@query
def parent_chain_recursive(s, d):
    """The whole chain of every event."""
    r = _parents(s, d)
    return chain.walk_chain(r.select(F.col("round_file").alias("target")), r).select("target", long("depth").alias("depth"), "round_file")


@query
def origin_posterior(s, d):
    """What the whole chain of every event tells of where a fault began."""
    r = _parents(s, d).withColumn("fault", F.least(F.lit(1.0), F.col("value") / 100))
    x = chain.origin_profiles(r.select(F.col("round_file").alias("target")), r)
    return x.select("target", r6("p_outside").alias("p_outside"), r6("entropy").alias("entropy"), "top", r6("p_last").alias("p_last"))


@query
def flag_rule(s, d):
    e = C.event_rounds(s, d)
    return e.select("event_id", chain.flag(F.col("value") / 10, F.col("event_id") % 10 / 10).alias("flagged"))


@query
def fault_bins(s, d):
    e = C.event_rounds(s, d)
    verdict = F.get(F.array(*[F.lit(v) for v in ("no_fault_within_round", "external", "ambiguous", "fault_observed", "fault_kind_not_observed")]), (F.col("event_id") % 5).cast("int"))
    b = chain.verdict_bin(F.when(F.col("event_id") % 11 == 0, F.col("event_type")), verdict, F.when(F.col("event_id") % 2 == 0, F.col("event_type")))
    best = chain.best_type(F.create_map(F.lit("x"), F.col("value"), F.lit("y"), F.lit(10.0)))
    return e.select(b.alias("bin"), best.alias("best")).groupBy("bin", "best").agg(F.count(F.lit(1)).alias("n"))


# -- text ------------------------------------------------------------------


@query
def noise_clean(s, d):
    t = C.documents(s, d).select("doc_id", prompt_input(F.col("text")).alias("t"))
    return t.select("doc_id", long(F.length("t")).alias("n"), F.md5("t").alias("digest"))


@query
def envelope_extract(s, d):
    """Conversations as serialized message lists: the last user's words come back."""
    m = C.messages(s, d).groupBy("session").agg(F.to_json(F.array_sort(F.collect_list(F.struct("pos", "role", F.col("text").alias("content"))))).alias("j"))
    x = m.select("session", extract_envelope("j").alias("e"))
    return x.select("session", F.col("e.was_envelope").alias("was_envelope"), F.md5("e.text").alias("digest"))


@query
def excerpts(s, d):
    return C.documents(s, d).select("doc_id", X.excerpt("text").alias("excerpt"), X.size_label(F.octet_length("text")).alias("size"))


@query
def detail_page(s, d):
    x = details.page(C.documents(s, d), "doc_id", "text", 3, 4)
    return x.select("doc_id", F.md5("page").alias("digest"), *[long(c).alias(c) for c in ("first_line", "last_line", "total_lines", "next_line")])


@query
def detail_regex_match(s, d):
    x = details.match_lines(C.documents(s, d), "doc_id", "text", "[Tt]h[aeiou]n", 1, 3)
    return x.select("doc_id", long("match_no").alias("match_no"), long("line_no").alias("line_no"), F.md5("context").alias("digest"), long("shown").alias("shown"), long("total").alias("total"))


@query
def message_sizes(s, d):
    """Tokens of each conversation's messages, and the warning level they reach against 400 tokens."""
    m = C.messages(s, d).where("role <> 'system'").groupBy("session").agg(F.sum(X.token_estimate("text")).alias("tokens"))
    return m.select("session", long("tokens").alias("tokens"), long(X.size_warning("tokens", 400)).alias("level"))


@query
def segment_rebuild(s, d):
    """Segments of rounds that lack them, and the text they render to."""
    calls = F.when(F.col("turn_index") % 2 == 1, F.array(F.struct(F.lit(0).alias("index")), F.struct(F.lit(1).alias("index"))))
    r = _rounds(s, d).withColumn("calls", calls).withColumn("segments", X.rebuild_segments("responseSequence", "calls"))
    return r.select("round_file", long(F.size("segments")).alias("n"), F.md5(X.segments_text("round_file", "segments", "responseSequence")).alias("digest")).distinct()


@query
def embed_stub(s, d):
    """Rows that an embedding of each round would write, under the offline stand-in."""
    r = _rounds(s, d)
    rows = maintain.embed_rows(r, prompt_input(F.col("userPrompt")), X.response_input("responseSequence"))
    x = embed.embed_texts(rows, "text", "stub")
    moment = F.aggregate(F.transform("vector", lambda v, i: v * i), F.lit(0.0), lambda a, b: a + b)
    return x.select("round_file", "suffix", dot(F.col("vector"), F.col("vector")).alias("norm2"), moment.alias("moment"))


@query
def session_stream_backfill(s, d):
    """Closed rounds from a stream over the log, run to what is there now and stored; the last of a session stays open."""
    name = f"{d}/conversations.parquet"
    log = s.readStream.schema(s.read.parquet(name).schema).parquet(name + "*")
    log = log.select(F.col("conv_id").alias("session"), F.col("turn").alias("pos"), "role", "text")
    out = scratch_path(s, "rounds")
    store_stream(stream_rounds(log), out, scratch_path(s, "progress")).awaitTermination()
    return s.read.parquet(out).drop("batch").withColumn("turn_index", long("turn_index")).withColumn("n_messages", long("n_messages"))


QUERIES |= parts.QUERIES
