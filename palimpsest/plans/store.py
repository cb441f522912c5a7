"""The store's facade: search, context, evaluation over the tables of one store."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators import blockmax, bm25, evaluate, maintain, nearest, toolsearch
from palimpsest.operators import search as ranked_search
from palimpsest.sources import embed
from palimpsest.sources.embed import Embedder, hashing_embedder
from palimpsest.sources.scratch import scratch_path


@dataclass
class RetrievalStore:
    """rounds (ROUND columns and round_file), vectors (VECTOR_ROW). All results are lazy tables."""

    spark: SparkSession
    rounds: DataFrame
    vectors: DataFrame
    model: str = "default"
    embedder: Embedder = hashing_embedder
    index_path: str | None = None  # of the stored lexical index; by default a fresh path in the shared folder

    @cached_property
    def texts(self) -> DataFrame:
        return self.rounds.select("round_file", X.round_text("userPrompt", "responseSequence", "toolCallNames", "toolCalls").alias("text"))

    @cached_property
    def tools(self) -> DataFrame:
        return toolsearch.tool_rows(self.rounds)

    @cached_property
    def lexical_index(self) -> tuple[DataFrame, DataFrame]:
        """Postings and lengths of the store's rounds: what is stored if it is fresh, else written anew."""
        return bm25.stored_index(self.texts, "round_file", "text", self.index_path or scratch_path(self.spark, "lexical"))

    @cached_property
    def block_index(self) -> blockmax.BlockIndex:
        """The rounds' texts in blocks, for searches that want the best alone; stored beside the lexical index."""
        path = f"{self.index_path}/by_range" if self.index_path else scratch_path(self.spark, "blocks")
        return blockmax.stored(self.texts, "round_file", "text", path)

    def _scope(self, p: ranked_search.SearchParams) -> DataFrame | None:
        return ranked_search.in_scope(self.rounds.select("round_file"), p.rounds).withColumnRenamed("round_file", "key") if p.rounds else None

    def _text_match(self, queries: DataFrame, p: ranked_search.SearchParams) -> DataFrame:
        """(query, round_file, score, normalized) of each query's best rounds: as many as the scale and the limit need."""
        found = blockmax.best(self.block_index, bm25.query_terms(queries, "query", "text"), max(10, p.limit), self._scope(p))
        return bm25.normalize(found.withColumnRenamed("key", "round_file"), "query")

    def lexical(self, queries: DataFrame) -> DataFrame:
        """(query, round_file, score) over the whole store: a scope never changes the statistics."""
        return bm25.score_index(*self.lexical_index, bm25.query_terms(queries, "query", "text"), "round_file", "query")

    def _query_vectors(self, queries: DataFrame) -> DataFrame:
        """(query, model, vector): every query under every model of the index; models whose embedding fails should raise in the embedder."""
        names = [r[0] for r in ranked_search.models(self.vectors, self.model).collect()]
        one = lambda m: embed.embed_texts(queries, "text", m, self.embedder).select("query", F.lit(m).alias("model"), search_unit("vector"))
        out = one(names[0]) if names else one(self.model)
        for m in names[1:]:
            out = out.union(one(m))
        return out

    def search_batch(self, queries: DataFrame, params: ranked_search.SearchParams = ranked_search.SearchParams()) -> DataFrame:
        """(query, round_file, score, rank, ...) of queries (query, text); mode, scope, threshold and alpha are shared."""
        p = params
        if p.mode == "tool":
            hits = toolsearch.search_tools(ranked_search.in_scope(self.tools, p.rounds), queries)
            return ranked_search.top(hits.join(self.rounds.select("round_file"), "round_file", "left_semi"), p.limit)
        if p.mode == "text-match":
            return ranked_search.top(self._text_match(queries, p).withColumn("score", F.col("normalized")).drop("normalized"), p.limit, p.threshold)
        vectors = ranked_search.in_scope(self.vectors, p.rounds).join(self.rounds.select("round_file"), "round_file", "left_semi")
        if p.mode == "similarity":
            rows = nearest.nearest(vectors, self._query_vectors(queries), p.limit, self.model)
        else:
            terms = bm25.query_terms(queries, "query", "text")
            rows = nearest.hybrid(self.block_index, vectors, self._query_vectors(queries), terms, p.limit, p.alpha, self.model, self._scope(p))
        scores = ranked_search.best_per_round(rows)
        return ranked_search.top(scores, p.limit, p.threshold)

    def search(self, query: str | None, **params) -> DataFrame:
        """The same for one text; no text, no result."""
        p = ranked_search.SearchParams(query=query, **params)
        q = self.spark.createDataFrame([("q", p.query)] if p.query else [], "query string, text string")
        return self.search_batch(q, p).join(self.rounds, "round_file").orderBy("rank")

    def context(self, prompts: DataFrame, window: int = ranked_search.WINDOW, reserved: int = 0) -> DataFrame:
        """Rounds for the relevance list of prompts (query, text): hybrid scores, a budget from the best of them, the prefix that fits."""
        p = ranked_search.SearchParams(mode="hybrid", threshold=-1e9, limit=ranked_search.MAX_ENTRIES)
        ranked = self.search_batch(prompts, p)
        budget = ranked.groupBy("query").agg(ranked_search.context_budget(F.max("score"), window).alias("budget"))
        x = ranked.join(budget, "query").join(self.rounds, "round_file")
        entry = X.relevance_entry(F.col("rank"), F.col("round_file"), F.col("score"), X.tool_summary("toolCalls", "toolCallCount"), "userPrompt")
        return ranked_search.select_in_budget(x, X.token_estimate(entry), "budget", reserved=reserved)

    def evaluate(self, labels: DataFrame, k: int = 5) -> DataFrame:
        """One row of means for labels (query, label), queries being stored rounds with a vector and a time."""
        q = self.rounds.where("promptEmbedding is not null and userTimestamp is not null").select(F.col("round_file").alias("query"), F.col("userTimestamp").alias("ts"), F.col("promptEmbedding").alias("vector"))
        ranked = evaluate.rank_as_of(q, self.vectors, self.rounds.select("round_file", F.col("userTimestamp").alias("ts")), k)
        return evaluate.macro_mean(evaluate.query_metrics(labels, ranked, k), q)

    def ingest(self, parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(new rounds, their vector rows) of parsed logs: what is stored already, also under another name, is left out."""
        new = maintain.missing_rounds(parsed.where("error is null"), self.rounds)
        new = new.where("not (coalesce(responseSequence, '') = '' and coalesce(size(toolCalls), 0) <= 0)").dropDuplicates(["round_file"])
        from palimpsest.functions.noise import prompt_input

        texts = maintain.embed_rows(new, prompt_input(F.col("userPrompt")), X.response_input("responseSequence"))
        stamped = texts.withColumn("input_hash", F.when(F.col("suffix") == ":prompt", X.input_stamp("text")))
        rows = embed.embed_texts(stamped, "text", self.model, self.embedder).withColumn("model", F.lit(self.model))
        return new, rows.withColumn("vector", F.when(F.col("suffix") == ":combined", F.col("vector")).otherwise(search_unit("vector")))


def search_unit(name: str):
    from palimpsest.functions.vectors import normalize

    return normalize(F.col(name)).alias(name)
