"""The corpus pipeline over `documents`: STAGES in order, each over all that its predecessor kept.

toxicity drops the documents that the classifier rejects; the n-gram join keeps
the smallest id of each group of near-duplicates; suffix dedup removes repeated
passages; mixing repeats documents to the target weights in a random order; BPE
encodes what is left and checks the way back.

All stages: `docs` has the columns of documents, of which any may be null; columns
beyond these are dropped, whatever their names. An empty table gives an empty one.
Rows without an id, and rows that share one, are documents of their own. A null text
counts as empty and stays null. Texts are read whole, whatever their length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import bpe, mixing, ngram_join, suffix_dedup, toxicity
from palimpsest.llm.common import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5 by a model fitted on a bounded sample of `labels`.

    A score depends on the text alone, so repeated rows go or stay together; null and
    empty texts have the score of a text without features. Without labels of both kinds
    nothing is known, and a score of 0.5 or the labels' only kind decides for all.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model, 0.5).where("toxic_predicted = 0").select(*COLUMNS)


def _row_keys(docs: DataFrame) -> DataFrame:
    """`docs` with doc_id a key of the row, and the document's own id as _id.

    Where ids repeat or are null, rows are numbered in order of their ids (nulls
    last), then texts: so each is a document of its own. Otherwise the id is the key.
    """
    docs = docs.select(*COLUMNS)
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return docs.withColumn("_id", F.col("doc_id"))
    ordered = docs.orderBy(F.col("doc_id").asc_nulls_last(), *[c for c in COLUMNS if c != "doc_id"])
    return materialize(ordered.withColumn("_id", F.col("doc_id")).withColumn("doc_id", F.monotonically_increasing_id()))


def _own_ids(docs: DataFrame) -> DataFrame:
    return docs.withColumn("doc_id", F.col("_id")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group that links connect; a row is a document, also without an id or with another's.

    Of rows with one id, and of rows without, the first by their texts stands for
    equal ones. Empty and null texts are linked with nothing: all of them stay.
    """
    docs = _row_keys(docs)
    keep = ngram_join.ngram_join(docs).where("doc_id = component_id").select("doc_id")
    return _own_ids(docs.join(keep, "doc_id", "left_semi"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeated 100-byte strings; a character that lost a byte goes, n_chars is counted anew.

    What stands before a removed run and what stands after it never make a character together. Rows without an id or
    with another's stay, as documents of their own. Of equal strings the first by id keeps its bytes; a document of which
    nothing is left stays with an empty text. Texts without repeats, null ones too, and their n_chars are left as they are.
    """
    out = suffix_dedup.suffix_dedup(_row_keys(docs))
    whole = F.size("spans") == 0
    text = F.when(whole, F.col("text")).otherwise(F.decode(_whole_characters("kept", F.col("spans")["start"], F.col("spans")["end"]), "utf-8"))
    out = out.withColumn("text", text)
    return _own_ids(out.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text"))))


@F.pandas_udf(T.BinaryType())
def _whole_characters(kept, starts, ends):
    def one(b, s, e):
        s, n = np.array(s, np.int64), np.array(e, np.int64) - np.array(s, np.int64)
        cuts = (s - np.cumsum(n) + n).tolist()
        return b"".join(bytes(b[i:j]).decode("utf-8", "ignore").encode() for i, j in zip([0, *cuts], [*cuts, len(b)]))

    return pd.Series([one(*x) for x in zip(kept, starts, ends)], dtype=object)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of each document by a draw that its id seeds, with the mean that its source's weight asks for, in the order of a hash.

    A null source is a source of its own. Rows that share an id, and those without one, share a draw.
    """
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_tokens, decodes: the tokens of each copy, and whether they decode to its text.

    One row a row; null and empty texts have no tokens and decode.
    """
    coded = bpe.encode_decode(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "utf-8")
    return coded.select("doc_id", "source", "ids", "n_tokens", same.alias("decodes"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("bpe", encode),
]

ORACLE_SQL = None  # trained scores, links and token ids are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
