"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources.scratch import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_cuts: list[str] = []


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: the lineage ends in files every executor can reach.

    The files stay until drop_cuts, as later tables read them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    _cuts.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_with(df: DataFrame, *metrics: Column) -> tuple[DataFrame, tuple]:
    """materialize, and aggregates of the rows as they are written. A task that ran again may count twice, so they serve for sizes and signs of change."""
    seen = Observation()
    out = materialize(df.observe(seen, *[m.alias(str(i)) for i, m in enumerate(metrics)]))
    return out, tuple(seen.get[str(i)] for i in range(len(metrics)))


def materialize_counted(df: DataFrame) -> tuple[DataFrame, int]:
    out, (n,) = materialize_with(df, F.count(F.lit(1)))
    return out, n


def drop_cuts(spark: SparkSession) -> None:
    """Delete what materialize wrote in this session, once the results that read it are stored."""
    jvm = spark.sparkContext._jvm
    while _cuts:
        path = jvm.org.apache.hadoop.fs.Path(_cuts.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


on_release: list = []  # calls that drop what modules keep between the batches of a task


def trim() -> None:
    """Give freed memory back to the system: a Python worker lives on after its task, beside other stages' workers."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def release() -> None:
    """trim at the end of a task, after what was kept for its batches is dropped."""
    for drop in on_release:
        drop()
    gc.collect()
    trim()


def trimmed(of_group):
    """The function of a group, with a trim when it has returned."""

    def run(table: pa.Table) -> pa.Table:
        out = of_group(table)
        trim()
        return out

    return run


def narrow(df: DataFrame, rows: int, per_task: int = 200_000) -> DataFrame:
    """`df`, which has about so many rows, in as few tasks as they need: with many shuffle partitions, small steps are all overhead."""
    n = max(1, -(-rows // per_task))
    return df.coalesce(n) if n < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def n_buckets(spark: SparkSession, per_partition: int = 4) -> int:
    """Groups to deal blobs into: a multiple of the session's shuffle partitions, so it grows with the job."""
    return per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored_bytes(df: DataFrame) -> int | None:
    """Spark's estimate of what `df` takes, from the sizes of its files; None where it has none."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 56 else None


def sized_buckets(df: DataFrame, per_bytes: int) -> int:
    """Groups to deal what `df` holds into: one for each `per_bytes`, and at least one for each shuffle partition."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-(stored_bytes(df) or 0) // per_bytes))


def one_row_per_id(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows with null keys dropped and each key once.

    Reads only the key column to see whether a key repeats. Where one does, the
    row with the greatest text (nulls smallest) stands for the document.
    """
    docs = docs.where(F.col(key).isNotNull())
    if docs.groupBy(key).count().where("count > 1").isEmpty():
        return docs
    row = F.max_by(F.struct(*[c for c in docs.columns if c != key]), F.coalesce("text", F.lit("")))
    return docs.groupBy(key).agg(row.alias("_row")).select(key, "_row.*").select(*docs.columns)


def batches(texts: pa.ChunkedArray | pa.Array, limit: int = 1 << 18):
    """Slices (first, byte array, offsets) of an Arrow string column, each of about `limit` bytes or one text."""
    arr = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    arr = arr.cast(pa.large_binary()).fill_null(b"")
    n = len(arr)
    if not n:
        return
    _, off, data = arr.buffers()
    off = np.frombuffer(off, np.int64, n + 1, arr.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + limit, "right")) - 1)
        last = min(last, n)
        yield first, data[off[first] : off[last]], off[first : last + 1] - off[first]
        first = last


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finalizer of 64-bit hashes."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def pack(*cols: np.ndarray) -> bytes:
    """Integer columns of one length as byte planes under zstd; 8-byte columns lose planes that are all zero."""
    n = len(cols[0])
    out = [np.array([n, len(cols)], "<u4").tobytes()]
    for c in cols:
        c = np.ascontiguousarray(c)
        planes = c.view(np.uint8).reshape(n, c.dtype.itemsize).T if n else np.zeros((c.dtype.itemsize, 0), np.uint8)
        kept = np.flatnonzero(np.bitwise_or.reduce(c.view(f"u{c.dtype.itemsize}"), keepdims=True).view(np.uint8)).tolist()
        out.append(np.array([ord(c.dtype.kind), c.dtype.itemsize, len(kept), *kept], np.uint8).tobytes())
        out += [planes[i].tobytes() for i in kept]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n, k = (int(x) for x in raw[:8].view("<u4"))
    at, cols = 8, []
    for _ in range(k):
        kind, width, m = chr(raw[at]), int(raw[at + 1]), int(raw[at + 2])
        kept, at = raw[at + 3 : at + 3 + m], at + 3 + m
        c = np.zeros((n, width), np.uint8)
        for i in kept:
            c[:, i] = raw[at : at + n]
            at += n
        cols.append(c.reshape(-1).view(f"{kind}{width}") if n else np.zeros(0, f"{kind}{width}"))
    return cols


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated integer ranges [start, start + length)."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)
