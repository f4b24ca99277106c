"""What the operators share: flat views of Arrow text, word and window fingerprints, shared storage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
U64 = np.uint64
#: Odd multiplier of the window polynomial.
STEP = U64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- storage


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only where a local session names none, a local one is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, so lost executors cost no recomputation."""
    spark = df.sparkSession
    df.write.option("compression", "zstd").parquet(path := new_path(spark, name))
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


# ---------------------------------------------------------------- memory

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns freed memory that this process's allocators keep to the system.

    A Python worker goes from one operator's tasks to the next's; what the allocators keep of one would add to the next."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


# ---------------------------------------------------------------- Arrow


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets into them; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n or texts.buffers()[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    offs = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Runs of documents of up to most bytes; a longer document is a run of its own."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def each_slice(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20):
    """(batch slice, bytes, offsets) for runs of documents of bounded size."""
    give_back()
    for batch in batches:
        buf, offs = flat(batch.column(batch.schema.get_field_index(column)))
        for i, j in slices(offs, most):
            yield batch.slice(i, j - i), buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
    give_back()


# ---------------------------------------------------------------- words


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word `[^\\x20\\x09-\\x0D]+`; a word never crosses documents."""
    n = len(buf)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    word = ~SPACE[buf]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    after[-1], after[:-1] = False, word[1:]
    start = np.flatnonzero(word & (cut[:-1] | ~before))
    end = np.flatnonzero(word & (cut[1:] | ~after)) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit fingerprints of byte spans, eight bytes at a time over all spans at once."""
    size = (end - start).astype(np.int64)
    out = mix(size.astype(U64) + U64(seed * 0x632BE59BD9B4E019 % 2**64 + 1))
    if not len(size):
        return out
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(buf) + 1, "<u8", padded.data, strides=(1,))
    at, rest, idx = start.astype(np.int64), size, None
    while True:
        part = eight[at]
        keep = np.minimum(rest, 8).astype(U64) * U64(8)
        part = np.where(keep == 64, part, part & ((U64(1) << (keep & U64(63))) - U64(1)))
        if idx is None:
            out = mix((out ^ part) * STEP)
            more = np.flatnonzero(rest > 8)
            idx = more
        else:
            out[idx] = mix((out[idx] ^ part) * STEP)
            more = np.flatnonzero(rest > 8)
            idx = idx[more]
        if not len(idx):
            return out
        at, rest = at[more] + 8, rest[more] - 8


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of the k consecutive items from each place (len(h) - k + 1 of them), by doubling: no powers to invert."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, have, cur, size, power = None, 0, h, 1, STEP
    while True:
        if k & size:
            if out is None:
                out, have = cur, size
            else:
                m = len(h) - have - size + 1
                out = out[:m] * power + cur[have : have + m]
                have += size
        if size * 2 > k:
            break
        m = len(h) - 2 * size + 1
        cur = cur[:m] * power + cur[size : size + m]
        power = U64(int(power) ** 2 % 2**64)
        size *= 2
    return mix(out[:n])


# ---------------------------------------------------------------- ranks


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str = "rank", buckets: int = 64, also: DataFrame | None = None) -> DataFrame:
    """Adds each row's rank from 0 among the rows with equal keys, in the order of (bucket of order's hash, order).

    A hot key is split into buckets, each ranked on its own and shifted by the count of the buckets before it; only
    (key, bucket) counts meet. Rows equal in keys and order get different ranks in an order that does not matter,
    as long as df is stored: it is read twice. also has one row a key; its further columns come along, by way of the
    counts, so rows of a hot key meet in no join of their own."""
    from pyspark.sql import Window as W

    split = df.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = split.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__b").alias("__kb"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    extra = [c for c in also.columns if c not in keys] if also is not None else []
    if also is not None:
        also = also.select(*[F.col(k).alias(f"__a{i}") for i, k in enumerate(keys)], *extra)
        counts = counts.join(also, _equal("__k", "__a", len(keys)), "left").drop(*[f"__a{i}" for i in range(len(keys))])
    split = split.withColumn("__r", F.row_number().over(W.partitionBy(*keys, "__b").orderBy(*order)) - 1)
    on = F.col("__b") == F.col("__kb")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return split.join(counts, on).select(*df.columns, *extra, (F.col("__before") + F.col("__r")).cast("long").alias(name))


def _equal(left: str, right: str, n: int):
    on = F.col(f"{left}0").eqNullSafe(F.col(f"{right}0"))
    for i in range(1, n):
        on = on & F.col(f"{left}{i}").eqNullSafe(F.col(f"{right}{i}"))
    return on
