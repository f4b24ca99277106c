"""Questions that chunks of documents put to shards of a key space, and the answers' way back.

A chunk is a few megabytes of whole documents, stored once in buckets, so later passes read it where it lies and no text
is shuffled. A pass sends each chunk's *distinct* keys to shards as packed arrays, a shard sees the keys of all chunks
together, and its answer is one array per chunk in the order of the keys sent. A key that a third of all rows hold
arrives at its shard once per chunk, so no key makes a task large.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, flat, give_back, new_path, partitions

#: Bytes of text in a chunk: a task holds some 25 times as much in arrays over its words.
CHUNK = 8 << 20
MESSAGE = "shard int, chunk long, body binary"
ARROW_MESSAGE = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("body", pa.binary())])


class Chunk:
    """One chunk's documents: ids, flags, bytes and offsets, and further columns as strings."""

    def __init__(self, number: int, ids: np.ndarray, flags: np.ndarray, texts: pa.Array, extra: list[pa.Array]):
        self.number, self.ids, self.flags, self.extra = number, ids, flags, extra
        self.buf, self.offs = flat(texts)


def dealt(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, pa.Table]]:
    """Runs of rows with about size bytes of text, each with a number that no other task gives."""
    give_back()
    number, held, have = TaskContext.get().partitionId() << 32, [], 0
    for b in batches:
        _, offs = flat(b.column(b.schema.get_field_index("text")))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + size - have, "right")) - 1)
            j = min(j, b.num_rows)
            held.append(b.slice(i, j - i))
            have += int(offs[j] - offs[i])
            i = j
            if have >= 0.75 * size:
                yield number, pa.Table.from_batches(held).combine_chunks()
                number, held, have = number + 1, [], 0
    if held:
        yield number, pa.Table.from_batches(held).combine_chunks()


class Bucketed:
    """Rows in buckets by chunk in the shared folder, so that cogroups by chunk read them where they lie."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.name = df.sparkSession, f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
        self.path = new_path(self.spark, name)
        df.write.option("path", self.path).option("compression", "zstd").bucketBy(partitions(self.spark), "chunk").saveAsTable(self.name)
        self.table = self.spark.table(self.name)

    def drop(self) -> None:
        """Deletes rows that a later stored table has made superfluous."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class Chunks:
    """Documents (id long, text, flag boolean, and extra columns as strings) in chunks of about size bytes, in the shared folder."""

    def __init__(self, docs: DataFrame, size: int = CHUNK, extra: list[str] | None = None):
        self.spark = spark = docs.sparkSession
        more = [f"x{i}" for i in range(len(extra or []))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for number, t in dealt(batches, size):
                n = pa.array([0, len(t)], pa.int32())
                one = lambda c: pa.ListArray.from_arrays(n, t[c].combine_chunks())
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), one("id"), one("flag"), one("text"), *map(one, more)], names=["chunk", "ids", "flags", "texts", *more])

        chunked = docs.select("id", "flag", F.col("text").cast("string").alias("text"), *[F.col(c).cast("string").alias(n) for c, n in zip(extra or [], more)])
        chunked = chunked.mapInArrow(run, "chunk long, ids array<long>, flags array<boolean>, texts array<string>" + "".join(f", {n} array<string>" for n in more))
        self.table = Bucketed(chunked, "chunks").table
        self.count = self.table.count()

    def send(self, ask: Callable[[Chunk], Iterator[tuple[int, bytes]]]) -> DataFrame:
        """(shard, chunk, body) rows of what ask yields for each chunk."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            give_back()
            for b in batches:
                for i in range(b.num_rows):
                    yield from messages(b.column("chunk")[i].as_py(), ask(chunk_at(b, i)))

        return self.table.mapInArrow(run, MESSAGE)

    def receive(self, answers: DataFrame, use: Callable[[Chunk, list[tuple[int, bytes]]], Iterator[pa.RecordBatch]], schema: str, arrow: pa.Schema) -> DataFrame:
        """What use yields for each chunk and its answers (shard, body), by shard."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            give_back()
            if not len(left):
                return arrow.empty_table()
            batch = left.combine_chunks().to_batches()[0]
            got = sorted(zip(right["shard"].to_pylist(), right["body"].to_pylist()))
            return pa.Table.from_batches(list(use(chunk_at(batch, 0), got)), schema=arrow)

        return self.table.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def chunk_at(b: pa.RecordBatch, i: int) -> Chunk:
    ids, flags, texts = (b.column(b.schema.get_field_index(c)).slice(i, 1).flatten() for c in ("ids", "flags", "texts"))
    extra = [b.column(k).slice(i, 1).flatten() for k, n in enumerate(b.schema.names) if n[0] == "x"]
    return Chunk(b.column(b.schema.get_field_index("chunk"))[i].as_py(), ids.to_numpy(), flags.to_numpy(zero_copy_only=False).astype(bool), texts, extra)


def messages(chunk: int, parts: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for shard, body in parts:
        held.append((shard, body))
        size += len(body)
        if size > 4 << 20:
            yield _batch(chunk, held)
            held, size = [], 0
    if held:
        yield _batch(chunk, held)


def _batch(chunk: int, held: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([s for s, _ in held], pa.int32()), pa.array([chunk] * len(held), pa.int64()), pa.array([b for _, b in held], pa.binary())], schema=ARROW_MESSAGE)


def shard_count(spark: SparkSession, chunks: int, each: int) -> int:
    """Shards for so many chunks: one for each `each` of them, and no fewer than tasks of a shuffle."""
    return max(partitions(spark), -(-chunks // each))


def solve(sent: DataFrame, answer: Callable[[list[bytes]], tuple[list[bytes], bytes | None]]) -> DataFrame:
    """Each shard's answers: answer gets the bodies of all chunks and returns one body for each, in the same order, and
    perhaps one more about the shard, which gets chunk -1. A shard's messages are held at once, so the number of shards must
    grow with the input (shard_count), whatever the number of shuffle partitions; a task has one shard at a time."""

    def run(table: pa.Table) -> pa.Table:
        give_back()
        order = pa.array(np.argsort(table["chunk"].to_numpy(), kind="stable"))
        bodies, about = answer(table["body"].take(order).to_pylist())
        chunks = table["chunk"].take(order).to_pylist() + [-1] * (about is not None)
        bodies = bodies + ([about] if about is not None else [])
        return pa.table([pa.array([table["shard"][0].as_py()] * len(chunks), pa.int32()), pa.array(chunks, pa.int64()), pa.array(bodies, pa.binary())], schema=ARROW_MESSAGE)

    return sent.groupBy("shard").applyInArrow(run, MESSAGE)


def shards_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key; a shard is a range of keys."""
    return ((keys >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


def runs(shard: np.ndarray) -> dict[int, slice]:
    """Where each shard's rows lie among rows in the order of shards; shards without rows are left out."""
    if not len(shard):
        return {}
    first = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
    return {k: slice(i, j) for k, i, j in zip(shard[first].tolist(), first.tolist(), [*first[1:].tolist(), len(shard)])}


def freed(spark) -> None:
    """Lets Spark drop the shuffle files of frames that are no longer held."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
