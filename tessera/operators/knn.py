"""Exact and approximate nearest neighbours over a DataFrame of vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..errors import EngineError, invalid
from ..functions.vectors import below, block, distance, metric_name, paired, vector

#: Queries that are broadcast at once, and in a block when there are more; vectors in a block then.
QUERY_BLOCK, VECTOR_BLOCK = 4096, 1 << 16
#: Rows and queries in a tile, components that are gathered at once, and pairs that wait to be merged.
TILE_ROWS, TILE_QUERIES, PAIR_VALUES, MERGE = 2048, 512, 1 << 19, 1 << 14


def top_k(vectors: DataFrame, query: list[float], k: int, metric: str = "l2", where: Column | None = None, id_col: str = "id", vec_col: str = "embedding", kind: str = "double") -> DataFrame:
    """The k nearest rows to one query, by (distance, id), filtered first: one pass and a top-k of partial top-ks."""
    if k < 0:
        raise invalid("k must not be negative")
    rows = vectors if where is None else vectors.where(where)
    d = distance(metric, F.col(vec_col), vector(query, kind), kind)
    rows = rows.where(F.assert_true(F.size(vec_col) == len(query), F.lit("DimensionMismatch")).isNull())
    return rows.withColumn("distance", d).orderBy("distance", id_col).limit(k)


def distance_to(vectors: DataFrame, vec_id: int, query: list[float], metric: str = "l2", id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """The distance of one row; no row if the id is unknown."""
    return vectors.where(F.col(id_col) == vec_id).select(id_col, distance(metric, F.col(vec_col), vector(query)).alias("distance"))


class Nearest:
    """The k first ids of each query (row of q) by (key, id) among the rows that are added.

    The key is the distance, or with like the negated score like * clamp(1 - distance / 2) + bonus. In tiles, one matrix
    product bounds all keys from below; only pairs that can be among the k are computed in full, so results do not depend on
    tiles, and memory is that of a tile and of the k best."""

    def __init__(self, metric: str, q: np.ndarray, k: int, like: float | None = None):
        self.metric, self.q, self.k, self.like = metric, q, k, like
        self.turned = np.ascontiguousarray(q.T)
        self.limit = np.full(len(q), np.inf)  # no key above it is among the k
        self.best = tuple(np.zeros(0, t) for t in (np.int64, np.float64, np.int64, np.float64))
        self.new: list[tuple] = []

    def add(self, ids: np.ndarray, x: np.ndarray, bonus: np.ndarray | None = None, which: np.ndarray | None = None) -> None:
        """Shows rows x to all queries, or to those numbered which."""
        which = np.arange(len(self.q)) if which is None else which
        bonus = np.zeros(len(x)) if bonus is None else bonus
        for a in range(0, len(x), TILE_ROWS):
            for b in range(0, len(which), TILE_QUERIES):
                self._tile(ids[a : a + TILE_ROWS], x[a : a + TILE_ROWS], bonus[a : a + TILE_ROWS], which[b : b + TILE_QUERIES])

    def _key(self, d: np.ndarray, bonus: np.ndarray) -> np.ndarray:
        return d if self.like is None else -(self.like * np.clip(1 - d / 2, 0, 1) + bonus)

    def _exact(self, turned: np.ndarray, bonus: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        step, d = max(1, PAIR_VALUES // max(1, len(turned))), np.zeros(len(row))
        for s in range(0, len(row), step):
            d[s : s + step] = paired(self.metric, turned[:, row[s : s + step]], self.turned[:, at[s : s + step]])
        return self._key(d, bonus[row]), d

    def _tile(self, ids: np.ndarray, x: np.ndarray, bonus: np.ndarray, which: np.ndarray) -> None:
        turned = np.ascontiguousarray(x.T)
        low = self._key(below(self.metric, x, self.q[which]), bonus[:, None])
        if self.like is not None and self.like < 0:
            low[:] = np.nan  # falls with the distance, so there is no bound
        fresh = np.flatnonzero(self.limit[which] == np.inf)
        if len(fresh) and len(x) >= self.k:
            row = np.argpartition(low[:, fresh], self.k - 1, axis=0)[: self.k]
            key = self._exact(turned, bonus, row.ravel(), np.tile(which[fresh], self.k))[0].reshape(row.shape).max(0)
            self.limit[which[fresh]] = np.where(np.isnan(key), np.inf, key)
        near = np.flatnonzero(~(low > self.limit[which]))
        if not len(near):
            return
        row, at = near // len(which), which[near % len(which)]
        key, d = self._exact(turned, bonus, row, at)
        keep = ~(key > self.limit[at])
        self.new.append((at[keep], key[keep], ids[row[keep]], d[keep]))
        if sum(len(n[0]) for n in self.new) > max(MERGE, len(self.best[0])):
            self.found()

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The query's number, key, id and distance of the best pairs so far, by query, key and id."""
        if self.new:
            at, key, ids, d = (np.concatenate(part) for part in zip(self.best, *self.new))
            order = np.lexsort((ids, key, at))
            ordered = at[order]
            place = np.arange(len(at)) - np.searchsorted(ordered, ordered)
            last = order[place == self.k - 1]
            self.limit[at[last]] = np.fmin(self.limit[at[last]], key[last])
            order = order[place < self.k]
            self.best, self.new = (at[order], key[order], ids[order], d[order]), []
        return self.best


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of each row's nearest centre, the first of equals."""
    out = np.zeros(len(x), np.int64)
    for a in range(0, len(x) if len(centres) else 0, TILE_ROWS):
        near = Nearest("l2", x[a : a + TILE_ROWS], 1)
        near.add(np.arange(len(centres)), centres)
        out[a : a + TILE_ROWS] = near.found()[2]
    return out


def _matrix(column: pa.Array, n: int, dims: int | None = None) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if n and (len(x) % n or dims is not None and len(x) != n * dims):
        raise ValueError("DimensionMismatch: vectors and queries differ in their dimensions")
    return x.reshape(n, -1) if n else np.zeros((0, dims or 0))


def batch_top_k(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2", id_col: str = "id", vec_col: str = "embedding", query_id: str = "query_id", query_vec: str = "embedding", like: float | None = None, bonus: Column | None = None) -> DataFrame:
    """query_id, rank, id, distance for the k nearest rows of each query, exactly, or with like and bonus the k rows with the
    highest like * clamp(1 - distance / 2) + bonus, bonus being a Column of vectors.

    Up to QUERY_BLOCK queries are broadcast as one matrix, and vectors are not shuffled: each task leaves its k best a query.
    More queries are cut into blocks by the hash of their ids, vectors too, and each pair of blocks is one matrix product in
    one task, so neither side meets in one place. Null vectors take no part."""
    metric = metric_name(metric)
    if k <= 0:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, id long, distance double")
    asked = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(query_vec).alias("q")).where("q is not null")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), (F.lit(0.0) if bonus is None else bonus).cast("double").alias("bonus")).where("v is not null")
    first = asked.limit(QUERY_BLOCK + 1).collect()
    out = _broadcast_top_k(rows, first, k, metric, like) if len(first) <= QUERY_BLOCK else _blocked_top_k(rows, asked, k, metric, like)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("key", "id"))
    return out.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


BEST = "query_id long, id long, key double, distance double"


def _flat(ids: np.ndarray, near: Nearest | None) -> pa.Table:
    at, key, i, d = near.found() if near else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0))
    return pa.table({"query_id": pa.array(ids[at]), "id": pa.array(i), "key": pa.array(key), "distance": pa.array(d)})


def _broadcast_top_k(rows: DataFrame, asked: list, k: int, metric: str, like: float | None) -> DataFrame:
    if len({len(r["q"]) for r in asked}) > 1:
        raise EngineError("DimensionMismatch", "queries differ in their dimensions")
    ids = np.array([r["query_id"] for r in asked], np.int64)
    sent = rows.sparkSession.sparkContext.broadcast((ids, np.array([r["q"] for r in asked], np.float64).reshape(len(asked), -1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        near = Nearest(metric, q, k, like)
        for b in batches:
            if b.num_rows and len(ids):
                near.add(b.column("id").to_numpy(), _matrix(b.column("v"), b.num_rows, q.shape[1]), b.column("bonus").to_numpy(zero_copy_only=False))
        yield from _flat(ids, near).to_batches()

    return rows.mapInArrow(run, BEST)


def _cut(rows: int, blocks: int, cores: int) -> int:
    """Rows in a block so that tasks of VECTOR_BLOCK rows at most keep the cores busy, each row meeting so many blocks of queries."""
    return min(VECTOR_BLOCK, max(TILE_ROWS, -(-rows * blocks // (2 * cores))))


def _every(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _blocked_top_k(rows: DataFrame, asked: DataFrame, k: int, metric: str, like: float | None) -> DataFrame:
    many, n = max(1, -(-asked.count() // QUERY_BLOCK)), rows.count()
    all_rows = max(1, -(-n // _cut(n, many, rows.sparkSession.sparkContext.defaultParallelism)))
    left = asked.withColumn("i", F.pmod(F.xxhash64("query_id"), F.lit(many)).cast("int")).withColumn("j", _every(all_rows))
    right = rows.withColumn("j", F.pmod(F.xxhash64("id"), F.lit(all_rows)).cast("int")).withColumn("i", _every(many))

    def run(mine: pa.Table, other: pa.Table) -> pa.Table:
        ids, near = mine["query_id"].to_numpy(), None
        if len(mine) and len(other):
            q = _matrix(mine["q"].combine_chunks(), len(mine))
            near = Nearest(metric, q, k, like)
            for a in range(0, len(other), TILE_ROWS):
                some = other.slice(a, TILE_ROWS)
                near.add(some["id"].to_numpy(), _matrix(some["v"].combine_chunks(), len(some), q.shape[1]), some["bonus"].to_numpy())
        return _flat(ids, near)

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(run, BEST)


def centroids(vectors: DataFrame, vec_col: str, lists: int, sample: int = 20_000, rounds: int = 8, id_col: str = "id") -> np.ndarray:
    """List centres by k-means on a bounded sample (by hash order of ids)."""
    rows = vectors.where(F.col(vec_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(sample).select(vec_col).collect()
    x = np.array([r[0] for r in rows], np.float64)
    c = x[:lists].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        for j in range(len(c)):
            mine = x[near == j]
            if len(mine):
                c[j] = mine.mean(0)
    return c


def with_list(vectors: DataFrame, centres: np.ndarray, vec_col: str = "embedding", column: str = "list_id") -> DataFrame:
    """Adds the nearest centre of each row: the partition column of an inverted-file index. Every row gets one."""
    sent = vectors.sparkSession.sparkContext.broadcast(centres)
    names = [*vectors.columns, column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for b in batches:
            x = b.column(b.schema.get_field_index(vec_col)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, c.shape[1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nearest(x, c), pa.int32())], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema) + f", {column} int"
    return vectors.mapInArrow(run, schema)


def _parts(sizes: list[int], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The first part of each list and the number of its parts: neighbouring lists share a part of so many rows, a longer
    list is cut into several."""
    first, cut, at, held = [], [], 0, 0
    for n in sizes:
        if held and held + n > rows:
            at, held = at + 1, 0
        first.append(at)
        cut.append(max(1, -(-n // rows)))
        held += n
        if cut[-1] > 1:
            at, held = at + cut[-1], 0
    return np.array(first, np.int64), np.array(cut, np.int64)


def probed_top_k(indexed: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, probes: int, metric: str = "l2", id_col: str = "id", vec_col: str = "embedding", query_id: str = "query_id") -> DataFrame:
    """Approximate top-k: each query looks into its probes nearest lists. indexed is best stored partitioned by list_id.

    Lists are dealt to parts of bounded rows, queries to blocks; a query goes once to each part that holds a list it probes,
    and there each list meets the block's queries that probe it in matrix products. So no pair of a query and a row is
    shuffled, nor a query once a list."""
    metric, lists, context = metric_name(metric), len(centres), indexed.sparkSession.sparkContext
    if k <= 0 or not lists:
        return indexed.sparkSession.createDataFrame([], "query_id long, rank int, id long, distance double")
    rows = indexed.select("list_id", F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    held = {r["list_id"]: r["n"] for r in rows.groupBy("list_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    asked = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(vec_col).alias("q"))
    many = max(1, -(-asked.count() // QUERY_BLOCK))
    first, cut = _parts([held.get(i, 0) for i in range(lists)], _cut(sum(held.values()), many, context.defaultParallelism))
    sent = context.broadcast((centres, first, cut))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, first, cut = sent.value
        starts = np.flatnonzero(np.diff(first, prepend=-1))
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                b = whole.slice(a, 512)
                q = _matrix(b.column("q"), b.num_rows, c.shape[1])
                mine = np.zeros((b.num_rows, lists), bool)
                np.put_along_axis(mine, np.argsort(block("l2", q, c), axis=1, kind="stable")[:, :probes], True, 1)
                row, part = np.nonzero(np.logical_or.reduceat(mine, starts, axis=1))
                times = np.maximum.reduceat(cut, starts)[part]
                nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                j, row = np.repeat(first[starts][part], times) + nth, pa.array(np.repeat(row, times))
                packed = pa.array([m.tobytes() for m in np.packbits(mine, axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(j, pa.int32()), b.column("i").take(row), b.column("query_id").take(row), b.column("q").take(row), packed.take(row)], names=["j", "i", "query_id", "q", "probed"])

    kind = queries.schema[vec_col].dataType.simpleString()
    asked = asked.withColumn("i", F.pmod(F.xxhash64("query_id"), F.lit(many)).cast("int"))
    left = asked.mapInArrow(probe, f"j int, i int, query_id long, q {kind}, probed binary")
    where = indexed.sparkSession.createDataFrame([(i, int(f), int(n)) for i, (f, n) in enumerate(zip(first, cut))], "list_id int, first int, cut int")
    right = rows.join(F.broadcast(where), "list_id").withColumn("j", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("cut").cast("long"))).cast("int")).drop("first", "cut").withColumn("i", _every(many))

    def run(mine: pa.Table, other: pa.Table) -> pa.Table:
        ids, near = mine["query_id"].to_numpy(), None
        if len(mine) and len(other):
            q = _matrix(mine["q"].combine_chunks(), len(mine))
            probed = np.unpackbits(np.frombuffer(b"".join(mine["probed"].to_pylist()), np.uint8).reshape(len(mine), -1), axis=1)
            near, held, i, v = Nearest(metric, q, k), other["list_id"].to_numpy(), other["id"].to_numpy(), other["v"].combine_chunks()
            order = np.argsort(held, kind="stable")
            for one in np.split(order, np.flatnonzero(np.diff(held[order])) + 1):
                which = np.flatnonzero(probed[:, held[one[0]]])
                for a in range(0, len(one) if len(which) else 0, TILE_ROWS):
                    some = one[a : a + TILE_ROWS]
                    near.add(i[some], _matrix(v.take(pa.array(some)), len(some), q.shape[1]), which=which)
        return _flat(ids, near)

    best = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(run, BEST)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("key", "id"))
    return best.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def recall_at_k(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of exact neighbours that were found."""
    hit = found.select("query_id", "id").withColumn("hit", F.lit(1))
    return exact.select("query_id", "id").join(hit, ["query_id", "id"], "left").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("recall"), F.count(F.lit(1)).alias("pairs"))


def default_lists(rows: int) -> int:
    return max(1, min(4096, int(math.sqrt(max(1, rows)))))
