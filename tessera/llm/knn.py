"""Exact top-k search by inner product as a Voronoi join of queries and data."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stored

#: Queries in a group and rows in a block; both bound what one task holds.
GROUP, BLOCK, CELLS = 1024, 8192, 1024
LONG = np.iinfo(np.int64)


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """Rows (id, v) with v = floor(scale * x) of each component; rows with a null id or vector, or a null or non-finite
    component, take no part. Shorter vectors count as padded with zeros."""
    x = F.col(vec_col)
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    ok = F.col(id_col).isNotNull() & x.isNotNull() & whole
    return vectors.where(ok).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double"))).alias("v"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows, padded with zeros to dim."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy()
    out = np.zeros((len(column), dim), np.int64)
    if len(values):
        row = np.repeat(np.arange(len(size)), size)
        out[row, np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    return out


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products, exactly; through floats or 64-bit integers only where those cannot lose a digit. A product,
    or a component, that a long cannot hold is an error."""
    if not q.size or not x.size:
        return q @ x.T
    if max(q.max(), x.max()) == LONG.max or min(q.min(), x.min()) == LONG.min:
        raise ValueError("a quantised component does not fit into 64 bits")
    most = float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1]
    if most < 2.0**53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    if most < 2.0**62:
        return q @ x.T
    exact = q.astype(object) @ x.T.astype(object)
    if exact.max() > LONG.max or exact.min() < LONG.min:
        raise ValueError("an inner product does not fit into 64 bits")
    return exact.astype(np.int64)


def pivots(rows: DataFrame, n: int, dim: int) -> np.ndarray:
    """n vectors by hash order of their ids: a bounded sample that reruns repeat."""
    got = rows.select("v", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(n).select("v").collect()
    return np.unique(np.array([(list(r[0]) + [0] * dim)[:dim] for r in got], np.float64).reshape(len(got), dim), axis=0)


def nearest(x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each row and the distance to it."""
    d = (x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1)[None]
    cell = d.argmin(1)
    return cell, np.sqrt(((x - p[cell]) ** 2).sum(1))


def top_k(vectors: DataFrame, id_col: str, vec_col: str, is_query, k: int = 5, scale: int = 256) -> DataFrame:
    """Each query's k highest integer inner products with all other rows: query_id, rank (from 1), vec_id, score.

    is_query is a Column over "id". Ties go to the smaller id; rows with the query's own id are no candidates; identical
    repeats of a query are one query. The method: queries and data are grouped by nearest pivots. Per cell the driver gets
    a count and a radius (at most CELLS rows each). From those, each query group gets a score that its k-th best surely
    reaches, by r_q.r_x >= p.c - |p| r - |c| u - u r over cells; a row x goes to a group with pivot p and radius u only if
    p.x + u |x| can reach that. Groups and cells are cut into bounded parts, each pair of parts is solved in one task,
    and the parts' best k of each query are ranked. A query visits only cells whose bound can reach its group's score. Vectors
    that are null or hold null or non-finite components, and rows without an id, take no part; a score that a long cannot
    hold is an error. An empty table gives no rows."""
    rows = stored(quantised(vectors, id_col, vec_col, scale), "knn-rows")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d"), F.sum(is_query.cast("long")).alias("q")).first()
    n, dim, q = size["n"] or 0, max(1, size["d"] or 1), size["q"] or 0
    queries = rows.where(is_query).dropDuplicates()
    p_q, p_x = pivots(queries, min(CELLS, max(1, -(-q // GROUP))), dim), pivots(rows, min(CELLS, max(1, -(-n // BLOCK))), dim)
    empty = "query_id long, rank int, vec_id long, score long"
    if not n or not q:
        return rows.sparkSession.createDataFrame([], empty)

    def placed(p: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell, far = nearest(matrix(b.column("v"), dim).astype(np.float64), p)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(cell, pa.int32()), pa.array(far)], names=["id", "v", "cell", "far"])

        return run

    kind = "id long, v array<long>, cell int, far double"
    queries, data = queries.mapInArrow(placed(p_q), kind), rows.mapInArrow(placed(p_x), kind)
    cells = lambda df: {r["cell"]: (r["n"], r["far"]) for r in df.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}
    q_cells, x_cells = cells(queries), cells(data)
    # Rows with a query's id are no candidates of it, however many they are: each group's largest number of those.
    alike = rows.where(is_query).groupBy(F.col("id").alias("own")).agg(F.count(F.lit(1)).alias("n"))
    same = {r["cell"]: r["n"] for r in queries.join(alike, F.col("id") == F.col("own")).groupBy("cell").agg(F.max("n").alias("n")).collect()}

    norm_q, norm_x = np.sqrt((p_q**2).sum(1)), np.sqrt((p_x**2).sum(1))
    need, radius = np.full(len(p_q), np.inf), np.zeros(len(p_q))
    visits: dict[int, list[int]] = {}
    for i, (_, u) in q_cells.items():
        radius[i] = u
        lows = sorted(((p_q[i] @ p_x[j] - norm_q[i] * r - norm_x[j] * u - u * r, m) for j, (m, r) in x_cells.items()), reverse=True)
        have = 0
        need[i] = -np.inf
        for low, m in lows:
            have += m
            if have >= k + same[i]:
                need[i] = low - 1e-6 * (1 + abs(low))
                break
        highs = {j: p_q[i] @ p_x[j] + norm_q[i] * r + norm_x[j] * u + u * r for j, (_, r) in x_cells.items()}
        visits[i] = [j for j, high in sorted(highs.items()) if high + 1e-5 * (1 + abs(high)) >= need[i]]
    parts = {j: -(-m // BLOCK) for j, (m, _) in x_cells.items()}
    groups = {i: -(-m // GROUP) for i, (m, _) in q_cells.items()}

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("v"), dim).astype(np.float64)
            reach = x @ p_q.T + np.sqrt((x * x).sum(1))[:, None] * radius[None]
            reach += 1e-6 * (1 + np.abs(reach))
            row, group = np.nonzero(reach >= need[None])
            cell = b.column("cell").to_numpy()[row]
            many = np.array([parts.get(int(c), 1) for c in range(len(p_x))])[cell]
            part = (b.column("id").to_numpy()[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % many.astype(np.uint64)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), pa.array(cell, pa.int32()), pa.array(part.astype(np.int64), pa.int32()), b.column("id").take(take), b.column("v").take(take)], names=["g", "c", "s", "id", "v"])

    cut = F.create_map(*[F.lit(int(y)) for pair in sorted(groups.items()) for y in pair])
    blocks = data.mapInArrow(replicate, "g int, c int, s int, id long, v array<long>")
    blocks = blocks.withColumn("u", F.explode(F.sequence(F.lit(0), F.element_at(cut, F.col("g")) - 1)))
    many = F.element_at(cut, F.col("cell"))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stops = {g: np.array([(j, k) for j in cells_ for k in range(parts[j])], np.int32).reshape(-1, 2) for g, cells_ in visits.items()}
        for b in batches:
            for i in range(0, b.num_rows, 256):
                some = b.slice(i, 256)
                to = [stops[g] for g in some.column("g").to_pylist()]
                row = pa.array(np.repeat(np.arange(len(to)), [len(x) for x in to]))
                to = np.concatenate(to)
                yield pa.RecordBatch.from_arrays([some.column("g").take(row), pa.array(to[:, 0]), pa.array(to[:, 1]), *(some.column(c).take(row) for c in ("u", "id", "v"))], names=["g", "c", "s", "u", "id", "v"])

    asked = queries.select(F.col("cell").alias("g"), F.pmod(F.xxhash64("id"), many.cast("long")).cast("int").alias("u"), "id", "v")
    asked = asked.mapInArrow(visit, "g int, c int, s int, u int, id long, v array<long>")

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"q": [], "h": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            x_id, x = left["id"].to_numpy(), matrix(left["v"], dim)
            order = np.argsort(x_id, kind="stable")
            x_id, x = x_id[order], x[order]
            q_id, qs = right["id"].to_numpy(), matrix(right["v"], dim)
            for a in range(0, len(q_id), 256):
                got = scores(qs[a : a + 256], x)
                own = x_id[None] == q_id[a : a + 256, None]
                for t in range(len(got)):
                    s, ids = got[t][~own[t]], x_id[~own[t]]
                    if len(s) > k:
                        edge = np.partition(s, len(s) - k)[len(s) - k]
                        at = np.flatnonzero(s >= edge)
                        s, ids = s[at], ids[at]
                    best = np.lexsort((ids, -s))[:k]
                    out["q"] += [int(q_id[a + t])] * len(best)
                    out["h"] += [int.from_bytes(hashlib.sha1(qs[a + t].tobytes()).digest()[:8], "little", signed=True)] * len(best)
                    out["vec_id"] += ids[best].tolist()
                    out["score"] += s[best].tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    best = blocks.groupBy("g", "c", "s", "u").cogroup(asked.groupBy("g", "c", "s", "u")).applyInArrow(solve, "q long, h long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("q", "h").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")
