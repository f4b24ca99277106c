"""Recall: scoped, filtered, hybrid candidate retrieval, four-factor score, optional diversification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import filters, scoring
from ..functions.lexical import query_terms
from ..functions.vectors import block, cosine, vector
from ..model import Recall
from .search import bm25


def width(first: int, rank: int) -> int:
    """The candidate list's length: the first doubling of first that reaches rank."""
    n = first
    while n < rank:
        n *= 2
    return n


def lexical_candidates(memories: DataFrame, r: Recall, most: int) -> DataFrame:
    """(fid, fts_rank): the best `most` rows of the scope that hold a term of the text. Statistics are the scope's."""
    f = r.filters
    rows = memories.where(filters.in_scope(r.scope, f.strict_actor) & (F.col("status") == "active") & filters.within(f))
    if f.metadata:
        rows = rows.where(filters.metadata_equals(f.metadata))
    best = bm25(rows.select("id", "content"), r.text).orderBy(F.desc(F.round("bm25", 9)), "id").limit(most)
    rank = F.row_number().over(W.orderBy(F.desc(F.round("bm25", 9)), "id"))
    return best.select(F.col("id").alias("fid"), rank.alias("fts_rank"))


#: How many doublings of the candidate list one look at the nearest rows covers.
PROBED = 5


def candidates(memories: DataFrame, r: Recall, limit: int) -> DataFrame:
    """Eligible rows of the candidate pool with distance, vec_rank and fts_rank.

    The pool is what widening by doubling ends with on an exact index: the list of nearest live vectors of all tenants
    doubles from 3 * limit until it and the lexical hits hold limit eligible rows. One look at the nearest
    3 * limit * 2^PROBED rows (ids, distances and whether eligible) mostly settles the length; else it follows from the rank
    of the limit-th eligible row, by two aggregates and one top-n."""
    ok = filters.eligible(r.scope, r.filters, r.now_ms)
    first = 3 * limit
    live = memories.where(F.col("status") == "active").withColumn("distance", cosine(F.col("embedding"), vector(r.embedding)))
    spark, hits = memories.sparkSession, []
    if query_terms(r.text):
        hits = [tuple(h) for h in lexical_candidates(memories, r, first).collect()]  # at most 3 * limit rows
    if hits:
        listed = spark.createDataFrame(hits, T.StructType([T.StructField("fid", memories.schema["id"].dataType), T.StructField("fts_rank", T.IntegerType())]))
        live = live.join(F.broadcast(listed), F.col("id") == F.col("fid"), "left").drop("fid")
    else:
        live = live.withColumn("fts_rank", F.lit(None).cast("int"))
    if r.mode == "exact":
        return live.where(ok).withColumn("vec_rank", F.lit(1))
    most = first << PROBED
    seen = live.select("distance", "id", F.coalesce(ok, F.lit(False)).alias("ok"), "fts_rank")
    near = seen.orderBy("distance", "id").limit(most).withColumn("near", F.lit(True))
    if hits:
        near = near.unionByName(seen.where("fts_rank is not null").withColumn("near", F.lit(False)))
    got = near.collect()
    need = limit - sum(x["ok"] for x in got if not x["near"])
    top = sorted((x for x in got if x["near"]), key=lambda x: (x["distance"] is not None, x["distance"] or 0.0, x["id"]))
    n, have = first, 0
    if need > 0:
        at = next((k for k, x in enumerate(top) if x["ok"] and x["fts_rank"] is None and (have := have + 1) == need), None)
        n = width(first, at + 1) if at is not None else None
    if n is None and len(top) == most:
        last = live.where(ok & F.col("fts_rank").isNull()).select("distance", "id").orderBy("distance", "id").limit(need)
        end = last.agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("distance", "id")).alias("last")).first()
        if end["n"] == need:
            d, i = end["last"]
            n = width(first, live.where((F.col("distance") < d) | ((F.col("distance") == d) & (F.col("id") <= i))).count())
    if n is None:  # fewer eligible rows than asked for: every one is in the pool
        return live.where(ok).withColumn("vec_rank", F.lit(1))
    if n <= len(top) or len(top) < most:
        pool = {x["id"]: None for x in got if not x["near"] and x["ok"]} | {x["id"]: k + 1 for k, x in enumerate(top[:n]) if x["ok"]}
        ranks = spark.createDataFrame(sorted(pool.items(), key=lambda x: x[0]), T.StructType([T.StructField("nid", memories.schema["id"].dataType), T.StructField("vec_rank", T.IntegerType())]))
        return live.join(F.broadcast(ranks), F.col("id") == F.col("nid")).drop("nid")
    near = live.select("distance", "id").orderBy("distance", "id").limit(n)
    ranks = near.select(F.col("id").alias("nid"), F.row_number().over(W.orderBy("distance", "id")).alias("vec_rank"))
    edge = near.agg(F.max(F.struct("distance", "id")).alias("last")).first()["last"]
    inside = (F.col("distance") < edge[0]) | ((F.col("distance") == edge[0]) & (F.col("id") <= edge[1]))
    return live.where(ok).where(inside | F.col("fts_rank").isNotNull()).join(ranks, F.col("id") == F.col("nid"), "left").drop("nid")


def scored(pool: DataFrame, r: Recall) -> DataFrame:
    out = pool
    for name, c in scoring.factors(F.col("distance"), r.now_ms, r.scoring).items():
        out = out.withColumn(name, c)
    out = out.withColumn("score", scoring.total(r.scoring))
    return out.withColumn("rrf", scoring.rrf(F.col("vec_rank"), F.col("fts_rank"))).withColumn("explanation", scoring.explanation(r.scoring))


def diversified(rows: DataFrame, k: int, lam: float, group: str | None = None) -> DataFrame:
    """Maximal marginal relevance: greedily the row with the highest lam * score - (1 - lam) * likeness to what is chosen,
    likeness being clamp(1 - cosine distance); ties go to the higher rrf, then the smaller id. rows are a bounded pool."""
    keyed = rows.select((F.col(group) if group else F.lit(0)).alias("__g"), "id", "score", "rrf", "embedding")
    kind = keyed.schema["id"].dataType.simpleString()
    gkind = keyed.schema["__g"].dataType.simpleString()

    def pick(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("rrf", "descending"), ("id", "ascending")])
        s, x = table["score"].to_numpy(), np.array(table["embedding"].to_pylist(), np.float64)
        near, left, chosen = np.zeros(len(s)), np.ones(len(s), bool), []
        while len(chosen) < k and left.any():
            value = np.where(left, lam * s - (1 - lam) * near, -np.inf)
            best = int(value.argmax())
            chosen.append(best)
            left[best] = False
            near = np.maximum(near, np.clip(1 - block("cosine", x, x[best : best + 1])[:, 0], 0, 1))
        ids = table["id"].take(pa.array(chosen, pa.int64()))
        return pa.table({"__g": pa.array([key[0].as_py()] * len(chosen), table.schema.field("__g").type), "id": ids, "rank": pa.array(range(1, len(chosen) + 1), pa.int32())})

    order = keyed.groupBy("__g").applyInArrow(pick, f"__g {gkind}, id {kind}, rank int")
    on = (F.col("r.id") == F.col("o.id")) & (F.col("o.__g").eqNullSafe(F.col(f"r.{group}")) if group else F.lit(True))
    return rows.alias("r").join(order.alias("o"), on).select("r.*", F.col("o.rank"))


def recall(memories: DataFrame, r: Recall, dims: int | None = None, max_limit: int = 100) -> DataFrame:
    """At most limit rows, best first by rank: the memory's columns, score, rank, explanation, total_candidates."""
    r.validate(dims)
    limit = min(r.limit, max_limit)
    pool = scored(candidates(memories, r, limit), r)
    if r.mmr_lambda is not None:
        best = diversified(pool, limit, r.mmr_lambda)
    else:
        best = pool.orderBy(F.desc("score"), "id").limit(limit)
        best = best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id")))
    return best.withColumn("total_candidates", F.count(F.lit(1)).over(W.partitionBy()))


def batch_vector_recall(memories: DataFrame, queries: DataFrame, r: Recall) -> DataFrame:
    """Vector recall for many queries of one scope: of all eligible rows the best limit of each query by score, exactly.

    All factors but likeness depend on the row alone, so the score is a weight times likeness plus a number of the row, and
    the search ranks by it; no pool of nearest rows bounds it."""
    from .knn import batch_top_k

    ok = memories.where(filters.eligible(r.scope, r.filters, r.now_ms))
    factors = scoring.factors(F.lit(2.0), r.now_ms, r.scoring)  # at this distance likeness is 0
    fixed = ok
    for name, c in factors.items():
        fixed = fixed.withColumn(name, c)
    near = batch_top_k(fixed, queries, r.limit, "cosine", like=r.scoring.similarity, bonus=scoring.total(r.scoring))
    rows = near.join(ok.select(F.col("id").alias("mid"), "importance", "created_at_ms", "access_count"), F.col("id") == F.col("mid")).drop("mid")
    for name, c in scoring.factors(F.col("distance"), r.now_ms, r.scoring).items():
        rows = rows.withColumn(name, c)
    return rows.withColumn("score", scoring.total(r.scoring)).select("query_id", "rank", "id", "score")
