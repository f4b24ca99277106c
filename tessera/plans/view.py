"""A memory table made from the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import KINDS

START_MS, HOUR_MS, DAY_MS = 1_704_067_200_000, 3_600_000, 86_400_000
NOW_MS = 1_707_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str, with_text: bool = True) -> DataFrame:
    """id = vec_id; integers only, so that any engine derives the same rows."""
    e = table(spark, sf_dir, "embeddings")
    created = F.lit(START_MS) + F.col("vec_id") * HOUR_MS
    out = e.select(
        F.col("vec_id").alias("id"),
        F.concat(F.lit("t"), (F.col("label") % 3).cast("string")).alias("tenant_id"),
        F.concat(F.lit("ns"), (F.col("label") % 2).cast("string")).alias("namespace"),
        F.element_at(F.array(*map(F.lit, KINDS)), F.col("label") % 5 + 1).alias("kind"),
        ((F.col("vec_id") * 37 % 101) / 100.0).alias("importance"),
        created.alias("created_at_ms"),
        (F.col("vec_id") % 15).alias("access_count"),
        F.when(F.col("vec_id") % 10 == 0, "deleted").otherwise("active").alias("status"),
        F.when(F.col("vec_id") % 7 == 0, created + F.lit(DAY_MS) * (F.col("vec_id") % 40)).alias("expires_at_ms"),
        F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"),
        (F.col("vec_id") % 4 + 1).alias("revision"),
        "embedding",
    )
    if not with_text:
        return out
    text = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("text").alias("content"))
    return out.join(text, F.col("id") == F.col("doc_id"), "left").drop("doc_id")


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, embedding, metadata map<string, array<string>>); every fifth row has no metadata."""
    e = table(spark, sf_dir, "embeddings")
    meta = F.when(F.col("vec_id") % 5 != 0, F.create_map(F.lit("label"), F.array(F.col("label").cast("string")), F.lit("parity"), F.array(F.when(F.col("vec_id") % 2 == 0, "even").otherwise("odd"))))
    return e.select(F.col("vec_id").alias("id"), "embedding", meta.alias("metadata"))


def vector_of(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"])


MEM = f"""mem AS (SELECT vec_id AS id, 't' || (label % 3) AS tenant_id, 'ns' || (label % 2) AS namespace,
 CASE label % 5 WHEN 0 THEN 'preference' WHEN 1 THEN 'fact' WHEN 2 THEN 'instruction' WHEN 3 THEN 'context' ELSE 'episodic' END AS kind,
 CAST(vec_id * 37 % 101 AS DOUBLE) / 100.0 AS importance, {START_MS} + vec_id * {HOUR_MS} AS created_at_ms, vec_id % 15 AS access_count,
 CASE WHEN vec_id % 10 = 0 THEN 'deleted' ELSE 'active' END AS status,
 CASE WHEN vec_id % 7 = 0 THEN {START_MS} + vec_id * {HOUR_MS} + {DAY_MS} * (vec_id % 40) END AS expires_at_ms, label, vec_id % 4 + 1 AS revision,
 embedding::DOUBLE[] AS e, text AS content FROM embeddings LEFT JOIN documents ON doc_id = vec_id)"""
IDX = """idx AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label, vec_id % 5 <> 0 AS has, CASE WHEN vec_id % 2 = 0 THEN 'even' ELSE 'odd' END AS parity FROM embeddings)"""


def q(vec_id: int) -> str:
    return f"(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {vec_id})"


def sql_distance(metric: str, a: str, b: str) -> str:
    if metric == "l2":
        return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    if metric == "dot":
        return f"-list_inner_product({a}, {b})"
    return f"1 - list_inner_product({a}, {b}) / greatest(sqrt(list_inner_product({a}, {a}) * list_inner_product({b}, {b})), 1.1920929e-07)"
