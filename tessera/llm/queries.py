"""The registered queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import knn, minhash, mixing, ngram, oracles, packing, quality, substring, token_counts, toxicity, warc
from .common import new_path

BPE = "byte_bpe_50k.json"


def tokenizer_path(name: str = BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path(), 1024)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), "page_id", "url", "html", out)
    return warc.read_archive(spark, out).drop("url")


def op3_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = F.crc32(F.col("doc_id").cast("string")) % 7
    out = ngram.score(table(spark, sf_dir, "documents"), "doc_id", "text", rest != 2, orders=3)
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % 7 == 2, F.lit(False))
    return out.select(F.col("id").alias("doc_id"), held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path(), 2048)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "lang", "toxic", ~held)
    out = toxicity.toxicity(docs, model, "doc_id", "text", "lang", 0.7)
    return out.select("doc_id", held.alias("held_out"), "score", "predicted", "flagged")


def op6_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 50 == 0, 5)


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(table(spark, sf_dir, "documents"), "doc_id", "text", 50).withColumnRenamed("id", "doc_id")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", 85).withColumnRenamed("id", "doc_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), "doc_id", "text")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), "doc_id", "source", "text")
    return out.select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_counts, op2_warc, op3_ngram, op4_packing, op5_toxicity, op6_knn, op7_substring, op8_minhash, op9_quality, op10_mixing)}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
