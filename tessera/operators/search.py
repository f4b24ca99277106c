"""Full-text candidates with BM25, in one pass over the texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexical import B, K1, query_terms, tokens


def statistics(docs: DataFrame, text_col: str, terms: list[str]) -> tuple[int, float, list[int]]:
    """Documents, mean length and document frequencies of the terms: one row, from one pass."""
    t = docs.select(tokens(F.col(text_col)).alias("t"))
    row = t.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("t")).alias("len"), *[F.sum(F.array_contains("t", w).cast("long")).alias(f"d{i}") for i, w in enumerate(terms)]).first()
    return row["n"], row["len"] or 0.0, [row[f"d{i}"] or 0 for i in range(len(terms))]


def bm25(docs: DataFrame, query: str, text_col: str = "content", stats: tuple[int, float, list[int]] | None = None) -> DataFrame:
    """Rows that hold any term of the query, with bm25: sum of idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len / mean)),
    idf = ln(1 + (n - df + 0.5) / (df + 0.5)). Statistics default to those of docs."""
    terms = query_terms(query)
    if not terms:
        return docs.where(F.lit(False)).withColumn("bm25", F.lit(0.0))
    n, mean, df = statistics(docs, text_col, terms) if stats is None else stats
    rows = docs.withColumn("__t", tokens(F.col(text_col))).where(F.arrays_overlap("__t", F.array(*map(F.lit, terms))))
    length = F.lit(1 - B) + F.lit(B) * F.size("__t") / F.lit(mean or 1.0)
    parts = []
    for w, d in zip(terms, df):
        tf = F.size(F.filter("__t", _is(w))).cast("double")
        parts.append(F.log(F.lit(1 + (n - d + 0.5) / (d + 0.5))) * tf * (K1 + 1) / (tf + F.lit(K1) * length))
    return rows.withColumn("bm25", reduce(lambda a, b: a + b, parts)).drop("__t")


def _is(word: str):
    return lambda x: x == F.lit(word)


def postings(docs: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(id, token, pos): the inverted index, where one is wanted stored."""
    return docs.select(id_col, F.posexplode(tokens(F.col(text_col))).alias("pos", "token")).select(id_col, "token", "pos")
