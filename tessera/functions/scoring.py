"""The four-factor score and its explanation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import Scoring

DAY_MS = 86_400_000.0
RRF = 60


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def similarity(distance: Column) -> Column:
    return clamp(1 - distance / 2)


def recency(now_ms: int, created_ms: Column, half_life_days: float) -> Column:
    """exp(-age / half-life): falls by a factor e, not 2, in each half-life; 1 for what lies ahead."""
    return F.exp(-F.greatest(F.lit(now_ms) - created_ms, F.lit(0)) / F.lit(half_life_days * DAY_MS))


def reinforcement(access_count: Column) -> Column:
    return clamp(access_count / 10.0)


def factors(distance: Column, now_ms: int, s: Scoring) -> dict[str, Column]:
    return {
        "similarity": similarity(distance),
        "importance_factor": clamp(F.col("importance").cast("double")),
        "recency": recency(now_ms, F.col("created_at_ms"), s.half_life_days),
        "reinforcement": reinforcement(F.col("access_count")),
    }


def total(s: Scoring) -> Column:
    return F.lit(s.similarity) * F.col("similarity") + F.lit(s.importance) * F.col("importance_factor") + F.lit(s.recency) * F.col("recency") + F.lit(s.reinforcement) * F.col("reinforcement")


def explanation(s: Scoring) -> Column:
    notes = F.array_compact(
        F.array(
            F.lit(s.note),
            F.when(F.col("fts_rank").isNotNull(), F.lit("fts5_lexical_candidate")),
            F.when(F.col("fts_rank").isNotNull() & F.col("vec_rank").isNotNull(), F.lit("reciprocal_rank_fusion")),
        )
    )
    return F.struct(F.col("score").alias("total"), "similarity", F.col("importance_factor").alias("importance"), "recency", "reinforcement", notes.alias("policy_notes"))


def rrf(*ranks: Column) -> Column:
    out = F.lit(0.0)
    for r in ranks:
        out = out + F.coalesce(1.0 / (RRF + r), F.lit(0.0))
    return out
