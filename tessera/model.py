"""Data model: schemas, scopes, requests, validation, canonical JSON scalars."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

from .errors import EngineError, invalid

KINDS = ("preference", "fact", "instruction", "context", "episodic")
STATUSES = ("pending", "active", "deleted", "expired")

_TYPES = {
    "STRING": T.StringType(), "BINARY": T.BinaryType(), "INT": T.IntegerType(), "BIGINT": T.LongType(), "FLOAT": T.FloatType(), "BOOLEAN": T.BooleanType(),
    "ARRAY<FLOAT>": T.ArrayType(T.FloatType()), "MAP<STRING,STRING>": T.MapType(T.StringType(), T.StringType()),
}


def schema(columns: str) -> T.StructType:
    """A schema from "name TYPE, ..."; needs no session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split(" ") for c in columns.split(", "))])


MEMORIES = schema(
    "id STRING, tenant_id STRING, namespace STRING, agent_id STRING, user_id STRING, kind STRING, content STRING, content_hash BINARY, "
    "embedding ARRAY<FLOAT>, embedding_model STRING, embedding_dims INT, importance FLOAT, created_at_ms BIGINT, updated_at_ms BIGINT, "
    "last_accessed_at_ms BIGINT, access_count BIGINT, expires_at_ms BIGINT, status STRING, revision BIGINT, metadata MAP<STRING,STRING>, "
    "source MAP<STRING,STRING>, enc_version INT"
)
OPERATIONS = schema("tenant_id STRING, namespace STRING, operation_id STRING, memory_id STRING, kind STRING, payload_json STRING, state STRING, created_at_ms BIGINT, applied_at_ms BIGINT")
HEALTH = schema("active_memories BIGINT, tombstoned_memories BIGINT, pending_operations BIGINT, database_bytes BIGINT, journal_bytes BIGINT, index_healthy BOOLEAN, schema_version INT")
SCHEMA_VERSION = 4


def canonical(value: Any) -> str:
    """JSON text of a value such that equal text means equal type and value: 1, 1.0, "1" and true all differ."""
    if isinstance(value, float) and not math.isfinite(value):
        raise invalid("metadata numbers must be finite")
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_map(values: dict[str, Any] | None) -> dict[str, str]:
    return {str(k): canonical(v) for k, v in (values or {}).items()}


@dataclass(frozen=True)
class Scope:
    tenant_id: str
    namespace: str
    agent_id: str | None = None
    user_id: str | None = None

    def __post_init__(self) -> None:
        for name in ("tenant_id", "namespace"):
            text = getattr(self, name).strip()
            if not text:
                raise invalid(f"{name} must not be empty")
            object.__setattr__(self, name, text)
        for name in ("agent_id", "user_id"):
            text = getattr(self, name)
            if text is not None:
                if not text.strip():
                    raise invalid(f"{name} must not be empty")
                object.__setattr__(self, name, text.strip())


def check_vector(vector: list[float], dims: int | None) -> list[float]:
    out = [float(x) for x in vector]
    if dims is not None and len(out) != dims:
        raise EngineError("DimensionMismatch", f"expected {dims} dimensions, got {len(out)}")
    return out


def check_importance(value: float) -> float:
    if not (math.isfinite(value) and 0.0 <= value <= 1.0):
        raise invalid("importance must lie in [0, 1]")
    return float(value)


def check_kind(kind: str) -> str:
    if kind not in KINDS:
        raise invalid("unknown memory kind")
    return kind


@dataclass
class Remember:
    scope: Scope
    content: str
    embedding: list[float]
    kind: str = "fact"
    importance: float = 0.5
    metadata: dict[str, Any] = field(default_factory=dict)
    source: dict[str, Any] = field(default_factory=dict)
    expires_at_ms: int | None = None
    operation_id: str | None = None
    id: str | None = None

    def validate(self, dims: int) -> None:
        if not self.content.strip():
            raise invalid("content must not be blank")
        check_kind(self.kind)
        check_importance(self.importance)
        check_vector(self.embedding, dims)


#: Tells "leave as it is" from "set to null".
KEEP = object()


@dataclass
class Update:
    scope: Scope
    id: str
    expected_revision: int | None = None
    content: str | None = None
    embedding: list[float] | None = None
    kind: str | None = None
    importance: float | None = None
    expires_at_ms: Any = KEEP
    metadata: dict[str, Any] | None = None
    operation_id: str | None = None

    def validate(self, dims: int) -> None:
        if not self.id.strip():
            raise invalid("id must not be blank")
        if self.content is not None and not self.content.strip():
            raise invalid("content must not be blank")
        if self.content is not None and self.embedding is None:
            raise invalid("new content needs its embedding")
        if self.embedding is not None:
            check_vector(self.embedding, dims)
        if self.kind is not None:
            check_kind(self.kind)
        if self.importance is not None:
            check_importance(self.importance)


@dataclass(frozen=True)
class Scoring:
    """Weights of the four factors, and the days in which recency falls by a factor e."""

    similarity: float = 0.70
    importance: float = 0.15
    recency: float = 0.10
    reinforcement: float = 0.05
    half_life_days: float = 7.0

    def __post_init__(self) -> None:
        weights = (self.similarity, self.importance, self.recency, self.reinforcement)
        if any(not math.isfinite(w) or w < 0 for w in weights):
            raise invalid("scoring weights must be finite and not negative")
        if not any(weights):
            raise invalid("at least one scoring weight must be positive")
        if not math.isfinite(self.half_life_days) or self.half_life_days <= 0:
            raise invalid("half-life must be positive")

    @classmethod
    def from_dict(cls, values: dict[str, float]) -> "Scoring":
        names = {"weight_similarity": "similarity", "weight_importance": "importance", "weight_recency": "recency", "weight_reinforcement": "reinforcement", "recency_half_life_days": "half_life_days"}
        return cls(**{names.get(k, k): float(v) for k, v in values.items()})

    @property
    def note(self) -> str:
        if self == Scoring():
            return "default_v1_scoring"
        return f"custom_scoring(sim={self.similarity:.2f},imp={self.importance:.2f},rec={self.recency:.2f},reinf={self.reinforcement:.2f},half_life={self.half_life_days:.1f}d)"


@dataclass
class MemoryFilter:
    kinds: list[str] | None = None
    min_importance: float | None = None
    metadata: dict[str, Any] = field(default_factory=dict)
    created_after_ms: int | None = None
    created_before_ms: int | None = None
    strict_actor: bool = False


@dataclass
class Recall:
    scope: Scope
    embedding: list[float]
    now_ms: int
    text: str | None = None
    limit: int = 10
    filters: MemoryFilter = field(default_factory=MemoryFilter)
    mmr_lambda: float | None = None
    scoring: Scoring = field(default_factory=Scoring)
    mode: str = "pool"

    def validate(self, dims: int | None) -> None:
        check_vector(self.embedding, dims)
        if self.limit <= 0:
            raise invalid("limit must be positive")
        if self.mmr_lambda is not None and not (math.isfinite(self.mmr_lambda) and 0 <= self.mmr_lambda <= 1):
            raise invalid("mmr_lambda must lie in [0, 1]")
        if self.mode not in ("pool", "exact"):
            raise invalid("mode must be pool or exact")
