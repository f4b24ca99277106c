"""Predicates as Columns: memory filters and the metadata filter expressions."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..model import MemoryFilter, Scope, canonical


def in_scope(scope: Scope, strict_actor: bool = False) -> Column:
    """Tenant and namespace; agent and user are compared only on request."""
    out = (F.col("tenant_id") == scope.tenant_id) & (F.col("namespace") == scope.namespace)
    if strict_actor and scope.agent_id is not None:
        out &= F.col("agent_id") == scope.agent_id
    if strict_actor and scope.user_id is not None:
        out &= F.col("user_id") == scope.user_id
    return out


def alive(now_ms: int) -> Column:
    """Active and not expired; a row expires at its expiry time, not after it."""
    return (F.col("status") == "active") & (F.col("expires_at_ms").isNull() | (F.lit(now_ms) < F.col("expires_at_ms")))


def within(f: MemoryFilter) -> Column:
    """Creation time, both bounds included."""
    out = F.lit(True)
    if f.created_after_ms is not None:
        out &= F.col("created_at_ms") >= f.created_after_ms
    if f.created_before_ms is not None:
        out &= F.col("created_at_ms") <= f.created_before_ms
    return out


def metadata_equals(wanted: dict[str, Any]) -> Column:
    """Typed equality of top-level keys with canonical JSON scalars."""
    return reduce(lambda a, kv: a & F.coalesce(F.col("metadata")[kv[0]] == canonical(kv[1]), F.lit(False)), sorted(wanted.items()), F.lit(True))


def matches(f: MemoryFilter) -> Column:
    out = within(f)
    if f.kinds is not None:
        out &= F.col("kind").isin(list(f.kinds)) if f.kinds else F.lit(False)
    if f.min_importance is not None:
        out &= F.col("importance") >= f.min_importance
    if f.metadata:
        out &= metadata_equals(f.metadata)
    return out


def eligible(scope: Scope, f: MemoryFilter, now_ms: int) -> Column:
    return in_scope(scope, f.strict_actor) & alive(now_ms) & matches(f)


def vacuum_candidates(now_ms: int) -> Column:
    return (F.col("status") == "deleted") | (F.col("expires_at_ms").isNotNull() & (F.col("expires_at_ms") <= now_ms))


# ------------------------------------------------- index metadata: map<string, array<string>>


def equals(field: str, value: str, column: str = "metadata") -> Column:
    return F.coalesce(F.array_contains(F.col(column)[field], value), F.lit(False))


def is_in(field: str, values: list[str], column: str = "metadata") -> Column:
    if not values:
        return F.lit(False)
    return F.coalesce(F.arrays_overlap(F.col(column)[field], F.array(*map(F.lit, values))), F.lit(False))


def has_metadata(column: str = "metadata") -> Column:
    return F.coalesce(F.size(column) > 0, F.lit(False))


def parse(expr: dict[str, Any] | None, column: str = "metadata") -> Column | None:
    """{eq|in|and|or|not: ...}, exactly one operator an object. And([]) and Or([]) match nothing; Not matches only rows
    that have metadata."""
    if expr is None:
        return None
    if not isinstance(expr, dict) or len(expr) != 1:
        raise EngineError("InvalidFilter", "a filter object has exactly one operator")
    op, arg = next(iter(expr.items()))
    try:
        if op == "eq":
            return equals(arg["field"], arg["value"], column)
        if op == "in":
            return is_in(arg["field"], list(arg["values"]), column)
        if op in ("and", "or"):
            parts = [parse(e, column) for e in arg]
            return reduce((lambda a, b: a & b) if op == "and" else (lambda a, b: a | b), parts) if parts else F.lit(False)
        if op == "not":
            return has_metadata(column) & ~parse(arg, column)
    except (KeyError, TypeError) as e:
        raise EngineError("InvalidFilter", "a filter operand has the wrong form") from e
    raise EngineError("InvalidFilter", "unknown filter operator")


def parse_simple(wanted: dict[str, Any] | None, column: str = "metadata") -> Column | None:
    """The short form: a conjunction of field: value or field: [values]; empty means no filter."""
    if not wanted:
        return None
    parts = [{"in": {"field": k, "values": list(v)}} if isinstance(v, (list, tuple)) else {"eq": {"field": k, "value": str(v)}} for k, v in sorted(wanted.items())]
    return parse({"and": parts}, column)


def selectivity(df: DataFrame, expr: Column, column: str = "metadata") -> DataFrame:
    """Share of rows with metadata that match; 1 when there are none."""
    has = has_metadata(column)
    return df.agg(F.coalesce(F.sum((has & expr).cast("double")) / F.when(F.sum(has.cast("long")) > 0, F.sum(has.cast("long"))), F.lit(1.0)).alias("selectivity"))
