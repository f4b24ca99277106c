"""Change feeds of vectors: latest version wins, tombstones, ids, compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

CHANGES = "seq BIGINT, op STRING, id BIGINT, embedding ARRAY<FLOAT>, metadata MAP<STRING,ARRAY<STRING>>"


def latest(changes: DataFrame, key: list[str] | None = None, seq: str = "seq") -> DataFrame:
    """The last change of each key, with a map-side maximum: a key with very many versions does not gather in one task."""
    key = key or ["id"]
    rest = [c for c in changes.columns if c not in key]
    row = F.max_by(F.struct(*rest), F.col(seq)).alias("__row")
    return changes.groupBy(*key).agg(row).select(*key, "__row.*").select(*changes.columns)


def live(changes: DataFrame) -> DataFrame:
    """Rows that stand after all changes: the last one of each id, unless it deletes."""
    return latest(changes).where("op <> 'delete'")


def settled(changes: DataFrame) -> DataFrame:
    """The last change of each id as (id, op, embedding, metadata, fresh). An upsert without metadata keeps what the id had
    before, unless it was deleted in between: then fresh is true, and what a snapshot holds does not count either."""
    m = F.col("metadata").isNotNull()
    g = changes.groupBy("id").agg(
        F.max_by(F.struct("op", "embedding"), "seq").alias("r"), F.max(F.when(F.col("op") == "delete", F.col("seq"))).alias("gone"),
        F.max(F.when(m, F.col("seq"))).alias("at"), F.max_by("metadata", F.when(m, F.col("seq"))).alias("m"),
    )
    return g.select("id", "r.op", "r.embedding", F.when(F.col("gone").isNull() | (F.col("at") > F.col("gone")), F.col("m")).alias("metadata"), F.col("gone").isNotNull().alias("fresh"))


def overlay(snapshot: DataFrame, changes: DataFrame) -> DataFrame:
    """A snapshot (id, embedding, metadata) with newer changes on top."""
    last = settled(changes).select(F.col("id").alias("cid"), "op", F.col("embedding").alias("ce"), F.col("metadata").alias("cm"), "fresh")
    both = snapshot.join(last, F.col("id") == F.col("cid"), "full_outer").where("op is null or op <> 'delete'")
    kept = F.coalesce(F.col("cm"), F.when(~F.coalesce("fresh", F.lit(False)), F.col("metadata")))
    return both.select(F.coalesce("cid", "id").alias("id"), F.when(F.col("cid").isNotNull(), F.col("ce")).otherwise(F.col("embedding")).alias("embedding"), kept.alias("metadata"))


def without_tombstones(rows: DataFrame, tombstones: DataFrame) -> DataFrame:
    return rows.join(tombstones.select("id"), "id", "left_anti")


def next_id(rows: DataFrame) -> int:
    """One past the highest id; 1 for an empty index."""
    return int(rows.agg(F.max("id")).first()[0] or 0) + 1


def first_seen(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def scoped_journal(operations: DataFrame, memories: DataFrame) -> DataFrame:
    """Operations without a scope get that of their memory; of those that share (scope, operation id) the earliest stays,
    by creation and memory id. Operations of unknown memories go."""
    scopes = memories.select(F.col("id").alias("memory_id"), "tenant_id", "namespace")
    rows = operations.join(scopes, "memory_id")
    rest = [c for c in rows.columns if c not in ("tenant_id", "namespace", "operation_id")]
    first = F.min_by(F.struct(*rest), F.struct("created_at_ms", "memory_id")).alias("r")
    return rows.groupBy("tenant_id", "namespace", "operation_id").agg(first).select("tenant_id", "namespace", "operation_id", "r.*")


def union_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").union(b.select("id")).distinct()


def merge(records: DataFrame, patches: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """Optimistic updates: (records after the patches that fit, rejected patches with a reason).

    patches: id, expected_revision (null: any), content, importance, kind - null leaves a field as it is."""
    p = patches.select(F.col("id").alias("pid"), "expected_revision", F.col("content").alias("pc"), F.col("importance").alias("pi"), F.col("kind").alias("pk"))
    both = records.join(p, F.col("id") == F.col("pid"), "left")
    fits = F.col("pid").isNotNull() & (F.col("status") != "deleted") & (F.col("expected_revision").isNull() | (F.col("expected_revision") == F.col("revision")))
    after = both.select(
        *[
            {
                "content": F.when(fits, F.coalesce("pc", "content")).otherwise(F.col("content")),
                "importance": F.when(fits, F.coalesce("pi", "importance")).otherwise(F.col("importance")),
                "kind": F.when(fits, F.coalesce("pk", "kind")).otherwise(F.col("kind")),
                "revision": F.when(fits, F.col("revision") + 1).otherwise(F.col("revision")),
                "status": F.when(fits, F.lit("active")).otherwise(F.col("status")),
                "updated_at_ms": F.when(fits, F.lit(now_ms)).otherwise(F.col("updated_at_ms")),
            }.get(c, F.col(c)).alias(c)
            for c in records.columns
        ]
    )
    known = p.join(records.select("id", "status", "revision"), F.col("pid") == F.col("id"), "left")
    reason = F.when(F.col("id").isNull() | (F.col("status") == "deleted"), F.lit("NotFound")).when(F.col("expected_revision") != F.col("revision"), F.lit("RevisionConflict"))
    return after, known.select(F.col("pid").alias("id"), reason.alias("reason")).where("reason is not null")


def health(memories: DataFrame, pending: int = 0) -> DataFrame:
    return memories.agg(F.count(F.when(F.col("status") == "active", 1)).alias("active_memories"), F.count(F.when(F.col("status") == "deleted", 1)).alias("tombstoned_memories"), F.lit(pending).cast("long").alias("pending_operations"))
