"""Registered queries that drive the memory store and the vector index through their own verbs, each on a new one, and
their SQL."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Remember, Scope, Update
from ..operators import changes
from ..sources.files import shared_dir
from ..sources.index import VectorIndex
from ..sources.store import MemoryStore
from .view import IDX, MEM, NOW_MS, index, memories, q, sql_distance, table, vector_of

A = Scope("t0", "ns0")
#: Columns that the queries report of each stored row.
SHOWN = ["tenant_id", "namespace", "id", "kind", "status", "revision"]
COLUMNS = "tenant_id, namespace, CAST(id AS VARCHAR) AS id, kind"


def filled(spark: SparkSession, sf_dir: str, status: Column | None = None) -> MemoryStore:
    """A store of all rows of the memory view, by one bulk load."""
    store = MemoryStore(spark, f"{shared_dir(spark)}/tessera/store-{uuid.uuid4().hex}", len(vector_of(spark, sf_dir, 0)), "m")
    rows = memories(spark, sf_dir).withColumns({"id": F.col("id").cast("string"), "content": F.coalesce("content", F.lit("none")), "status": F.lit("active") if status is None else status, "revision": F.lit(1)})
    store.ingest(rows.drop("access_count"), NOW_MS)
    return store


def edge(store: MemoryStore, end) -> str:
    """The least or greatest id of the scope A."""
    return str(store.memories().where("tenant_id = 't0' and namespace = 'ns0'").agg(end(F.col("id").cast("long"))).first()[0])


def edge_sql(end: str) -> str:
    return f"(SELECT {end}(id) FROM mem WHERE tenant_id = 't0' AND namespace = 'ns0')"


def shown(store: MemoryStore) -> DataFrame:
    return store.memories().select(*SHOWN)


def store_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk load, compaction and a read of the base: content hashes as the engine makes them."""
    store = filled(spark, sf_dir)
    store.compact()
    return store.memories().select(*SHOWN, F.lower(F.hex("content_hash")).alias("content_hash"))


INGEST = f"WITH {MEM} SELECT {COLUMNS}, 'active' AS status, CAST(1 AS BIGINT) AS revision, substr(sha256(coalesce(content, 'none')), 1, 16) AS content_hash FROM mem"


def store_remember(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch whose operations repeat within it, and again later: each is stored once."""
    store = filled(spark, sf_dir)
    v = vector_of(spark, sf_dir, 1)
    batch = [Remember(A, f"text {k % 3}", v, kind="preference", operation_id=f"op{k % 3}", id=f"new{k}") for k in range(5)]
    first = store.remember_batch(batch, NOW_MS)
    again = store.remember_batch(batch, NOW_MS + 1)
    if first != again:
        raise ValueError("a repeated operation made another memory")
    return shown(store)


REMEMBER = f"WITH {MEM} SELECT {COLUMNS}, 'active' AS status, CAST(1 AS BIGINT) AS revision FROM mem UNION ALL SELECT 't0', 'ns0', 'new' || k, 'preference', 'active', 1 FROM range(3) AS r(k)"


def store_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two updates of one memory: a patch of its metadata under an expected revision, then of importance and kind."""
    store = filled(spark, sf_dir)
    one = edge(store, F.max)
    store.update(Update(A, one, expected_revision=1, metadata={"seen": True}), NOW_MS)
    store.update(Update(A, one, expected_revision=2, importance=0.25, kind="episodic"), NOW_MS + 1)
    return store.memories().where("revision > 1").select(*SHOWN, F.round(F.col("importance").cast("double"), 4).alias("importance"), F.col("metadata")["seen"].alias("seen"))


UPDATE = f"WITH {MEM} SELECT tenant_id, namespace, CAST(id AS VARCHAR) AS id, 'episodic' AS kind, 'active' AS status, CAST(3 AS BIGINT) AS revision, CAST(0.25 AS DOUBLE) AS importance, 'true' AS seen FROM mem WHERE id = {edge_sql('max')}"


def store_forget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of a scope is forgotten under one operation, which then repeats; one more alone."""
    store = filled(spark, sf_dir)
    ids = [r["id"] for r in store.memories().where("tenant_id = 't0' and namespace = 'ns0' and cast(id as long) % 4 = 2").select("id").collect()]
    store.forget_batch(A, ids, NOW_MS, "gone")
    store.forget_batch(A, ids, NOW_MS + 1, "gone")
    one = store.memories().where("tenant_id = 't1' and namespace = 'ns1'").agg(F.min(F.col("id").cast("long"))).first()[0]
    store.forget(Scope("t1", "ns1"), str(one), NOW_MS)
    return shown(store)


FORGET = f"WITH {MEM} SELECT {COLUMNS}, CASE WHEN id = (SELECT min(id) FROM mem WHERE tenant_id = 't1' AND namespace = 'ns1') OR (tenant_id = 't0' AND namespace = 'ns0' AND id % 4 = 2) THEN 'deleted' ELSE 'active' END AS status, CAST(1 AS BIGINT) AS revision FROM mem"


def store_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third row is left pending, some with a pending operation; opening the store again recovers all of them."""
    store = filled(spark, sf_dir, F.when(F.col("id").cast("long") % 3 == 1, "pending").otherwise("active"))
    store._write(None, [("t0", "ns0", "late", "30", "remember", "", "pending", NOW_MS, None)])
    again = MemoryStore(spark, store.path, store.dims, store.model)
    left = again.operations().where("state = 'pending'").count()
    return shown(again).withColumn("pending", F.lit(left).cast("long"))


RECOVER = f"WITH {MEM} SELECT {COLUMNS}, 'active' AS status, CAST(1 AS BIGINT) AS revision, CAST(0 AS BIGINT) AS pending FROM mem"


def store_vacuum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 deleted or expired rows by id are purged; what is left."""
    store = filled(spark, sf_dir, F.when(F.col("id").cast("long") % 10 == 0, "deleted").otherwise("active"))
    store.vacuum(40, NOW_MS)
    return shown(store)


VACUUM = f"""WITH {MEM}, gone AS (SELECT id FROM mem WHERE status = 'deleted' OR expires_at_ms <= {NOW_MS} ORDER BY CAST(id AS VARCHAR) LIMIT 40)
SELECT {COLUMNS}, status, CAST(1 AS BIGINT) AS revision FROM mem WHERE id NOT IN (SELECT id FROM gone)"""


def store_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with deleted rows and with pending operations, of which one is then marked as applied."""
    store = filled(spark, sf_dir, F.when(F.col("id").cast("long") % 10 == 0, "deleted").otherwise("active"))
    store._write(None, [("t0", "ns0", f"op{k}", "30", "remember", "", "pending", NOW_MS, None) for k in range(4)])
    store.mark_applied(A, ["op1", "none"], NOW_MS)
    return store.health().select("active_memories", "tombstoned_memories", "pending_operations", "index_healthy", "schema_version", (F.col("database_bytes") > 0).alias("has_bytes"), (F.col("journal_bytes") > 0).alias("has_journal"))


HEALTH = f"WITH {MEM} SELECT count(*) FILTER (status = 'active') AS active_memories, count(*) FILTER (status = 'deleted') AS tombstoned_memories, CAST(3 AS BIGINT) AS pending_operations, true AS index_healthy, 4 AS schema_version, true AS has_bytes, true AS has_journal FROM mem"


def store_backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backup, opened, does not show what the store did later; the store, opened again, does."""
    store = filled(spark, sf_dir)
    store.backup(f"{store.path}-copy")
    one = edge(store, F.max)
    store.set_status(A, [one], "deleted")
    store.compact()
    out = []
    for name, path in (("copy", f"{store.path}-copy"), ("store", store.path)):
        out.append(shown(MemoryStore(spark, path, store.dims, store.model)).where(F.col("id") == one).withColumn("place", F.lit(name)))
    return out[0].union(out[1])


BACKUP = f"WITH {MEM} SELECT {COLUMNS}, CASE place WHEN 'copy' THEN 'active' ELSE 'deleted' END AS status, CAST(1 AS BIGINT) AS revision, place FROM mem, (VALUES ('copy'), ('store')) AS p(place) WHERE id = {edge_sql('max')}"


def store_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """get: a row of the scope; none from another scope, and none that is deleted."""
    store = filled(spark, sf_dir, F.when(F.col("id").cast("long") % 12 == 0, "deleted").otherwise("active"))
    ids = [edge(store, F.min), edge(store, F.max), "no"]
    asked = [(Scope(*s), i, a) for s in (("t0", "ns0"), ("t1", "ns1")) for i in ids for a in (True, False)]
    got = [(s.tenant_id, i, a, store.get(s, i, a)) for s, i, a in asked]
    return spark.createDataFrame([(t, i, a, None if r is None else r["status"]) for t, i, a, r in got], "tenant_id string, id string, active_only boolean, status string")


LOOKUP = f"""WITH {MEM}, asked AS (SELECT * FROM (VALUES ('t0', 'ns0'), ('t1', 'ns1')) AS s(t, n), (SELECT CAST({edge_sql('min')} AS VARCHAR) UNION ALL SELECT CAST({edge_sql('max')} AS VARCHAR) UNION ALL SELECT 'no') AS i(i), (VALUES (true), (false)) AS a(a)),
m AS (SELECT tenant_id, namespace, CAST(id AS VARCHAR) AS id, CASE WHEN id % 12 = 0 THEN 'deleted' ELSE 'active' END AS status FROM mem)
SELECT t AS tenant_id, i AS id, a AS active_only, status FROM asked LEFT JOIN m ON m.tenant_id = t AND m.namespace = n AND m.id = i AND (NOT a OR status = 'active')"""


def store_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of an id that two scopes hold, one of them deleted."""
    store = filled(spark, sf_dir)
    one = edge(store, F.max)
    store.remember(Remember(Scope("t9", "ns9"), "other", vector_of(spark, sf_dir, 1), kind="preference", id=one), NOW_MS)
    store.forget(A, one, NOW_MS)
    return store.find(one).select(*SHOWN)


FIND = f"""WITH {MEM} SELECT {COLUMNS}, 'deleted' AS status, CAST(1 AS BIGINT) AS revision FROM mem WHERE id = {edge_sql('max')}
UNION ALL SELECT 't9', 'ns9', CAST({edge_sql('max')} AS VARCHAR), 'preference', 'active', 1"""

OPS = "operation_id string, memory_id string, kind string, payload_json string, state string, created_at_ms long, applied_at_ms long"


def _old_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations without a scope: one an event, 40 operation ids, some of unknown memories."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("op"), (F.col("event_id") % 40).cast("string")).alias("operation_id"), F.col("user_id").cast("string").alias("memory_id"), F.col("event_type").alias("kind"),
        F.lit("").alias("payload_json"), F.lit("applied").alias("state"), F.floor(F.col("event_id") / 7).alias("created_at_ms"), F.lit(None).cast("long").alias("applied_at_ms"),
    )


def journal_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes for operations that had none, from their memories."""
    ops = _old_operations(spark, sf_dir).groupBy("operation_id", "memory_id", "created_at_ms").agg(F.min("kind").alias("kind"))
    return changes.scoped_journal(ops, memories(spark, sf_dir, False).withColumn("id", F.col("id").cast("string")))


JOURNAL = f"""WITH {MEM}, o AS (SELECT 'op' || (event_id % 40) AS operation_id, CAST(user_id AS VARCHAR) AS memory_id, event_id // 7 AS created_at_ms, min(event_type) AS kind FROM events GROUP BY ALL)
SELECT tenant_id, namespace, operation_id, memory_id, o.kind AS kind, o.created_at_ms AS created_at_ms FROM o JOIN mem ON memory_id = CAST(id AS VARCHAR)
QUALIFY row_number() OVER (PARTITION BY tenant_id, namespace, operation_id ORDER BY o.created_at_ms, memory_id) = 1"""


def store_migrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of the second schema (a journal without scopes) is opened: its operations in their scopes, its rows as before."""
    store = filled(spark, sf_dir)
    one = edge(store, F.max)
    old = spark.createDataFrame([("op", one, "remember", "", "applied", 5, 6), ("lost", "no", "remember", "", "applied", 5, 6)], OPS).withColumn("version", F.lit(1).cast("long"))
    old.write.parquet(f"{store.path}/ops-old")
    store.commits.follow({k: v for k, v in store.manifest.items() if k != "scheme"} | {"schema_version": 2, "journal": ["ops-old"]})
    again = MemoryStore(spark, store.path, store.dims, store.model)
    rows = F.lit(again.memories().where("enc_version = 0").count()).cast("long")
    return again.operations().select("tenant_id", "namespace", "operation_id", "memory_id", "state", rows.alias("n"), F.lit(again.manifest["schema_version"]).alias("schema_version"))


MIGRATE = f"WITH {MEM} SELECT 't0' AS tenant_id, 'ns0' AS namespace, 'op' AS operation_id, CAST({edge_sql('max')} AS VARCHAR) AS memory_id, 'applied' AS state, (SELECT count(*) FROM mem) AS n, 4 AS schema_version"


# ------------------------------------------------ the vector index


def loaded(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """An index of all vectors with their metadata, by one bulk load."""
    made = VectorIndex(spark, f"{shared_dir(spark)}/tessera/index-{uuid.uuid4().hex}", len(vector_of(spark, sf_dir, 0)))
    made.load(index(spark, sf_dir))
    return made


def index_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New ids follow the highest one ever used, also after it was deleted and merged away."""
    made = loaded(spark, sf_dir)
    new = made.insert(np.ones((3, made.dims), np.float32))
    if not made.delete(new[2]) or made.delete(new[2] + 99):
        raise ValueError("delete does not tell whether the id was there")
    made.compact()
    made.insert(np.ones(made.dims, np.float32))
    return made.rows().select("id")


INSERT = "SELECT vec_id AS id FROM embeddings UNION ALL SELECT (SELECT max(vec_id) FROM embeddings) + k FROM (VALUES (1), (2), (4)) AS v(k)"


def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors replaced without metadata keep theirs, unless they were deleted in between; before and after compaction."""
    made = loaded(spark, sf_dir)
    made.compact()
    made.load(index(spark, sf_dir).where("id % 3 = 0").select("id", F.transform("embedding", lambda x: x * 2).alias("embedding")))
    made.delete(1)
    made.insert_with_ids([1, 2, 2], np.stack([np.full(made.dims, v, np.float32) for v in (5, 6, 7)]))
    shown = lambda place: made.rows().select("id", F.round(F.col("embedding")[0].cast("double"), 5).alias("first"), F.col("metadata")["label"][0].alias("label"), F.lit(place).alias("place"))
    before = shown("deltas")
    made.compact()
    return before.union(shown("base"))


UPSERT = f"""WITH {IDX} SELECT id, round(CASE WHEN id = 1 THEN 5.0 WHEN id = 2 THEN 7.0 WHEN id % 3 = 0 THEN 2 * e[1] ELSE e[1] END, 5) AS first,
CASE WHEN has AND id <> 1 THEN CAST(label AS VARCHAR) END AS label, place FROM idx, (VALUES ('deltas'), ('base')) AS p(place)"""


def index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts while deltas lie over a base, after compaction, and after a drain."""
    made = loaded(spark, sf_dir)
    made.compact()
    made.insert(np.zeros((3, made.dims), np.float32))
    made.delete(2)
    out = [made.counts().withColumn("place", F.lit("deltas"))]
    made.compact()
    out.append(made.counts().withColumn("place", F.lit("base")))
    drained = made.drain()
    if drained.count() != out[1].first()["len"]:
        raise ValueError("a drain lost rows")
    return out[0].union(out[1]).union(made.counts().withColumn("place", F.lit("drained")))


COUNTS = """WITH n AS (SELECT count(*) AS n FROM embeddings)
SELECT CAST(3 AS BIGINT) AS delta_len, CAST(1 AS BIGINT) AS num_sealed, n + 4 AS physical_len, n + 2 AS len, 'deltas' AS place FROM n
UNION ALL SELECT 0, 1, n + 2, n + 2, 'base' FROM n UNION ALL SELECT 0, 0, 0, 0, 'drained'"""


def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filtered search of base and deltas through kept lists, all of which are probed in the end."""
    made = loaded(spark, sf_dir)
    made.compact()
    made.delete(3)
    found = made.probe(vector_of(spark, sf_dir, 3), 10, 1 << 20, {"eq": {"field": "label", "value": "3"}})
    return found.select("id", F.round("distance", 6).alias("distance"))


SEARCH = f"WITH {IDX} SELECT id, round({sql_distance('l2', 'e', q(3))}, 6) AS distance FROM idx WHERE has AND label = 3 AND id <> 3 ORDER BY {sql_distance('l2', 'e', q(3))}, id LIMIT 10"


FOUND = {
    store_ingest: INGEST, store_remember: REMEMBER, store_update: UPDATE, store_forget: FORGET, store_recover: RECOVER, store_vacuum: VACUUM, store_health: HEALTH, store_backup: BACKUP,
    store_lookup: LOOKUP, store_find: FIND, store_migrate: MIGRATE, journal_migration: JOURNAL, index_insert: INSERT, index_upsert: UPSERT, index_counts: COUNTS, index_search: SEARCH,
}


def queries() -> dict:
    return {f.__name__: f for f in FOUND}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: sql for f, sql in FOUND.items()}
