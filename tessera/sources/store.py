"""The memory store: immutable parquet versions under a folder, and numbered manifests of which the last one holds.

A write adds a delta of full row versions and of journal entries and then commits the next manifest under a name that only
one writer can take, so a reader sees all of a batch or nothing and no commit is lost. Superseded files stay for readers
that have planned on them, until clean_up. Reading takes the newest version of each row with a map-side maximum. Compaction writes a new base,
partitioned by tenant and namespace, so a scoped query reads its own folders only.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError, invalid
from ..functions import crypto, filters, lexical
from ..model import KEEP, MEMORIES, OPERATIONS, SCHEMA_VERSION, Recall, Remember, Scope, Update, canonical_map
from ..operators import changes, context, recall
from .embed import Embedder, check_model
from .files import Commits, Files

#: Stored rows: the record, its blind tokens, the version, and whether it has been purged.
ROWS = T.StructType([*MEMORIES.fields, T.StructField("blind", T.ArrayType(T.StringType())), T.StructField("version", T.LongType()), T.StructField("purged", T.BooleanType())])
JOURNAL = T.StructType([*OPERATIONS.fields, T.StructField("version", T.LongType())])
KEY, OP_KEY = ["tenant_id", "namespace", "id"], ["tenant_id", "namespace", "operation_id"]
COMPACT_AT = 16


def content_hash(text: str) -> bytes:
    return hashlib.sha256(text.encode()).digest()[:8]


class MemoryStore:
    def __init__(self, spark: SparkSession, path: str, dims: int, model: str, max_recall_limit: int = 100, keys: crypto.KeyProvider | None = None, lexical_mode: str | None = None):
        if dims <= 0 or not model.strip() or max_recall_limit <= 0:
            raise invalid("dims and max_recall_limit must be positive and the model named")
        self.spark, self.path, self.dims, self.model, self.max_recall_limit, self.keys = spark, path.rstrip("/"), dims, model, max_recall_limit, keys
        self.lexical_mode = lexical_mode or ("disabled" if keys else "plaintext")
        crypto.check_lexical_mode(self.lexical_mode, keys is not None)
        self.files = Files(spark)
        self.commits = Commits(self.files, self.path)
        m = self.commits.latest()
        if m is None:
            m = {"schema_version": SCHEMA_VERSION, "dims": dims, "model": model, "scheme": "none", "commit": 0, "rows": [], "journal": [], "counts": {}}
        if m["schema_version"] != SCHEMA_VERSION:
            m = self._migrated(m)
        if m["dims"] != dims or m["model"] != model:
            raise invalid("the store was made with another model or other dimensions")
        crypto.check_contract(m["scheme"], keys)
        if keys is not None:
            keys.key()
            m["scheme"] = "aes-gcm-v1"
        self.manifest = m
        self._commit()
        self.check_integrity()
        self.recover()

    # ------------------------------------------------ versions

    def _commit(self) -> None:
        self.manifest = self.commits.follow(self.manifest)

    def _migrated(self, m: dict) -> dict:
        """The manifest of a store of an older schema, its files rewritten where the schema asks for it: 2 has a text index
        (nothing is kept here), 3 has scopes in the journal, 4 has sealing. The old files stay until clean_up."""
        version = m["schema_version"]
        if not 1 <= version < SCHEMA_VERSION:
            raise EngineError("CorruptStore", "unknown schema version")
        self.manifest = m = {"scheme": "none"} | m
        tag = f"{m['commit'] + 1}-{uuid.uuid4().hex[:12]}"
        if version < 3 and m["journal"]:
            old = self.spark.read.schema(JOURNAL).parquet(*[f"{self.path}/{n}" for n in m["journal"]]).select(*[n for n in JOURNAL.names if n not in KEY])
            scoped = changes.scoped_journal(changes.latest(old, ["operation_id"], "version"), self.stored())
            scoped.select(*JOURNAL.names).write.parquet(f"{self.path}/ops-{tag}")
            m = m | {"journal": [f"ops-{tag}"]}
        if m["rows"]:
            rows = self.stored().withColumn("enc_version", F.coalesce("enc_version", F.lit(0)))
            rows.write.parquet(f"{self.path}/delta-{tag}")
            m = m | {"rows": [f"delta-{tag}"], "counts": {f"delta-{tag}": self.spark.read.schema(ROWS).parquet(f"{self.path}/delta-{tag}").count()}}
        return m | {"schema_version": SCHEMA_VERSION}

    def _newest(self, kind: str, schema: T.StructType, key: list[str]) -> DataFrame:
        names = self.manifest[kind]
        if not names:
            return self.spark.createDataFrame([], schema)
        kinds = [[n for n in names if n.startswith("base-")], [n for n in names if not n.startswith("base-")]]  # a base has partition folders
        parts = [self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in k]).select(*[f.name for f in schema]) for k in kinds if k]
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        if len(names) == 1 and names[0].startswith("base-"):
            return rows  # one version of each row: no shuffle
        rest = [f.name for f in schema if f.name not in key]
        return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "version").alias("r")).select(*key, "r.*").select(*[f.name for f in schema])

    def stored(self) -> DataFrame:
        """Newest versions as they lie on disk, sealed fields sealed."""
        return self._newest("rows", ROWS, KEY).where("not purged")

    def memories(self) -> DataFrame:
        """Newest versions with plain content, in the columns of the data model."""
        rows = self.stored()
        if self.keys is not None:
            rows = rows.withColumn("content", crypto.unseal(F.col("content"), self.keys.key(), F.col("tenant_id"), F.col("id"), "content"))
        return rows.drop("version", "purged")

    def operations(self) -> DataFrame:
        return self._newest("journal", JOURNAL, OP_KEY).drop("version")

    def _write(self, rows: DataFrame | None, ops: list[tuple] | DataFrame | None = None) -> None:
        """One commit: full rows (columns of ROWS without version and purged, or with purged), and journal entries, as tuples
        or as a frame in the columns of OPERATIONS."""
        version = self.manifest["commit"] + 1
        tag = f"{version}-{uuid.uuid4().hex[:12]}"
        m = json.loads(json.dumps(self.manifest))
        if rows is not None:
            if "purged" not in rows.columns:
                rows = rows.withColumn("purged", F.lit(False))
            out = rows.withColumn("version", F.lit(version).cast("long")).select(*[F.col(f.name).cast(f.dataType) for f in ROWS])
            out.write.parquet(f"{self.path}/delta-{tag}")
            m["rows"].append(f"delta-{tag}")
            m["counts"][f"delta-{tag}"] = self.spark.read.schema(ROWS).parquet(f"{self.path}/delta-{tag}").count()
        if ops is not None and (isinstance(ops, DataFrame) or ops):
            entries = ops if isinstance(ops, DataFrame) else self.spark.createDataFrame(ops, OPERATIONS).coalesce(1)
            entries.withColumn("version", F.lit(version).cast("long")).select(*JOURNAL.names).write.parquet(f"{self.path}/ops-{tag}")
            m["journal"].append(f"ops-{tag}")
        before, self.manifest = self.manifest, m
        try:
            self._commit()
        except EngineError:
            self.manifest = before
            raise
        if len(m["rows"]) >= COMPACT_AT:
            self.compact()

    def compact(self) -> None:
        """Merges all versions into a new base; older files stay until clean_up."""
        tag = f"{self.manifest['commit'] + 1}-{uuid.uuid4().hex[:12]}"
        self.stored().repartition("tenant_id", "namespace", F.pmod(F.xxhash64("id"), F.lit(16))).write.partitionBy("tenant_id", "namespace").parquet(f"{self.path}/base-{tag}")
        n = self.spark.read.schema(ROWS).parquet(f"{self.path}/base-{tag}").count()
        before, self.manifest = self.manifest, self.manifest | {"rows": [f"base-{tag}"], "counts": {f"base-{tag}": n}}
        try:
            self._commit()
        except EngineError:
            self.manifest = before
            raise

    def clean_up(self, grace_ms: int = 3_600_000) -> int:
        """Deletes files that the last commit does not name and that are older than a grace period, which must exceed the
        longest read and write; returns how many."""
        kept = {*self.manifest["rows"], *self.manifest["journal"]}
        gone = [n for n in self.files.old_names(self.path, grace_ms) if n.startswith(("base-", "delta-", "ops-")) and n not in kept]
        gone += [f"commits/{n}" for n in self.files.old_names(f"{self.path}/commits", grace_ms) if n != f"{self.manifest['commit']:012d}.json"]
        for name in gone:
            self.files.delete(f"{self.path}/{name}")
        return len(gone)

    def check_integrity(self) -> None:
        """All files of the manifest are there with the rows it counts, by the footers of all of them in one job."""
        counts = self.manifest["counts"]
        if not all(self.files.exists(f"{self.path}/{n}") for n in [*self.manifest["rows"], *self.manifest["journal"]]):
            raise EngineError("CorruptStore", "stored files are missing")
        if counts and self.spark.read.schema("version long").option("recursiveFileLookup", "true").parquet(*[f"{self.path}/{n}" for n in counts]).count() != sum(counts.values()):
            raise EngineError("CorruptStore", "stored rows are missing")

    # ------------------------------------------------ writing

    def _frame(self, records: list[dict]) -> DataFrame:
        rows = self.spark.createDataFrame([tuple(r.get(f.name) for f in MEMORIES) for r in records], MEMORIES)
        return self._sealed(rows)

    def _sealed(self, rows: DataFrame) -> DataFrame:
        blind = F.lit(None).cast("array<string>")
        if self.keys is None:
            return rows.withColumn("blind", blind).withColumn("enc_version", F.lit(0))
        key = self.keys.key()
        if self.lexical_mode == "blind_index":
            blind = lexical.blind_tokens(key, F.col("content"))
        rows = rows.withColumn("blind", blind)
        return rows.withColumn("content", crypto.seal(F.col("content"), key, F.col("tenant_id"), F.col("id"), "content")).withColumn("enc_version", F.lit(1))

    def _record(self, r: Remember, now_ms: int) -> dict:
        return {
            "id": r.id or str(uuid.uuid4()), "tenant_id": r.scope.tenant_id, "namespace": r.scope.namespace, "agent_id": r.scope.agent_id, "user_id": r.scope.user_id,
            "kind": r.kind, "content": r.content, "content_hash": content_hash(r.content), "embedding": [float(x) for x in r.embedding], "embedding_model": self.model, "embedding_dims": self.dims,
            "importance": float(r.importance), "created_at_ms": now_ms, "updated_at_ms": now_ms, "last_accessed_at_ms": None, "access_count": 0, "expires_at_ms": r.expires_at_ms,
            "status": "active", "revision": 1, "metadata": canonical_map(r.metadata), "source": canonical_map(r.source), "enc_version": 0,
        }

    @staticmethod
    def _payload(r: Remember) -> str:
        return hashlib.sha256(json.dumps([r.content, [float(x) for x in r.embedding]]).encode()).hexdigest()

    def _operation(self, scope: Scope, operation_id: str | None):
        if operation_id is None:
            return None
        return self.operations().where((F.col("tenant_id") == scope.tenant_id) & (F.col("namespace") == scope.namespace) & (F.col("operation_id") == operation_id)).first()

    def _known(self, requests: list[Remember]) -> dict[tuple, tuple]:
        """(memory id, payload) of those requests' operations that the journal holds, from one join; at most one a request."""
        keys = {(r.scope.tenant_id, r.scope.namespace, r.operation_id) for r in requests if r.operation_id is not None}
        if not keys or not self.manifest["journal"]:
            return {}
        wanted = F.broadcast(self.spark.createDataFrame(sorted(keys), "tenant_id string, namespace string, operation_id string"))
        return {tuple(o[k] for k in OP_KEY): (o["memory_id"], o["payload_json"]) for o in self.operations().join(wanted, OP_KEY, "left_semi").collect()}

    def remember(self, r: Remember, now_ms: int) -> str:
        """Stores a memory. The same operation id with the same content and embedding gives the same memory."""
        return self.remember_batch([r], now_ms)[0]

    def remember_batch(self, requests: list[Remember], now_ms: int) -> list[str]:
        """All or nothing, in one commit; operation ids are honoured as for single writes."""
        ids, records, ops = [], [], []
        for r in requests:
            r.validate(self.dims)
        seen = self._known(requests)
        for r in requests:
            key = (r.scope.tenant_id, r.scope.namespace, r.operation_id)
            payload = self._payload(r)
            known = seen.get(key) if r.operation_id is not None else None
            if known is not None:
                if known[1] != payload:
                    raise invalid("the operation id was used with another payload")
                ids.append(known[0])
                continue
            record = self._record(r, now_ms)
            ids.append(record["id"])
            records.append(record)
            if r.operation_id is not None:
                seen[key] = record["id"], payload
                ops.append((*key, record["id"], "remember", payload, "applied", now_ms, now_ms))
        if records:
            self._write(self._frame(records), ops)
        return ids

    def ingest(self, rows: DataFrame, now_ms: int) -> None:
        """Bulk load of (id, tenant_id, namespace, content, embedding) and any further columns of the model."""
        ok = F.assert_true(F.size("embedding") == self.dims, F.lit("DimensionMismatch")).isNull()
        defaults = {"kind": F.lit("fact"), "importance": F.lit(0.5), "created_at_ms": F.lit(now_ms), "updated_at_ms": F.lit(now_ms), "access_count": F.lit(0), "status": F.lit("active"), "revision": F.lit(1), "embedding_model": F.lit(self.model), "embedding_dims": F.lit(self.dims), "content_hash": F.unhex(F.substring(F.sha2(F.encode("content", "UTF-8"), 256), 1, 16)), "metadata": F.create_map().cast("map<string,string>"), "source": F.create_map().cast("map<string,string>"), "enc_version": F.lit(0)}
        full = rows.where(ok).select(*[(F.col(f.name) if f.name in rows.columns else defaults.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in MEMORIES])
        self._write(self._sealed(full))

    def get(self, scope: Scope, memory_id: str, active_only: bool = True):
        rows = self.memories().where(filters.in_scope(scope) & (F.col("id") == memory_id))
        return (rows.where("status = 'active'") if active_only else rows).first()

    def find(self, memory_id: str) -> DataFrame:
        """The rows of an id in all scopes, of any status: for recovery and support, not for tenants."""
        return self.memories().where(F.col("id") == memory_id)

    def update(self, u: Update, now_ms: int) -> int:
        """Applies a patch if the expected revision holds; returns the new revision. Metadata keys are overwritten one by
        one; kind is stored too."""
        u.validate(self.dims)
        if self._operation(u.scope, u.operation_id):
            return int(self.get(u.scope, u.id, False)["revision"])
        row = self.get(u.scope, u.id, False)
        if row is None or row["status"] == "deleted":
            raise EngineError("NotFound", "no such memory")
        if u.expected_revision is not None and row["revision"] != u.expected_revision:
            raise EngineError("RevisionConflict", "the memory has another revision")
        new = row.asDict(recursive=True)
        for name in ("content", "embedding", "kind", "importance"):
            if getattr(u, name) is not None:
                new[name] = [float(x) for x in u.embedding] if name == "embedding" else getattr(u, name)
        if u.content is not None:
            new["content_hash"] = content_hash(u.content)
        if u.expires_at_ms is not KEEP:
            new["expires_at_ms"] = u.expires_at_ms
        if u.metadata is not None:
            new["metadata"] = {**(new["metadata"] or {}), **canonical_map(u.metadata)}
        new |= {"revision": row["revision"] + 1, "status": "active", "updated_at_ms": now_ms}
        ops = [(u.scope.tenant_id, u.scope.namespace, u.operation_id, u.id, "update", "", "applied", now_ms, now_ms)] if u.operation_id else None
        self._write(self._frame([new]), ops)
        return new["revision"]

    def forget(self, scope: Scope, memory_id: str, now_ms: int, operation_id: str | None = None) -> None:
        self.forget_batch(scope, [memory_id], now_ms, operation_id)

    def forget_batch(self, scope: Scope, ids: list[str], now_ms: int, operation_id: str | None = None) -> None:
        """Soft deletion, all or nothing. A repeated delete operation does nothing."""
        op = self._operation(scope, operation_id)
        if op is not None:
            if op["kind"] == "delete":
                return
            raise invalid("the operation id was used for another kind of operation")
        wanted = list(dict.fromkeys(ids))
        rows = self.stored().where(filters.in_scope(scope) & F.col("id").isin(wanted) & (F.col("status") != "deleted"))
        if rows.count() != len(wanted):
            raise EngineError("NotFound", "no such memory")
        ops = [(scope.tenant_id, scope.namespace, operation_id, ",".join(wanted), "delete", "", "applied", now_ms, now_ms)] if operation_id else None
        if wanted:
            self._write(rows.withColumn("status", F.lit("deleted")).withColumn("updated_at_ms", F.lit(now_ms)), ops)

    def recover(self) -> int:
        """Pending rows become active, also those written without an operation, and pending operations applied."""
        rows, ops = self.stored().where("status = 'pending'"), self.operations().where("state = 'pending'")
        n = rows.count() if self.manifest["rows"] else 0
        some = bool(self.manifest["journal"]) and not ops.isEmpty()
        if n or some:
            done = ops.withColumns({"state": F.lit("applied"), "applied_at_ms": F.col("created_at_ms")}) if some else None
            self._write(rows.withColumn("status", F.lit("active")) if n else None, done)
        return n

    def mark_applied(self, scope: Scope, operation_ids: list[str], now_ms: int) -> int:
        """Marks a scope's operations as applied, in one commit; returns how many were pending."""
        ops = self.operations().where((F.col("tenant_id") == scope.tenant_id) & (F.col("namespace") == scope.namespace) & F.col("operation_id").isin(list(operation_ids)) & (F.col("state") == "pending"))
        n = ops.count()
        if n:
            self._write(None, ops.withColumns({"state": F.lit("applied"), "applied_at_ms": F.lit(now_ms).cast("long")}))
        return n

    def set_status(self, scope: Scope, ids: list[str], status: str) -> None:
        rows = self.stored().where(filters.in_scope(scope) & F.col("id").isin(list(ids)))
        self._write(rows.withColumn("status", F.lit(status)))

    def vacuum(self, most: int, now_ms: int) -> int:
        """Purges up to most deleted or expired rows, by id; returns how many."""
        if most <= 0:
            return 0
        rows = self.stored().where(filters.vacuum_candidates(now_ms)).orderBy("id").limit(most)
        n = rows.count()
        if n:
            self._write(rows.withColumn("purged", F.lit(True)).withColumn("content", F.lit(None).cast("string")))
            self.compact()
            self.clean_up()
        return n

    def rebuild_index(self) -> int:
        """Compacts and returns the active rows of the right dimensions; searches are exact, so nothing else is kept."""
        self.compact()
        return self.stored().where((F.col("status") == "active") & (F.size("embedding") == self.dims)).count()

    # ------------------------------------------------ reading

    def recall(self, r: Recall) -> DataFrame:
        r.validate(self.dims)
        rows = self.memories()
        if self.lexical_mode != "plaintext" and r.text is not None:
            if self.lexical_mode == "disabled":
                r = replace(r, text=None)
            else:
                words = lexical.query_words(r.text)
                rows = rows.withColumn("plain", F.col("content")).withColumn("content", F.array_join(F.col("blind"), " "))
                r = replace(r, text=" ".join(lexical.keyed_word(self.keys.key(), w.lower()) for w in words) or None)
                return recall.recall(rows, r, self.dims, self.max_recall_limit).withColumn("content", F.col("plain")).drop("plain")
        return recall.recall(rows, r, self.dims, self.max_recall_limit)

    def format_context(self, r: Recall, options: context.ContextOptions = context.ContextOptions()) -> str:
        return context.format_context(self.recall(r), options).first()["context"]

    def health(self) -> DataFrame:
        pending = self.operations().where("state = 'pending'").count()
        counts = self.stored().agg(F.count(F.when(F.col("status") == "active", 1)).alias("active_memories"), F.count(F.when(F.col("status") == "deleted", 1)).alias("tombstoned_memories"))
        size = sum(self.files.size(f"{self.path}/{n}") for n in self.manifest["rows"])
        journal = sum(self.files.size(f"{self.path}/{n}") for n in self.manifest["journal"])
        return counts.select("*", F.lit(pending).cast("long").alias("pending_operations"), F.lit(size).cast("long").alias("database_bytes"), F.lit(journal).cast("long").alias("journal_bytes"), F.lit(True).alias("index_healthy"), F.lit(SCHEMA_VERSION).alias("schema_version"))

    def backup(self, to: str) -> None:
        """A copy of the committed version; later writes do not change it, as files are never rewritten."""
        m = json.loads(json.dumps(self.manifest))
        self.files.delete(to)
        for name in [*m["rows"], *m["journal"]]:
            self.files.copy(f"{self.path}/{name}", f"{to.rstrip('/')}/{name}")
        self.files.write_json(f"{to.rstrip('/')}/commits/{m['commit']:012d}.json", m)


class TextStore:
    """A store with an embedder: the same verbs from text."""

    def __init__(self, store: MemoryStore, embedder: Embedder):
        check_model(embedder, store.model, store.dims)
        self.store, self.embedder = store, embedder

    def remember(self, scope: Scope, content: str, now_ms: int, **rest) -> str:
        return self.store.remember(Remember(scope, content, self.embedder.embed(content), **rest), now_ms)

    def remember_batch(self, scope: Scope, texts: list[str], now_ms: int, **rest) -> list[str]:
        return self.store.remember_batch([Remember(scope, t, v, **rest) for t, v in zip(texts, self.embedder.embed_batch(texts))], now_ms)

    def update(self, scope: Scope, memory_id: str, content: str, now_ms: int, **rest) -> int:
        return self.store.update(Update(scope, memory_id, content=content, embedding=self.embedder.embed(content), **rest), now_ms)

    def recall(self, scope: Scope, text: str, now_ms: int, **rest) -> DataFrame:
        return self.store.recall(Recall(scope, self.embedder.embed(text), now_ms, text=text, **rest))

    def format_context(self, scope: Scope, text: str, now_ms: int, options: context.ContextOptions = context.ContextOptions(), **rest) -> str:
        return self.store.format_context(Recall(scope, self.embedder.embed(text), now_ms, text=text, **rest), options)
