"""Lifecycle of the memory store on small literal rows."""

import uuid

import pytest
from pyspark.sql import functions as F

from tessera.errors import EngineError
from tessera.functions.crypto import FixedKey
from tessera.model import MemoryFilter, Recall, Remember, Scope, Scoring, Update
from tessera.operators.context import ContextOptions
from tessera.sources.embed import DeterministicEmbedder
from tessera.sources.store import MemoryStore, TextStore

A = Scope("acme", "support")
NOW = 1_000_000


@pytest.fixture
def place(tmp_path):
    return f"file://{tmp_path}/store"


def mem(scope=A, content="text", v=(1.0, 0.0, 0.0), **k):
    return Remember(scope, content, list(v), **{"importance": 0.8} | k)


def ids(df):
    return [r["id"] for r in df.orderBy("rank").collect()]


def test_idempotent_remember_and_scope(spark, place):
    s = MemoryStore(spark, place, 3, "m")
    a = s.remember(mem(operation_id="op"), NOW)
    assert s.remember(mem(operation_id="op"), NOW) == a
    with pytest.raises(EngineError):
        s.remember(mem(content="other", operation_id="op"), NOW)
    got = s.recall(Recall(A, [1, 0, 0], NOW)).collect()
    assert len(got) == 1 and got[0]["explanation"]["similarity"] == pytest.approx(1.0) and got[0]["score"] > 0.8
    assert not s.recall(Recall(Scope("globex", "support"), [1, 0, 0], NOW)).collect()


@pytest.mark.parametrize("how", ["tenant", "kind", "deleted"])
def test_widening_finds_the_target(spark, place, how):
    s = MemoryStore(spark, place, 3, "m")
    other = Scope("b", "support") if how == "tenant" else A
    many = s.remember_batch([mem(other) for _ in range(20)], NOW)
    target = s.remember(mem(v=(0.8, 0.6, 0), kind="preference"), NOW)
    if how == "deleted":
        s.forget_batch(A, many, NOW)
    f = MemoryFilter(kinds=["preference"]) if how == "kind" else MemoryFilter()
    assert ids(s.recall(Recall(A, [1, 0, 0], NOW, limit=1, filters=f))) == [target]


def test_update_conflict_then_forget(spark, place):
    s = MemoryStore(spark, place, 3, "m")
    a = s.remember(mem(metadata={"k": 1}), NOW)
    with pytest.raises(EngineError, match="RevisionConflict"):
        s.update(Update(A, a, expected_revision=99, importance=0.9), NOW)
    assert s.update(Update(A, a, expected_revision=1, content="new", embedding=[0, 1, 0], importance=0.9, kind="preference", metadata={"j": "x"}), NOW + 1) == 2
    row = s.get(A, a)
    assert (row["content"], row["kind"], row["revision"], row["metadata"]) == ("new", "preference", 2, {"k": "1", "j": '"x"'})
    s.forget(A, a, NOW + 2)
    assert s.get(A, a) is None and s.get(A, a, active_only=False)["status"] == "deleted"
    assert not s.recall(Recall(A, [0, 1, 0], NOW)).collect()
    with pytest.raises(EngineError, match="NotFound"):
        s.forget(A, a, NOW)


def test_mmr_and_hybrid(spark, place):
    s = MemoryStore(spark, place, 3, "m")
    a, b, c = s.remember_batch([mem(importance=0.9), mem(v=(0.99, 0.01, 0), importance=0.89), mem(v=(0.7, 0.7, 0), importance=0.85)], NOW)
    assert ids(s.recall(Recall(A, [1, 0, 0], NOW, limit=2, mmr_lambda=0.5))) == [a, c]
    p = s.remember(mem(content="My name is Priya", v=(0, 0, 1), importance=0.9, kind="preference"), NOW)
    got = {r["id"]: r["explanation"]["policy_notes"] for r in s.recall(Recall(A, [1, 0, 0], NOW, text="Priya", limit=5)).collect()}
    assert "fts5_lexical_candidate" in got[p] and "fts5_lexical_candidate" not in got[b]


def test_metadata_is_typed_and_time_bounds_are_inclusive(spark, place):
    s = MemoryStore(spark, place, 3, "m")
    a = s.remember(mem(metadata={"session_id": 42, "confidential": True}), 1000)
    b = s.remember(mem(metadata={"session_id": 99, "confidential": False}), 2000)
    ask = lambda f: set(ids(s.recall(Recall(A, [1, 0, 0], 5000, filters=f))))
    assert ask(MemoryFilter(metadata={"session_id": 99})) == {b}
    assert ask(MemoryFilter(metadata={"confidential": True})) == {a}
    assert ask(MemoryFilter(metadata={"session_id": "99"})) == set()
    assert ask(MemoryFilter(metadata={"session_id": 99.0})) == set()
    assert ask(MemoryFilter(created_after_ms=2000, created_before_ms=2000)) == {b}
    assert ask(MemoryFilter(created_after_ms=3000, created_before_ms=1000)) == set()


def test_vacuum_health_expiry_backup(spark, place, tmp_path):
    s = MemoryStore(spark, place, 3, "m")
    made = s.remember_batch([mem() for _ in range(5)], NOW)
    s.remember(mem(expires_at_ms=NOW + 10), NOW)
    assert len(ids(s.recall(Recall(A, [1, 0, 0], NOW + 9)))) == 6 and len(ids(s.recall(Recall(A, [1, 0, 0], NOW + 10)))) == 5
    s.forget_batch(A, made[:3], NOW)
    h = s.health().first()
    assert (h["active_memories"], h["tombstoned_memories"], h["pending_operations"]) == (3, 3, 0)
    s.backup(f"file://{tmp_path}/copy")
    assert s.vacuum(2, NOW) == 2 and s.vacuum(0, NOW) == 0 and s.vacuum(10, NOW + 10) == 2
    assert s.health().first()["active_memories"] == 2
    copy = MemoryStore(spark, f"file://{tmp_path}/copy", 3, "m")
    assert copy.health().first()["tombstoned_memories"] == 3


def test_recovery_and_reopen(spark, place):
    s = MemoryStore(spark, place, 3, "m")
    a = s.remember(mem(), NOW)
    s.set_status(A, [a], "pending")
    assert not s.recall(Recall(A, [1, 0, 0], NOW)).collect()
    assert ids(MemoryStore(spark, place, 3, "m").recall(Recall(A, [1, 0, 0], NOW))) == [a]
    for dims, model in ((4, "m"), (3, "n")):
        with pytest.raises(EngineError):
            MemoryStore(spark, place, dims, model)


def test_second_writer_is_refused(spark, place):
    one, two = MemoryStore(spark, place, 3, "m"), MemoryStore(spark, place, 3, "m")
    two.remember(mem(), NOW)
    with pytest.raises(EngineError, match="StoreBusy"):
        one.remember(mem(), NOW)


def test_encryption(spark, place, tmp_path):
    plain = MemoryStore(spark, place, 3, "m")
    old = plain.remember(mem(content="legacy words"), NOW)
    s = MemoryStore(spark, place, 3, "m", keys=FixedKey(), lexical_mode="blind_index")
    new = s.remember(mem(content="strictly technical matter"), NOW)
    assert s.get(A, old)["content"] == "legacy words" and s.get(A, new)["content"] == "strictly technical matter"
    raw = b"".join(p.read_bytes() for p in (tmp_path / "store").rglob("*.parquet"))
    assert b"technical" not in raw
    got = {r["id"]: r for r in s.recall(Recall(A, [1, 0, 0], NOW, text="technical")).collect()}
    assert "fts5_lexical_candidate" in got[new]["explanation"]["policy_notes"] and got[new]["content"] == "strictly technical matter"
    with pytest.raises(EngineError, match="KeyUnavailable"):
        MemoryStore(spark, place, 3, "m")
    wrong = MemoryStore(spark, place, 3, "m", keys=FixedKey(b"x" * 32), lexical_mode="blind_index")
    with pytest.raises(Exception):
        wrong.get(A, new)


def test_scoring(spark, place):
    s = MemoryStore(spark, place, 3, "m")
    s.remember(mem(), NOW)
    row = s.recall(Recall(A, [1, 0, 0], NOW + 2 * 86_400_000, scoring=Scoring(0.9, 0.1, 0, 0, 1))).first()
    assert row["score"] == pytest.approx(0.98, abs=1e-6) and row["explanation"]["policy_notes"][0].startswith("custom_scoring(")
    assert row["explanation"]["recency"] == pytest.approx(0.1353352832)


@pytest.mark.parametrize("bad", [dict(similarity=-1), dict(similarity=float("nan")), dict(similarity=float("inf")), dict(similarity=0, importance=0, recency=0, reinforcement=0), dict(half_life_days=0)])
def test_bad_scoring(bad):
    with pytest.raises(EngineError):
        Scoring(**bad)


def test_text_store_and_context(spark, place):
    e = DeterministicEmbedder(8)
    t = TextStore(MemoryStore(spark, place, 8, "deterministic"), e)
    assert e.embed("a") == e.embed("a") != e.embed("b")
    with pytest.raises(EngineError):
        DeterministicEmbedder(0)
    t.remember(A, "User prefers dark mode UI theme.", NOW, kind="preference")
    out = t.format_context(A, "dark mode", NOW, ContextOptions(500, "* [{kind}] {content} (relevance: {score:.2})", "Head", "Foot"))
    assert out.startswith("Head\n* [preference] User prefers dark mode UI theme. (relevance: ") and out.endswith("Foot")
    assert t.format_context(A, "dark mode", NOW, ContextOptions(3, header="Head")) == "Head\n"


HOSTILE = ['"', "a OR b", "NEAR(a b)", "((", "'; DROP TABLE x; --", "*", "-", "\U0001f600\0", "a" * 5000]


def test_hostile_queries(spark, place):
    s = MemoryStore(spark, place, 3, "m")
    s.remember(mem(content="a b c"), NOW)
    for text in HOSTILE:
        assert len(s.recall(Recall(A, [1, 0, 0], NOW, text=text)).collect()) == 1


def test_isolation_over_many_scopes(spark, place):
    s = MemoryStore(spark, place, 4, "m")
    state, rows = 0xDEADBEEF, []
    for i in range(100):
        state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
        x = state >> 33
        scope = Scope(f"t{x % 5}", f"n{x // 5 % 3}", f"a{x // 15 % 2}", f"u{x // 30 % 2}")
        rows.append(Remember(scope, f"word{x // 60 % 5} text", [(x >> k & 255) / 255 for k in (0, 4, 8, 12)], id=str(uuid.UUID(int=i))))
    s.remember_batch(rows, NOW)
    for t in range(5):
        for n in range(3):
            got = s.recall(Recall(Scope(f"t{t}", f"n{n}"), [1, 0, 0, 0], NOW, text="word1", limit=50)).select("id", "tenant_id", "namespace").collect()
            assert all((r["tenant_id"], r["namespace"]) == (f"t{t}", f"n{n}") for r in got)
            assert {r["id"] for r in got} == {r.id for r in rows if (r.scope.tenant_id, r.scope.namespace) == (f"t{t}", f"n{n}")}


def test_bulk_load(spark, place):
    s = MemoryStore(spark, place, 2, "m")
    rows = spark.range(50).select(F.col("id").cast("string").alias("id"), F.lit("acme").alias("tenant_id"), F.lit("support").alias("namespace"), F.lit("x").alias("content"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    s.ingest(rows, NOW)
    assert s.rebuild_index() == 50
