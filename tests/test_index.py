"""The stored vector index, schema migration and overlays, on small literal rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.errors import EngineError
from tessera.model import Remember, Scope
from tessera.operators import changes, knn
from tessera.sources.index import VectorIndex
from tessera.sources.store import MemoryStore

A = Scope("acme", "support")


@pytest.fixture
def made(spark, tmp_path):
    return VectorIndex(spark, f"file://{tmp_path}/index", 2)


def vectors(*rows):
    return np.array(rows, np.float32)


def found(df):
    return [r["id"] for r in df.collect()]


def test_arrays_are_checked(made):
    with pytest.raises(TypeError):
        made.insert(np.zeros((1, 2)))
    with pytest.raises(TypeError):
        made.insert([[0.0, 0.0]])
    with pytest.raises(ValueError):
        made.insert(np.zeros((2, 4), np.float32)[:, ::2])
    with pytest.raises(EngineError, match="DimensionMismatch"):
        made.insert(np.zeros(3, np.float32))
    with pytest.raises(EngineError, match="InvalidInput"):
        made.insert(vectors([1, 2]), [])
    assert made.insert(vectors([1, 2])[0]) == [1] and made.rows().first()["metadata"] is None


def test_ids_deletion_and_counts(spark, made):
    assert made.insert(vectors([0, 0], [1, 0], [2, 0]), [{"c": ["x"]}, None, {"c": ["y", "z"]}]) == [1, 2, 3]
    assert made.delete(3) and not made.delete(3)
    made.compact()
    assert made.insert(vectors([9, 0])) == [4]
    made.insert_with_ids([10, 1, 1], vectors([3, 0], [8, 0], [7, 0]))
    assert made.insert(vectors([5, 5])) == [11]
    assert tuple(made.counts().first()) == (4, 1, 6, 5)
    again = VectorIndex(spark, made.path, 2)
    rows = {r["id"]: (list(r["embedding"]), r["metadata"]) for r in again.rows().collect()}
    assert rows == {1: ([7, 0], {"c": ["x"]}), 2: ([1, 0], None), 4: ([9, 0], None), 10: ([3, 0], None), 11: ([5, 5], None)}
    assert again.compact() == 5 and {r["id"] for r in again.drain().collect()} == set(rows)
    assert tuple(again.counts().first()) == (0, 0, 0, 0) and again.compact() == 0 and not found(again.search([0, 0], 3))
    with pytest.raises(EngineError, match="StoreBusy"):
        made.delete(10)  # another writer has committed since


def test_searches(spark, made):
    assert not found(made.probe([0.0, 0.0], 3, 1))
    x = np.random.default_rng(5).normal(size=(300, 2)).astype(np.float32)
    ids = made.insert(x, [{"m": [str(i % 50)]} for i in range(300)])
    made.compact(lists=12)
    made.insert_with_ids([1000], vectors([0, 0]))
    assert found(made.search([0.0, 0.0], 1)) == found(made.probe([0.0, 0.0], 1, 1)) == [1000]
    assert found(made.probe([0.3, 0.1], 20, 12)) == found(made.search([0.3, 0.1], 20))
    rare = {"eq": {"field": "m", "value": "7"}}  # six rows: probes double until all lists are read
    assert found(made.probe([0.3, 0.1], 9, 1, rare)) == found(made.search([0.3, 0.1], 9, rare))
    hits = [len(set(found(made.probe(x[i].tolist(), 5, 4))) & set(found(made.search(x[i].tolist(), 5)))) for i in range(0, 300, 60)]
    assert sum(hits) >= 0.9 * 25 and len(ids) == 300
    with pytest.raises(EngineError, match="DimensionMismatch"):
        made.probe([0.0], 1, 1)


def test_only_probed_lists_are_read(made):
    made.insert(np.random.default_rng(6).normal(size=(200, 2)).astype(np.float32))
    made.compact(lists=8)
    plan = made.probe([0.0, 0.0], 1, 2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [list_id" in plan


def test_other_contract_is_refused(spark, made):
    for dims, metric in ((3, "l2"), (2, "dot")):
        with pytest.raises(EngineError, match="InvalidInput"):
            VectorIndex(spark, made.path, dims, metric)


def test_overlay_forgets_metadata_of_the_deleted(spark):
    snap = spark.createDataFrame([(i, [0.0], {"k": [str(i)]}) for i in range(4)], "id long, embedding array<float>, metadata map<string,array<string>>")
    log = [(1, "upsert", 0, [1.0], None), (1, "delete", 1, None, None), (2, "upsert", 1, [1.0], None), (1, "upsert", 2, [1.0], {"k": ["new"]}), (2, "upsert", 2, [2.0], None), (3, "delete", 3, None, None)]
    got = {r["id"]: r["metadata"] for r in changes.overlay(snap, spark.createDataFrame(log, changes.CHANGES)).collect()}
    assert got == {0: {"k": ["0"]}, 1: None, 2: {"k": ["new"]}}


@pytest.mark.parametrize("version", [1, 2, 3, 9])
def test_schema_migration(spark, tmp_path, version):
    s = MemoryStore(spark, f"file://{tmp_path}/store", 2, "m")
    a = s.remember(Remember(A, "text", [1.0, 0.0], operation_id="op"), 5)
    if version < 3:  # a journal without scopes, with an operation of a memory that is not there
        ops = s._newest("journal", spark.createDataFrame([], s.operations().schema).withColumn("version", F.lit(0).cast("long")).schema, ["operation_id"])
        ops.drop("tenant_id", "namespace").union(ops.drop("tenant_id", "namespace").withColumns({"operation_id": F.lit("x"), "memory_id": F.lit("none")})).write.parquet(f"{s.path}/ops-old")
    s.commits.follow(s.manifest | {"schema_version": version} | ({"journal": ["ops-old"]} if version < 3 else {}))
    if version == 9:
        with pytest.raises(EngineError, match="CorruptStore"):
            MemoryStore(spark, s.path, 2, "m")
        return
    again = MemoryStore(spark, s.path, 2, "m")
    assert again.manifest["schema_version"] == 4 and again.operations().count() == 1 and again.get(A, a)["enc_version"] == 0
    assert again.remember(Remember(A, "text", [1.0, 0.0], operation_id="op"), 6) == a
    assert [r["tenant_id"] for r in again.find(a).collect()] == ["acme"] and again.find("no").isEmpty()
