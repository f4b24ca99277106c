"""Vectors, filters, change feeds, streams and the SQL of the registered queries."""

import tracemalloc

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.errors import EngineError
from tessera.functions import crypto, filters, lexical
from tessera.functions.vectors import distance, paired, vector
from tessera.operators import changes, knn
from tessera.plans import catalog
from tessera.streaming.feed import SnapshotSink

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(spark, metric, a, b):
    return spark.range(1).select(distance(metric, vector(a), vector(b)).alias("d")).first()["d"]


@pytest.mark.parametrize("metric,a,b,want", [("l2", [1, 2, 3], [4, 5, 6], 27), ("l2", [1, 2, 3], [1, 2, 3], 0), ("cosine", [1, 2, 3], [1, 2, 3], 0), ("cosine", [1, 0], [0, 1], 1), ("cosine", [0, 0], [1, 0], 1), ("DOT", [1, 0, 0], [2, 0, 0], -2)])
def test_metrics(spark, metric, a, b, want):
    assert value(spark, metric, a, b) == pytest.approx(want, abs=1e-9)


def test_unknown_metric(spark):
    with pytest.raises(EngineError):
        value(spark, "manhattan", [1], [1])


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v], m) for i, v, m in rows], "id long, embedding array<float>, metadata map<string,array<string>>")


def test_top_k_edges(spark):
    rows = vectors(spark, [(i, [i, 0], {"color": ["red" if i % 2 else "blue"]}) for i in range(1, 101)])
    assert [r["id"] for r in knn.top_k(rows, [50.0, 0.0], 5).collect()][0] == 50
    red = knn.top_k(rows, [50.0, 0.0], 10, where=filters.parse_simple({"color": "red"})).collect()
    assert len(red) == 10 and all(r["id"] % 2 for r in red)
    assert not knn.top_k(rows, [0.0, 0.0], 0).collect() and not knn.top_k(rows.limit(0), [0.0, 0.0], 3).collect()
    assert knn.top_k(rows, [0.0, 0.0], 1000).count() == 100
    with pytest.raises(Exception, match="DimensionMismatch"):
        knn.top_k(rows, [0.0, 0.0, 0.0], 3).collect()


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_block_path_equals_expressions(spark, sf, metric):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    asked = rows.where("id < 3").select(F.col("id").alias("query_id"), "embedding")
    got = {(r["query_id"], r["rank"]): r["id"] for r in knn.batch_top_k(rows, asked, 7, metric).collect()}
    for r in asked.collect():
        want = [x["id"] for x in knn.top_k(rows, list(r["embedding"]), 7, metric).collect()]
        assert want == [got[r["query_id"], k] for k in range(1, 8)]


def test_many_queries_in_blocks_equal_one_block(spark, sf, monkeypatch):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding").where("id < 90")
    asked = rows.where("id < 12").select(F.col("id").alias("query_id"), "embedding")
    want = knn.batch_top_k(rows, asked, 4, "cosine").collect()
    monkeypatch.setattr(knn, "QUERY_BLOCK", 5)
    monkeypatch.setattr(knn, "VECTOR_BLOCK", 40)
    assert sorted(knn.batch_top_k(rows, asked, 4, "cosine").collect()) == sorted(want) and len(want) == 48


def test_filter_semantics(spark):
    rows = vectors(spark, [(1, [0], {"c": ["red"], "s": ["large"]}), (2, [0], {"c": ["red"], "s": ["small"]}), (3, [0], {"c": ["blue"]}), (4, [0], None)])
    ids = lambda e: {r["id"] for r in rows.where(filters.parse(e)).collect()}
    eq = lambda f, v: {"eq": {"field": f, "value": v}}
    assert ids(eq("c", "red")) == {1, 2} and ids({"and": [eq("c", "red"), eq("s", "large")]}) == {1}
    assert ids({"not": eq("c", "red")}) == {3} and ids({"and": []}) == ids({"or": []}) == set()
    assert ids({"in": {"field": "c", "values": ["blue", "x"]}}) == {3}
    for bad in ({}, {"eq": {"field": "a", "value": "b"}, "not": {}}, {"xor": []}, {"eq": {"field": "a"}}):
        with pytest.raises(EngineError):
            filters.parse(bad)
    assert filters.selectivity(rows, filters.parse(eq("c", "red"))).first()[0] == pytest.approx(2 / 3)
    assert filters.selectivity(rows.limit(0), filters.parse(eq("c", "red"))).first()[0] == 1.0


def test_latest_version_wins(spark):
    feed = spark.createDataFrame([(1, "insert", 42, [1.0, 0.0]), (2, "insert", 42, [0.0, 9.0]), (3, "insert", 7, [1.0, 1.0]), (4, "delete", 7, None)], "seq long, op string, id long, embedding array<float>")
    assert [(r["id"], list(r["embedding"])) for r in changes.live(feed).collect()] == [(42, [0.0, 9.0])]
    assert changes.next_id(feed) == 43 and changes.next_id(feed.limit(0)) == 1
    snap = vectors(spark, [(7, [5, 5], None), (8, [1, 2], {"a": ["b"]})])
    full = feed.withColumn("metadata", F.lit(None).cast("map<string,array<string>>"))
    assert {r["id"] for r in changes.overlay(snap, full).collect()} == {8, 42}


def test_snapshot_sink_repeats_and_compacts(spark, tmp_path):
    sink = SnapshotSink(spark, f"file://{tmp_path}/s", ["id"], "seq", "seq long, op string, id long", compact_at=2)
    batch = lambda *r: spark.createDataFrame(list(r), "seq long, op string, id long")
    sink.apply(batch((1, "insert", 1), (2, "insert", 2)), 0)
    sink.apply(batch((9, "delete", 1)), 0)  # a repeated batch number changes nothing
    sink.apply(batch((3, "delete", 2)), 1)
    assert [r["id"] for r in sink.read().collect()] == [1]


def test_sealing_and_blind_tokens(spark):
    import hashlib
    import hmac

    key = b"k" * 16
    df = spark.createDataFrame([("t", "1", "secret"), ("t", "2", None)], "tenant string, id string, text string").withColumn("s", crypto.seal(F.col("text"), key, F.col("tenant"), F.col("id"), "c"))
    row = df.select("s", crypto.unseal(F.col("s"), key, F.col("tenant"), F.col("id"), "c").alias("o"), crypto.unseal(F.col("s"), b"x" * 16, F.col("tenant"), F.col("id"), "c", False).alias("w")).collect()
    assert row[0]["o"] == "secret" and row[0]["w"] is None and row[1]["o"] is None and "secret" not in row[0]["s"]
    got = spark.range(1).select(lexical.keyed(key, F.lit("word")).alias("h")).first()["h"]
    assert got == hmac.new(key, b"word", hashlib.sha256).hexdigest()[:32] == lexical.keyed_word(key, "word")


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    fix = lambda x: round(float(x), 5) if isinstance(x, float) or type(x).__name__ == "Decimal" else x
    return sorted((tuple(fix(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, duck, sf, name):
    df = catalog.queries()[name](spark, sf)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    res = duck.execute(catalog.oracle_sql()[name])
    assert got == plain(res.fetchall(), [d[0] for d in res.description])


def test_ann_recall(spark, sf):
    row = catalog.queries()["ann_recall_at_k"](spark, sf).first()
    assert row["recall"] >= 0.85 and row["pairs"] == 250


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def probed_by_hand(rows, centres, asked, k, probes):
    """The k nearest rows of each query among the rows of its probes nearest lists."""
    x = {r["id"]: np.array(r["embedding"], np.float64) for r in rows}
    away = lambda a, b: float(((a - b) ** 2).sum())
    home = {i: min(range(len(centres)), key=lambda j: (away(v, centres[j]), j)) for i, v in x.items()}
    out = set()
    for q in asked:
        v = np.array(q["embedding"], np.float64)
        lists = sorted(range(len(centres)), key=lambda j: (away(v, centres[j]), j))[:probes]
        best = sorted((round(away(v, x[i]), 9), i) for i in x if home[i] in lists)[:k]
        out |= {(q["query_id"], rank + 1, i) for rank, (_, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("probes", [1, 3, 7])
def test_probed_lists_meet_blocks_of_queries(spark, monkeypatch, probes):
    """no pair of a query and a row is shuffled; lists longer than a part, empty lists and repeated vectors included."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(150, 6)), rng.normal(size=(1, 6)).repeat(90, 0)])
    rows = vectors(spark, [(i, v, None) for i, v in enumerate(x)]).drop("metadata")
    asked = rows.where("id % 12 = 0").select(F.col("id").alias("query_id"), "embedding")
    centres = np.concatenate([x[[3, 40, 80, 149, 200]], np.full((2, 6), 1e3)])
    monkeypatch.setattr(knn, "QUERY_BLOCK", 6)
    monkeypatch.setattr(knn, "VECTOR_BLOCK", 50)
    got = knn.probed_top_k(knn.with_list(rows, centres), centres, asked, 4, probes)
    assert {(r["query_id"], r["rank"], r["id"]) for r in got.collect()} == probed_by_hand(rows.collect(), centres, asked.collect(), 4, probes)
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()


def test_few_pairs_are_computed_component_by_component(monkeypatch):
    """the exact side meets most pairs in a matrix product only."""
    x, seen = np.random.default_rng(6).normal(size=(9000, 16)), []
    monkeypatch.setattr(knn, "paired", lambda m, a, b: seen.append(a.shape[1]) or paired(m, a, b))
    near = knn.Nearest("l2", x[:600], 10)
    near.add(np.arange(9000), x)
    at, _, ids, d = near.found()
    assert sum(seen) < 0.03 * 600 * 9000 and len(ids) == 6000 and (ids[::10] == np.arange(600)).all() and not d[::10].any()


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_many_queries_need_the_memory_of_a_tile(metric):
    """a block of 4096 queries held all its distances to 4096 rows, and sorted them: 642 MB."""
    rng = np.random.default_rng(7)
    x, q = rng.normal(size=(8192, 32)), rng.normal(size=(4096, 32))
    tracemalloc.start()
    near = knn.Nearest(metric, q, 10)
    near.add(np.arange(8192), x)
    assert len(near.found()[0]) == 40960 and tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()


@pytest.mark.parametrize("metric", ["cosine", "dot"])
def test_equal_vectors_tie_in_blocks(spark, metric, monkeypatch):
    """a matrix product's last bits depend on where a vector stands, so the last of seven equal ones came first."""
    rng = np.random.default_rng(0)
    rows = vectors(spark, [(i, v, None) for i, v in enumerate(rng.normal(size=(1, 64)).repeat(7, 0))]).drop("metadata").coalesce(1)
    asked = vectors(spark, [(i, v, None) for i, v in enumerate(rng.normal(size=(12, 64)))]).select(F.col("id").alias("query_id"), "embedding").coalesce(1)
    want = {(q, rank + 1, rank) for q in range(12) for rank in range(4)}
    assert {(r["query_id"], r["rank"], r["id"]) for r in knn.batch_top_k(rows, asked, 4, metric).collect()} == want
    monkeypatch.setattr(knn, "QUERY_BLOCK", 5)
    monkeypatch.setattr(knn, "VECTOR_BLOCK", 3)
    assert {(r["query_id"], r["rank"], r["id"]) for r in knn.batch_top_k(rows, asked, 4, metric).collect()} == want
