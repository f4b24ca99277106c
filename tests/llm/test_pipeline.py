"""The pipeline's stages, each against a plain restatement on its own input."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp

from . import brute
from .test_operators import expected_pieces, expected_targets


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    base = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = docs.orderBy("doc_id").limit(4)
    odd = first.union(first.withColumn("doc_id", F.lit(None).cast("long"))).union(first.withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 9000)).union(first.withColumn("source", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 9500))
    docs = docs.union(odd)
    out = [docs]
    for k, (name, f) in enumerate(cp.STAGES):
        f(spark, docs, sf).write.parquet(f"file://{base}/{k}")
        docs = spark.read.parquet(f"file://{base}/{k}")
        out.append(docs)
    return [d.collect() for d in out]


def test_columns(stages):
    assert all(set(rows[0].asDict()) == set(cp.COLUMNS) for rows in stages[1:5])


def test_quality_keeps_rows_whole(stages):
    before = collections.Counter(stages[0])
    assert not collections.Counter(stages[1]) - before and 0.7 * len(stages[0]) < len(stages[1]) < len(stages[0])


def test_near_dedup_links_from_80_percent(spark, sf):
    """A pair with a Jaccard of 0.8 to 0.85 loses its larger id, in the stage and by the operator's defaults."""
    w = [f"w{i}" for i in range(54)]
    pair = [" ".join(w), " ".join(w[:25] + ["x"] + w[26:])]
    a, b = (brute.shingle_set(t) for t in pair)
    assert 0.85 > len(a & b) / len(a | b) >= 0.8
    rows = [(1, pair[0]), (2, pair[1]), (3, "another text")]
    df = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = {i for i, _, _, k in brute.near(rows, 80) if k}
    assert want == {1, 3}
    assert {r["doc_id"] for r in cp.near_dedup(spark, df, sf).collect()} == want
    assert {r["doc_id"] for r in cp.minhash.one_of_each(df, "doc_id", "text").collect()} == want
    assert collections.Counter(map(tuple, cp.minhash.near_duplicates(df, "doc_id", "text").collect())) == collections.Counter(brute.near(rows, 80))


def test_near_dedup_tells_rows_that_share_an_id_apart(spark, sf):
    x, y, z = (" ".join(f"{c}{i}" for i in range(30)) for c in "xyz")
    case = lambda rows: sorted((r["doc_id"], r["text"]) for r in cp.minhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect())
    assert case([(1, x), (1, y), (5, y)]) == [(1, x), (1, y)]
    assert case([(0, x), (1, x), (1, y), (1, y)]) == [(0, x), (1, y)]
    assert case([(2, z), (2, z), (3, z), (2, x), (4, y), (2, " "), (2, "  ")]) == [(2, " "), (2, "  "), (2, x), (2, z), (4, y)]
    assert case([(7, x), (7, x)]) == [(7, x)]


def test_near_dedup(stages):
    """The stage links from 80 percent; rows without an id are copies of others here, and go."""
    rows = [(r["doc_id"], r["text"]) for r in stages[1]]
    want = {i for i, _, _, k in brute.near(rows, 80) if k}  # rows that repeat an id are equal here
    assert collections.Counter(r["doc_id"] for r in stages[2]) == collections.Counter(want) and None in {i for i, _ in rows}


def test_substring_dedup(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[2]]
    none = 10**12
    want = {i: (n, gone) for i, n, gone, _ in brute.dedup([(none if i is None else i, t) for i, t in rows])}
    texts = {i: t for i, t in rows}
    assert len(stages[3]) == len(rows)
    for r in stages[3]:
        if r["doc_id"] is None:
            continue
        n, gone = want[r["doc_id"]]
        assert len(brute.words(r["text"])) == n - gone and r["n_chars"] == len(r["text"])
        if not gone:
            assert r["text"] == texts[r["doc_id"]]


def test_mix(stages):
    sizes, taken = collections.Counter(), collections.Counter()
    for r in stages[3]:
        sizes[r["source"]] += len(brute.words(r["text"]))
    for r in stages[4]:
        taken[r["source"]] += len(brute.words(r["text"]))
    for s, want in expected_targets(sizes).items():
        assert abs(taken[s] - want) <= max(0.05 * want, 300)
    assert max(collections.Counter(r["doc_id"] for r in stages[4] if r["doc_id"] is not None).values()) <= 2


def test_pack(stages):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(cp.tokenizer_path())
    want = expected_pieces([(r["doc_id"], r["text"]) for r in stages[4]], tok, cp.CAPACITY)
    assert collections.Counter(tuple(r)[:5] for r in stages[5]) == collections.Counter(want)


def test_run(spark, sf):
    assert cp.run(spark, sf).count() > 0
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "source_mix", "pack"]
