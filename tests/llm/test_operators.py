"""Each operator against a plain restatement, on the smallest tables and on odd rows."""

import base64
import collections
import hashlib
import math
import random
import subprocess
import sys
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import exchange, knn, minhash, mixing, ngram, packing, quality, substring, token_counts, toxicity, warc
from tessera.llm.bpe import Transducer, prefix_scan, splitter, state_maps
from tessera.llm.common import each_slice, flat, new_path, span_hash, windows, words
from tessera.llm.eliasfano import EliasFano
from tessera.llm.queries import queries, tokenizer_path

from . import brute


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "two words"), (6, "A b C d e"), (7, "a B c D E"), (8, LONG), (9, LONG), (10, "x" * 5000),
    (11, PASSAGE + " tail one"), (12, "head two " + PASSAGE), (13, "head\ntwo b " + PASSAGE), (13, "head\ntwo b " + PASSAGE), (14, "naïve 日本語 \U0001f600 <|endoftext|> it's"),
    (None, PASSAGE), (None, None), (15, "# * $ % & | < >"), (16, "a a a a a a a a a a a a a\na a\na a\n"), (17, LONG[:9000] + " changed"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with further columns whose names clash with what the operators make or use."""
    df = spark.createDataFrame([(i, t, "s" if i and i % 3 else None, "en") for i, t in ODD], "doc_id long, text string, source string, lang string")
    for c in ("id", "t", "i", "n", "size", "flag", "score", "n_tokens", "rank", "node", "key", "copies", "target", "__b", "length"):
        df = df.withColumn(c, F.lit("clash"))
    return df.repartition(3)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def same(got, want):
    assert collections.Counter(got) == collections.Counter(want)


# ---------------------------------------------------------------- shared parts


def test_words_and_windows():
    texts = ["a b", "", "c\n d\te", "é f"]
    buf, offs = flat(pa.array(texts))
    s, e, d = words(buf, offs)
    assert [bytes(buf[a:b]) for a, b in zip(s, e)] == [w for t in texts for w in t.encode().split()]
    assert d.tolist() == [0, 0, 2, 2, 2, 3]
    h = span_hash(buf, s, e)
    assert len(set(h.tolist())) == len(h)
    x = np.arange(1, 40, dtype=np.uint64)
    for k in (1, 2, 3, 5, 8, 13, 32):
        y = np.concatenate([x[7:], x])
        assert windows(x, k)[7] == windows(y, k)[0] and len(windows(x, k)) == 40 - k
    long = [bytes(random.Random(i).randbytes(n)) for i, n in enumerate((0, 1, 7, 8, 9, 16, 17, 64, 1000))]
    at = np.cumsum([0, *map(len, long)])
    both = np.frombuffer(b"".join(long) * 2, np.uint8)
    assert (span_hash(both, at[:-1], at[1:]) == span_hash(both, at[:-1] + at[-1], at[1:] + at[-1])).all()


def test_lane_maps_compose():
    to, _ = splitter()
    maps, by_class, times = state_maps(to)
    r = np.random.default_rng(0)
    for _ in range(50):
        seq = r.integers(0, 12, 40)
        state, number = 5, 0
        for c in seq:
            state, number = to[state, c], by_class[number, c]
        assert maps[number, 5] == state
    own = r.integers(0, len(maps), 33).astype(np.int16)
    want, got = 0, prefix_scan(own, times)
    for k in range(33):
        assert got[k] == want
        want = times[want, own[k]]


@pytest.mark.parametrize("n,top", [(0, 1), (1, 0), (5, 3), (1000, 2000), (1000, 1 << 40), (300, 1 << 62)])
def test_elias_fano(n, top):
    v = np.sort(np.random.default_rng(n).integers(0, top + 1, n)).astype(np.uint64)
    e = EliasFano(v)
    assert (e.get(np.arange(n)) == v).all()
    q = np.concatenate([v, v + np.uint64(1), np.array([0, top, top + 7], np.uint64)])
    assert (e.successor(q) == np.searchsorted(v, q)).all()


# ---------------------------------------------------------------- 1 and 4


def test_transducer_equals_library(tok):
    r = random.Random(2)
    parts = [*" \n\t'stmdrvlel19.,é日!", "<|endoftext|>", "'ll", " the", "ing"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 50))) for _ in range(3000)] + [t for _, t in ODD]
    t = Transducer(tokenizer_path())
    buf, offs = flat(pa.array(texts, pa.string()))
    want = [e.ids for e in tok.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    assert t.count_texts(buf, offs).tolist() == [len(w) for w in want]
    ids, at = t.encode_texts(buf, offs)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want
    t.memo_most = 1  # starts anew again and again, with the same counts
    assert t.count_texts(buf[: offs[500]], offs[:501]).tolist() == [len(w) for w in want[:500]]


def test_token_counts(spark, docs, odd, tok):
    for df in (docs, odd, docs.limit(0)):
        got = token_counts.token_counts(df, "doc_id", "text", tokenizer_path()).collect()
        want = [(i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in pairs(df)]
        same(map(tuple, got), want)


def expected_pieces(rows, tok, cap=2048):
    out = []
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % cap + 1
        cuts = [0, *range(first, len(ids) + 1, cap)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out.append((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return out


def test_packing(spark, docs, odd, tok):
    for df in (docs, odd, docs.limit(0)):
        got = packing.pack_documents(df, "doc_id", "text", tokenizer_path()).collect()
        same([tuple(r)[:5] for r in got], expected_pieces(pairs(df), tok))
        by = collections.defaultdict(list)
        for r in got:
            by[r["sequence_id"]].append((r["offset"], r["length"]))
        for spans in by.values():
            spans.sort()
            assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(n for _, n in spans) <= 2048
        assert len(by) <= sum(n for n, _ in packing.best_fit(collections.Counter(r["length"] for r in got), 2048))


def test_bin_completion_is_optimal_on_small_cases():
    def least(sizes, cap):
        best = len(sizes)

        def go(k, rooms):
            nonlocal best
            if len(rooms) >= best:
                return
            if k == len(sizes):
                best = len(rooms)
                return
            for r in set(rooms):
                if r >= sizes[k]:
                    i = rooms.index(r)
                    go(k + 1, rooms[:i] + [r - sizes[k]] + rooms[i + 1 :])
            go(k + 1, [*rooms, cap - sizes[k]])

        go(0, [])
        return best

    r = random.Random(4)
    for _ in range(40):
        sizes = sorted((r.randint(10, 60) for _ in range(9)), reverse=True)
        plan = packing.bin_completion(dict(collections.Counter(sizes)), 100, width=64)
        assert sorted((s for n, f in plan for s in f * n), reverse=True) == sizes and all(sum(f) <= 100 for _, f in plan)
        assert sum(n for n, _ in plan) == least(sizes, 100)
    assert packing.bin_completion({}, 100) == []


# ---------------------------------------------------------------- 2


def archive(spark, df):
    out = new_path(spark, "warc")
    manifest = warc.write_archive(df, "page_id", "url", "html", out, shard_bytes=60_000, roll_bytes=8_000)
    return out, manifest


def expected_records(rows):
    first = {}
    for i, _, h in rows:
        h = (h or "").encode()
        if i is not None:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, _, h in rows:
        h = (h or "").encode()
        again = h in first and i != first[h]
        out.append((i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "revisit" if again else "response", first[h] if again else None))
    return out


def test_warc_round_trip(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    extra = spark.createDataFrame([(900, "http://a/\r\nX: y", ""), (901, None, None), (902, "u", "é"), (903, "u", "é"), (903, "u", "é"), (None, "u", "é"), (904, "v", "z" * 300_000)], "page_id long, url string, html string")
    df = pages.select("page_id", "url", "html").union(extra).withColumn("digest", F.lit("clash")).repartition(5)
    rows = [(r["page_id"], r["url"], r["html"]) for r in df.collect()]
    out, manifest = archive(spark, df)
    back = warc.read_archive(spark, out, with_payload=True).collect()
    same([tuple(r)[:5] for r in back], expected_records(rows))
    html = {i: (h or "").encode() for i, _, h in rows}
    assert all(bytes(r["payload"]) == html[r["page_id"]] for r in back if r["record_type"] == "response" and r["page_id"] is not None)
    files = manifest.orderBy("name").collect()
    assert len(files) > 3
    again = archive(spark, df.repartition(2))[1].orderBy("name").collect()
    assert [tuple(r) for r in files] == [tuple(r) for r in again]  # byte for byte
    _, none = archive(spark, df.limit(0))
    assert none.count() == 0


def test_warc_shards_are_bounded_whatever_the_ids(spark):
    """One far id, null ids, a repeated id: no shard holds more than its bytes and one key more."""
    rows = [(i if i % 3 else None, "u", f"{i} " + "y" * 3000) for i in range(300)] + [(7, "u", f"again {i} " + "z" * 3000) for i in range(200)] + [(10**15, "u", "far"), (-(10**15), "u", "low")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    out, manifest = archive(spark, df)
    held = collections.Counter()
    for r in manifest.collect():
        held[r["name"].split("-")[1]] += r["records"]
    assert sum(held.values()) == len(rows) and max(held.values()) <= 60_000 // 3400 + 2 and len(held) >= 25
    same([tuple(r)[:5] for r in warc.read_archive(spark, out).collect()], expected_records(rows))


# ---------------------------------------------------------------- 3


@pytest.mark.parametrize("orders", [1, 2, 3])
def test_ngram_scores(spark, docs, odd, orders):
    for df in (docs.limit(60), odd):
        learn = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
        got = ngram.score(df, "doc_id", "text", learn, orders=orders).collect()
        rows = [(i, brute.low(t) + [None], i is not None and not brute.held(i, 7, 2)) for i, t in pairs(df)]
        counts = [collections.Counter() for _ in range(orders)]
        context = [collections.Counter() for _ in range(orders)]
        for _, t, ok in rows:
            for k in range(orders if ok else 0):
                padded = ["<s>"] * k + t
                for j in range(len(t)):
                    counts[k][tuple(padded[j : j + k + 1])] += 1
                    context[k][tuple(padded[j : j + k])] += 1
        n, v, m = sum(counts[0].values()), len(counts[0]), 8.0
        want = []
        for i, t, _ in rows:
            base = sum(math.log10((counts[0][w,] + 1) / (n + v + 1)) for w in t)
            total = 0.0
            for j in range(len(t)):
                p = (counts[0][t[j],] + 1) / (n + v + 1)
                for k in range(1, orders):
                    g = tuple((["<s>"] * k + t)[j : j + k + 1])
                    p = (counts[k][g] + m * p) / (context[k][g[:-1]] + m)
                total += math.log10(p)
            want.append((i, len(t), sum(counts[0][w,] > 0 for w in t), n, base, total))
        order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[4]))
        for g, w in zip(order(map(tuple, got)), order(want), strict=True):
            assert g[:4] == w[:4] and g[4] == pytest.approx(w[4], rel=1e-9) and abs(g[5] - w[5]) <= 0.001 + 0.001 * w[1]  # the trie's probabilities are quantised
    assert ngram.score(docs.limit(0), "doc_id", "text", F.lit(True)).count() == 0


def test_ngram_beats_base_on_held_out_texts(spark, sf):
    rows = queries()["op3_ngram"](spark, sf).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


def test_ngram_query_counts_trigrams(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    learn = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    got = [tuple(r) for r in queries()["op3_ngram"](spark, sf).select("doc_id", F.round("score", 6)).collect()]
    score = lambda k: [tuple(r) for r in ngram.score(docs, "doc_id", "text", learn, orders=k).select("id", F.round("score", 6)).collect()]
    same(got, score(3))
    assert sorted(got) != sorted(score(2))


# ---------------------------------------------------------------- 5


def test_toxicity(spark, docs, odd):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries()["op5_toxicity"](spark, sf).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) and r["held_out"] == brute.held(r["doc_id"], 3, 1) for r in rows)
    lab = dict(labels.select("doc_id", "toxic").collect())
    got = [(r["score"], lab[r["doc_id"]]) for r in rows if r["held_out"] and lab.get(r["doc_id"]) is not None]
    above = [a > b for a, x in got if x for b, y in got if not y]
    assert sum(above) / len(above) > 0.9
    model = toxicity.fit(docs, labels, "doc_id", "text", "lang", "toxic", F.lit(True))
    out = toxicity.toxicity(odd, model, "doc_id", "text", "lang").collect()
    assert len(out) == len(ODD) and len({r["score"] for r in out if r["doc_id"] in (1, 2, 3)}) == 1
    swapped = toxicity.toxicity(docs.withColumn("lang", F.lit("zz")), model, "doc_id", "text", "lang").select("doc_id", "score")
    assert swapped.exceptAll(toxicity.toxicity(docs, model, "doc_id", "text", "lang").select("doc_id", "score")).count() == 0
    none = toxicity.fit(docs, labels.limit(0), "doc_id", "text", "lang", "toxic", F.lit(True))
    assert toxicity.toxicity(docs.limit(0), none, "doc_id", "text", None).count() == 0
    assert [r["score"] for r in toxicity.toxicity(docs.limit(5), none, "doc_id", "text", None).collect()] == [0.5] * 5
    alone = toxicity.fit(docs, labels.withColumn("toxic", F.lit(1)), "doc_id", "text", "lang", "toxic", F.lit(True))
    assert all(0.5 < r["score"] <= 1 for r in toxicity.toxicity(docs.limit(5), alone, "doc_id", "text", None).collect())


def test_toxicity_skips_texts_that_do_not_fit(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["good", "fine", "day"]) for _ in range(9)) + (" vile" if i % 3 == 0 else ""), "en", int(i % 3 == 0)) for i in range(300)]
    long = [(1000 + i, "day " * 40_000, "en", 0) for i in range(12)]
    df = spark.createDataFrame(rows + long, "doc_id long, text string, lang string, toxic int")
    model = toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic"), "doc_id", "text", "lang", "toxic", F.lit(True), most_bytes=100_000)
    got = toxicity.toxicity(df, model, "doc_id", "text", "lang").where("doc_id < 300").collect()
    assert all((x["predicted"] == 1) == (x["doc_id"] % 3 == 0) for x in got)
    with pytest.raises(ValueError, match="none of 12 labelled texts fits"):
        toxicity.fit(df.where("doc_id >= 1000"), df.select("doc_id", "toxic"), "doc_id", "text", "lang", "toxic", F.lit(True), most_bytes=100_000)


def test_toxicity_learns_from_every_labelled_row(spark):
    """Words of few documents among many more than a driver's sample would hold still count."""
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(["good", "fine", "day", "sun"]) for _ in range(6)) + (f" vile{i % 600:03d}x" if i % 3 == 0 else ""), "en", int(i % 3 == 0)) for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").repartition(4)
    model = toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic"), "doc_id", "text", "lang", "toxic", F.lit(True))
    buf, offs = toxicity.flat(pa.array([f"vile{i:03d}x" for i in range(0, 600, 3)]))
    parts, odds = toxicity.word_rows(buf, offs)[0], np.log((15 + 0.1) / (3000 + 0.2)) - np.log(0.1 / (6000 + 0.2))
    whole = model.embed[parts[parts[:, 0] > 0, 0], 0]
    assert len(whole) == 200 and abs(whole * 4 * 19 / 15 - odds).max() < 0.2
    got = toxicity.toxicity(df, model, "doc_id", "text", "lang").collect()
    assert all((x["predicted"] == 1) == (x["doc_id"] % 3 == 0) for x in got)


def test_toxicity_shuffles_little(spark):
    """Texts are not shuffled to their labels, and what tasks learnt travels packed."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    r = random.Random(4)
    rows = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(400)) + (" vile" if i % 3 == 0 else ""), "en", int(i % 3 == 0)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    df.write.parquet(at := new_path(spark, "texts"))
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: store.executorList(False).apply(0).totalShuffleWrite()
    df = spark.read.parquet(at)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = written(), spark.conf.get(key, None)
    model = toxicity.fit(df.drop("toxic"), df.where("doc_id < 300").select("doc_id", "toxic"), "doc_id", "text", "lang", "toxic", F.lit(True))
    assert model.thresholds and spark.conf.get(key, None) == was
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    time.sleep(1)
    assert written() - before < 100_000, written() - before


def test_toxicity_leaves_out_every_fold_at_any_size(monkeypatch):
    made, train = [], toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda *a: made.append(len(a[0])) or train(["a", "b"], [0, 1]))
    toxicity.calibrated([f"w{i}" for i in range(1600)], [i // 4 % 2 for i in range(1600)], ["en"] * 1600)
    assert made == [1600] + [1200] * 4


# ---------------------------------------------------------------- 6


def expected_top(rows, k=5, every=50):
    v = [(i, [math.floor(256 * float(x)) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for qi, qv in {(i, tuple(e)) for i, e in v if i % every == 0}:
        best = sorted((-sum(a * b for a, b in zip(qv, x)), i) for i, x in v if i != qi)[:k]
        out += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("block", [8192, 40])
def test_knn(spark, sf, monkeypatch, block):
    monkeypatch.setattr(knn, "BLOCK", block)
    monkeypatch.setattr(knn, "GROUP", 3 if block < 100 else 1024)
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").where("vec_id < 200")
    odd = spark.createDataFrame([(1000, None), (1001, [None, 1.0]), (1002, [float("nan")]), (1003, [float("inf")]), (1050, [1.0] * 64), (1004, [1.0] * 64), (1005, [1.0] * 64), (None, [1.0]), (1006, []), (1007, [3.0])], "vec_id long, embedding array<float>")
    both = rows.union(odd).withColumn("cell", F.lit("clash")).repartition(3)
    got = knn.top_k(both, "vec_id", "embedding", F.col("id") % 50 == 0, 5)
    same(map(tuple, got.collect()), expected_top([tuple(r)[:2] for r in both.collect()]))
    assert knn.top_k(both.limit(0), "vec_id", "embedding", F.col("id") % 50 == 0).count() == 0


def test_knn_of_large_components(spark):
    """Scores beyond 2^53 are exact; what a long cannot hold is an error."""
    rows = [(50, [1.3e6] * 64), (1, [1.3e6] * 64), (2, [1.3e6] * 63 + [1.2e6]), (3, [1.0] * 64)]
    kind = "vec_id long, embedding array<float>"
    df = spark.createDataFrame(rows, kind)
    same(map(tuple, knn.top_k(df, "vec_id", "embedding", F.col("id") % 50 == 0, 5).collect()), expected_top(df.collect()))
    for far in (3e7, 3e38):
        with pytest.raises(Exception, match="64 bits"):
            knn.top_k(spark.createDataFrame([*rows, (100, [far] * 64), (4, [far] * 64)], kind), "vec_id", "embedding", F.col("id") % 50 == 0, 5).collect()


def test_knn_with_a_query_id_that_repeats(spark, monkeypatch):
    """Rows with the query's id, all in a tight cell, do not bound its score."""
    monkeypatch.setattr(knn, "BLOCK", 2)
    rows = [(50, [10.0, 0.01 * j]) for j in range(30)] + [(102 + 7 * j, [1.0, 0.1 * j]) for j in range(12)] + [(401, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    same(map(tuple, knn.top_k(df, "vec_id", "embedding", F.col("id") % 50 == 0, 5).collect()), expected_top(df.collect()))


# ---------------------------------------------------------------- 7


def test_substring(spark, docs, odd):
    for df in (docs, odd, docs.limit(0)):
        got = substring.dedup(df, "doc_id", "text", 50).select("id", "n_words", "n_removed", "kept_sha256").collect()
        rows = [(10**12 if i is None else i, t) for i, t in pairs(df)]
        same([(10**12 if r[0] is None else r[0], *r[1:]) for r in map(tuple, got)], brute.dedup(rows))


def test_substring_of_short_windows_and_long_prefixes(spark):
    r = random.Random(9)
    rows = [(i, " ".join(r.choice("abc") for _ in range(r.randint(0, 40)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for size, group in ((9, 1 << 20), (12, 1)):
        got = substring.dedup(df, "doc_id", "text", size, group=group).select("id", "n_words", "n_removed", "kept_sha256").collect()
        same(map(tuple, got), brute.dedup(rows, size))


def test_substring_of_a_line_that_all_documents_hold(spark, monkeypatch):
    """Windows that share nothing but a very common line do not meet in one shard; those that are equal do."""
    r, line = random.Random(12), " ".join(f"line{i}" for i in range(20))
    some = lambda n: " ".join(str(r.randrange(10**9)) for _ in range(n))
    rows = [(i, f"{some(45)} {line} {some(45)}") for i in range(600)]
    rows += [(1000 + i, f"{some(9)} {t}") for i, t in rows[::20]]
    df, sent, solve = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), [], substring.solve
    monkeypatch.setattr(substring, "shard_count", lambda *_: 37)
    monkeypatch.setattr(substring, "solve", lambda rows, answer: sent.append(rows) or solve(rows, answer))
    got = substring.dedup(df, "doc_id", "text", 50, **({"busy": 300} if hasattr(substring, "BUSY") else {}))
    same(map(tuple, got.select("id", "n_words", "n_removed", "kept_sha256").collect()), brute.dedup(rows))
    for rows in sent:
        load = [x["n"] for x in rows.groupBy("shard").agg(F.sum(F.length("body")).alias("n")).collect()]
        assert len(load) > 30 and max(load) < 3 * sum(load) / len(load)


def test_more_shards_than_shuffle_partitions(spark, docs, monkeypatch):
    learn = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    cut = lambda: sorted(map(tuple, substring.dedup(docs, "doc_id", "text", 50).collect()))
    scored = lambda: {r["id"]: (*r[:5], round(r["score"], 6)) for r in ngram.score(docs, "doc_id", "text", learn).collect()}
    want = cut(), scored()
    for module in (substring, ngram):
        monkeypatch.setattr(module, "shard_count", lambda *_: 37)
    got = cut(), scored()
    assert got[0] == want[0]
    assert got[1].keys() == want[1].keys() and all(got[1][k] == pytest.approx(v) for k, v in want[1].items())


def test_shards_are_ranges_of_keys_and_grow_with_the_chunks(spark):
    keys = np.sort(np.random.default_rng(3).integers(0, 2**64, 5000, np.uint64, endpoint=False))
    for shards in (1, 4, 1000, 10**6):
        shard = exchange.shards_of(keys, shards)
        assert (np.diff(shard) >= 0).all() and 0 <= shard[0] and shard[-1] < shards
        got = exchange.runs(shard)
        assert sum(s.stop - s.start for s in got.values()) == len(keys) and all((shard[s] == k).all() for k, s in got.items())
    assert exchange.runs(np.zeros(0, np.int64)) == {}
    assert [exchange.shard_count(spark, n, 4) for n in (0, 16, 17, 4000)] == [4, 4, 5, 1000]


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_subtrees_lay_out_all_repeats(most):
    """Leaves in order of their words, shared prefixes, and nodes at full depth against a plain comparison."""
    r, size = random.Random(4), 11
    word = np.array([r.choice("aab") == "a" for _ in range(300)] + [r.randint(0, 3) for _ in range(100)] * 2, np.uint64)
    at, by = np.arange(len(word) - size + 1), substring.ranks(word, size)
    text = [tuple(word[i : i + size].tolist()) for i in at]
    groups, seen = substring.prefix_groups(at, by, most), {}
    assert sorted(np.concatenate(groups).tolist()) == at.tolist()
    for n, g in enumerate(groups):
        leaf, shared = substring.subtree(g, by, size)
        assert [text[i] for i in leaf] == sorted(text[i] for i in g)
        for x, y, k in zip(leaf, leaf[1:], shared[1:]):
            assert k == next((j for j in range(size) if text[x][j] != text[y][j]), size)
        assert len(g) <= most or len({t[:8] for t in (text[i] for i in g)}) == 1
        for i in g:
            assert seen.setdefault(text[i], n) == n  # equal windows meet in one group


# ---------------------------------------------------------------- 8


def test_near_duplicates(spark, docs, odd):
    for df in (docs, odd, docs.limit(0)):
        got = minhash.near_duplicates(df, "doc_id", "text", 85).collect()
        same(map(tuple, got), brute.near(pairs(df)))


def test_near_duplicates_of_rows_without_id(spark):
    x, y = (" ".join(f"{c}{i}" for i in range(20)) for c in "xy")
    rows = [(None, x), (None, x), (None, y), (4, y), (None, None), (None, y + " z")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    same(map(tuple, got), [(None, 16, None, True)] * 2 + [(None, 16, 4, False), (4, 16, 4, True), (None, 0, None, True), (None, 17, 4, False)])


@pytest.mark.parametrize("block", [1 << 20, 90])
def test_a_large_family_near_the_threshold(spark, monkeypatch, block):
    """Members are 0.65 to 0.95 alike: some linked directly, some by chains, some not at all; and few links leave a block."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    r, base = random.Random(8), [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(x if r.random() > r.choice([0.004, 0.02, 0.03]) else f"r{r.random()}" for x in base)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    made, spanning = [], minhash.spanning
    monkeypatch.setattr(minhash, "spanning", lambda *a: made.append(spanning(*a)) or made[-1])
    want = brute.near(rows)
    same(map(tuple, minhash.near_duplicates(df, "doc_id", "text", 85, hub_rounds=0 if block < 1000 else 2).collect()), want)
    assert 1 < len({w[2] for w in want}) < 250 and all(m.count() < 28 * 300 for m in made)


def test_chains_and_unlinked_buckets(spark):
    """Chains whose ends are not alike, and families that share bands without being linked."""
    r = random.Random(5)
    rows, n = [], 0
    for family in range(4):
        w = [f"f{family}w{i}" for i in range(200)]
        for step in range(25):
            if family < 2:
                w = w[:]
                w[step * 7 % 200] = f"new{family}_{step}"
                text = w
            else:
                text = [x if r.random() > 0.03 else f"r{r.random()}" for x in w]
            rows.append((n, " ".join(text)))
            n += 1
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hubs in (0, 1, 4):
        same(map(tuple, minhash.near_duplicates(df, "doc_id", "text", 85, hub_rounds=hubs).collect()), brute.near(rows))


def test_circulant_signatures_estimate_jaccard():
    a = [f"w{i}" for i in range(400)]
    b = a[:360] + [f"x{i}" for i in range(40)]
    key, at = minhash.shingles(*flat(pa.array([" ".join(a), " ".join(b)])))
    s = minhash.signatures(key, at, 512)
    x, y = brute.shingle_set(" ".join(a)), brute.shingle_set(" ".join(b))
    assert abs((s[:, 0] == s[:, 1]).mean() - len(x & y) / len(x | y)) < 0.08


# ---------------------------------------------------------------- 9


def expected_quality(i, text):
    w = [x.decode() for x in brute.words(text)]
    lines = [x for x in (text or "").split("\n") if brute.words(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    five = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    count = collections.Counter(five)
    hit = set()
    for k, g in enumerate(five):
        if count[g] > 1:
            hit.update(range(k, k + 5))
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return (i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit), failed)


def test_quality(spark, docs, odd):
    for df in (docs, odd, docs.limit(0)):
        got = quality.quality(df, "doc_id", "text").collect()
        same([tuple(r)[:7] for r in got], [expected_quality(i, t) for i, t in pairs(df)])
        assert not any(r["kept"] and r["base_failed"] for r in got)
        kept = collections.Counter(r["doc_id"] for r in got if r["kept"])
        assert collections.Counter(r["doc_id"] for r in quality.keep_good(df, "doc_id", "text").collect()) == kept


def test_cascade_order_changes_no_verdict():
    texts = [t for _, t in ODD] + ["# # # word " * 20, "plain words of a line\n" * 9]
    buf, offs = flat(pa.array(texts, pa.string()))
    rules = quality.further_rules()
    want = quality.verdicts(buf, offs, rules) >= 0
    for seed in range(5):
        mixed = random.Random(seed).sample(rules, len(rules))
        assert ((quality.verdicts(buf, offs, mixed) >= 0) == want).all()
    assert quality.cascade_order([("slow", 1.0, 0.5), ("fast", 0.1, 0.2), ("never", 0.1, 0.0)]) == ["fast", "slow", "never"]


# ---------------------------------------------------------------- 10


def expected_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    stopped, out = set(), {}
    while True:
        rest = share * sum(sizes.values()) - sum(most * sizes[s] for s in stopped)
        free = sum(w[s] for s in names if s not in stopped)
        out = {s: most * sizes[s] if s in stopped else rest * w[s] / free for s in names}
        over = {s for s in names if s not in stopped and out[s] > most * sizes[s]}
        if not over:
            return out
        stopped |= over


def test_mixing(spark, docs, odd):
    for df in (docs, odd, docs.where("doc_id % 3 = 0")):
        rows = [(r["doc_id"], r["source"], r["text"]) for r in df.collect()]
        sizes = collections.Counter()
        for _, s, t in rows:
            sizes[s] += len(brute.words(t))
        want = expected_targets(sizes)
        got = mixing.mix(df, "doc_id", "source", "text").collect()
        same([(r["doc_id"], r["source"], r["size"]) for r in got], [(i, s, len(brute.words(t))) for i, s, t in rows])
        taken, small = collections.Counter(), {}
        for r in got:
            assert r["target"] == pytest.approx(want[r["source"]], rel=1e-6) and r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 2 * r["size"]
            taken[r["source"]] += r["taken"]
        for s in sizes:
            small[s] = min((len(brute.words(t)) for _, x, t in rows if x == s and brute.words(t)), default=0)
        if df is docs:
            assert all(abs(taken[s] - want[s]) <= max(0.03 * want[s], small[s]) for s in sizes), [(s, taken[s], want[s], small[s]) for s in sizes]
    first = mixing.mix(docs, "doc_id", "source", "text").collect()
    same(map(tuple, first), map(tuple, mixing.mix(docs.repartition(5), "doc_id", "source", "text").collect()))
    assert mixing.mix(docs.limit(0), "doc_id", "source", "text").count() == 0


# ---------------------------------------------------------------- runs of documents


def test_slices_cover_all_rows():
    b = pa.record_batch({"t": pa.array(["a" * n for n in (5, 0, 300, 1, 1, 1)])})
    got = [part.num_rows for part, _, _ in each_slice(iter([b]), "t", 100)]
    assert sum(got) == 6


def test_a_task_starts_without_the_memory_that_the_one_before_it_freed():
    """Freed memory below what is still held stays with the allocator, up to hundreds of MB a worker, until it is told."""
    code = """
import numpy as np, pathlib, re
from tessera.llm.common import each_slice
own = lambda: int(re.search(r"Pss_Anon:\\s+(\\d+)", pathlib.Path("/proc/self/smaps_rollup").read_text())[1]) // 1024
held = [np.ones(100_000, np.uint8) for _ in range(3000)]
last, full = held[-1], own()
held.clear()
kept = own()
assert kept > full - 100, (full, kept)
list(each_slice(iter([]), "t"))
assert own() < full - 200, (full, kept, own())
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=60)
