"""Toxicity by a convolutional text classifier: hashed word embeddings, several filter widths, max pooling, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, each_slice, flat, span_hash, stored, words
from .exchange import freed

#: Embedding rows (row 0 pads), their length, filter widths, filters of each width.
ROWS, DIM, WIDTHS, FILTERS = 1 << 20, 8, (1, 2, 3), 8
PAD = max(WIDTHS) - 1
#: Beside the word, prefixes of these many bytes are hashed too; a word's embedding is the sum of its parts' rows.
PREFIXES = (5, 6, 7, 8)
PARTS = 1 + len(PREFIXES)
#: A part seen in fewer training documents stays neutral, so that no document is learnt by its rare words.
LEAST = 3
#: Labels that are broadcast at most (some 70 bytes each), so that no text is shuffled; beyond, both sides are, with the same result.
LABELS = 2_000_000


def word_rows(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of the parts of each word (words x PARTS), PAD rows of 0 after each document; and the starts.

    Words are lower-cased and stripped of what is no letter at their ends. A prefix as long as the word or longer is 0."""
    low = LOWER[buf]
    start, end, doc = words(low, offs)
    if len(start):
        at = np.flatnonzero((low >= 128) | ((low >= 97) & (low <= 122)))
        if len(at):
            first, last = at[np.minimum(np.searchsorted(at, start), len(at) - 1)], at[np.maximum(np.searchsorted(at, end) - 1, 0)] + 1
            core = (first >= start) & (first < end) & (last <= end) & (last > first)
            start, end = np.where(core, first, start), np.where(core, last, end)
    rows = np.zeros((len(start), PARTS), np.int32)
    for k, n in enumerate((0, *PREFIXES)):
        got = (span_hash(low, start, np.minimum(end, start + n) if n else end, k) % np.uint64(ROWS - 1)).astype(np.int64) + 1
        rows[:, k] = np.where(end - start > n, got, 0) if n else got
    n = np.bincount(doc, minlength=len(offs) - 1) if len(doc) else np.zeros(len(offs) - 1, np.int64)
    ends = np.cumsum(n)
    return np.insert(rows, np.repeat(ends, PAD), 0, axis=0), np.concatenate([[0], (ends + PAD * np.arange(1, len(n) + 1))[:-1]]).astype(np.int64)


@dataclass
class Model:
    """Weights; thresholds has the score from which a language's texts are flagged, "" for others."""

    embed: np.ndarray
    conv: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def pooled(self, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The highest value of each filter over each document. PAD rows keep windows within documents."""
        e = summed(self.embed, rows)
        got = []
        for w, c, b in zip(WIDTHS, self.conv, self.bias):
            n = len(rows) - w + 1
            y = e[:n] @ c[0]
            for j in range(1, w):
                y += e[j : n + j] @ c[j]
            got.append(np.maximum(np.maximum.reduceat(y, np.minimum(starts, n - 1)) + b, 0))
        return np.concatenate(got, 1)

    def score(self, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0)
        z = self.pooled(rows, starts).astype(np.float64) @ self.out + self.out_bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def summed(embed: np.ndarray, rows: np.ndarray) -> np.ndarray:
    e = embed[rows[:, 0]]
    for k in range(1, PARTS):
        e += embed[rows[:, k]]
    return e


def held(own: np.ndarray, doc: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each embedding row, how many documents hold it as this part, and how many toxic ones."""
    pair = np.unique(own.astype(np.int64) * (n + 1) + doc)
    row, of = pair // (n + 1), pair % (n + 1)
    row, of = row[row > 0], of[row > 0]
    return np.bincount(row, minlength=ROWS), np.bincount(row, y[of], ROWS)


def start(every: list[np.ndarray], toxic: list[np.ndarray], n: int, positive: float, rng) -> tuple[Model, np.ndarray]:
    """The network before its first step, from the counts of each part, and which rows may be trained."""
    embed = np.zeros((ROWS, DIM), np.float32)
    trained = np.zeros(ROWS, bool)
    for k in range(PARTS):
        odds = np.log((toxic[k] + 0.1) / (positive + 0.2)) - np.log((every[k] - toxic[k] + 0.1) / (n - positive + 0.2))
        known = np.flatnonzero(every[k] >= LEAST)
        embed[known, PARTS:] += rng.normal(0, 0.02, (len(known), DIM - PARTS)).astype(np.float32)
        embed[known, k] += (odds * every[k] / (every[k] + 4.0))[known] / 4
        trained[known] = True
    conv = [rng.normal(0, 0.05, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for c, w in zip(conv, WIDTHS):
        for k in range(PARTS):
            c[:, k, k] += 1.0 / w
    m = Model(embed, conv, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.05, FILTERS * len(WIDTHS)), 0.0)
    share = float(np.clip(positive / n, 1e-3, 1 - 1e-3)) if n else 0.5
    m.out[:PARTS] += 0.5
    m.out_bias = float(np.log(share / (1 - share)))
    if not n or not 0 < positive < n:
        m.out[:] = 0
    return m, trained


def train(texts: list[str | None], labels: list[int], rounds: int = 3, seed: int = 5) -> Model:
    """Fits the network on whole texts by Adagrad.

    Coordinate k of a row starts at the log odds of toxic against other documents that hold part k (the word, or one of
    its prefixes), shrunk for rare parts, and filters of width 1 start by reading one coordinate each. Only parts seen in
    LEAST training documents have rows other than 0. Weights of both labels are kept as in the sample."""
    rng = np.random.default_rng(seed)
    buf, offs = flat(pa.array(texts, pa.string()))
    rows, starts = word_rows(buf, offs)
    n, y = len(texts), np.asarray(labels, np.float64)
    starts = starts[:n]
    bounds = np.append(starts, len(rows))
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(bounds))
    counts = [held(rows[:, k] if len(rows) else np.zeros(0, np.int64), doc, y, n) for k in range(PARTS)]
    m, trained = start([c[0] for c in counts], [c[1] for c in counts], n, y.sum(), rng)
    if n and 0 < y.sum() < n:
        descend(m, trained, rows, bounds, y, rounds, rng, {})
    return m


def descend(m: Model, trained: np.ndarray, rows: np.ndarray, bounds: np.ndarray, y: np.ndarray, rounds: int, rng, state: dict) -> None:
    """Steps of Adagrad over the documents; state keeps the sums of squares from call to call."""
    n, grads = len(y), state.setdefault("grads", {})
    bias_sq, embed_sq = state.get("bias_sq", 1e-6), state.setdefault("embed_sq", np.full(ROWS, 1e-3, np.float32))

    def step(key, target: np.ndarray, g: np.ndarray, rate: float) -> None:
        h = grads.setdefault(key, np.full(target.shape, 1e-6))
        h += g * g
        target -= (rate * g / np.sqrt(h)).astype(target.dtype)

    for r in range(rounds):
        order = rng.permutation(n)
        for a in range(0, n, 64):
            pick = order[a : a + 64]
            size = (bounds[1:] - bounds[:-1])[pick]
            first = np.concatenate([[0], np.cumsum(size)])
            idx = rows[np.arange(first[-1]) + np.repeat(bounds[:-1][pick] - first[:-1], size)]
            first = first[:-1]
            e, pools, tops = summed(m.embed, idx), [], []
            for w, c, b in zip(WIDTHS, m.conv, m.bias):
                k = len(idx) - w + 1
                v = e[:k] @ c[0]
                for j in range(1, w):
                    v += e[j : k + j] @ c[j]
                best = np.maximum.reduceat(v, np.minimum(first, k - 1))
                group = np.repeat(np.arange(len(pick)), size)[:k]
                top = np.zeros((len(pick), FILTERS), np.int64)
                at, f = np.nonzero(v == best[group])
                top[group[at], f] = at
                pools.append(np.maximum(best + b, 0))
                tops.append(top)
            x = np.concatenate(pools, 1).astype(np.float64)
            p = 1 / (1 + np.exp(-np.clip(x @ m.out + m.out_bias, -40, 40)))
            d = (p - y[pick]) / len(pick)
            back = d[:, None] * m.out[None] * (x > 0)
            step("out", m.out, x.T @ d + 1e-4 * m.out, 0.05)
            bias_sq += float(d.sum()) ** 2
            m.out_bias -= 0.05 * float(d.sum()) / bias_sq**0.5
            for k, (w, top) in enumerate(zip(WIDTHS, tops)):
                g = back[:, k * FILTERS : (k + 1) * FILTERS]
                step(("bias", k), m.bias[k], g.sum(0), 0.02)
                gc = np.zeros(m.conv[k].shape)
                for j in range(w):
                    at = np.minimum(top + j, len(idx) - 1)  # documents x filters
                    gc[j] = np.einsum("dfe,df->ef", e[at], g)
                    ge = (g[:, :, None] * m.conv[k][j].T[None]).reshape(-1, DIM)
                    moving = np.abs(ge).sum(1) > 0
                    for part in range(PARTS):
                        row = idx[at.ravel(), part]
                        live = moving & trained[row]
                        if live.any():
                            np.add.at(embed_sq, row[live], (ge[live] ** 2).sum(1).astype(np.float32))
                            np.subtract.at(m.embed, row[live], (0.01 * ge[live] / np.sqrt(embed_sq[row[live]])[:, None]).astype(np.float32))
                step(("conv", k), m.conv[k], gc + 1e-4 * m.conv[k], 0.02)
    state["bias_sq"] = bias_sq


def best_cut(s: np.ndarray, y: np.ndarray) -> float | None:
    """The value between two scores at which F1 is best; None without both labels."""
    if not 0 < y.sum() < len(y):
        return None
    order = np.argsort(-s, kind="stable")
    hit = np.cumsum(y[order])
    f1 = np.where(np.append(np.diff(s[order]) != 0, True), 2 * hit / (np.arange(1, len(y) + 1) + y.sum()), 0)
    k = int(f1.argmax())
    return float((s[order][k] + s[order][min(k + 1, len(y) - 1)]) / 2)


def calibrated(texts: list[str | None], labels: list[int], langs: list[str | None], cut: float = 0.7) -> Model:
    """A model on all rows whose scores are set by rows that a model has not learnt from: the odds are shifted so that
    the best F1 lies at cut, then each language gets the threshold where its own F1 is best.

    All four folds are left out in turn."""
    n, y = len(texts), np.asarray(labels)
    model = train(texts, labels)
    fold = np.arange(n) % 4
    z, out = np.zeros(n), np.zeros(n, bool)
    for f in range(4):
        rest, mine = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        if not 0 < y[rest].sum() < len(rest) or not len(mine):
            continue
        part = train([texts[i] for i in rest], [labels[i] for i in rest])
        s = part.score(*word_rows(*flat(pa.array([texts[i] for i in mine], pa.string()))))
        z[mine], out[mine] = np.log(s / (1 - s)), True
    seen = np.flatnonzero(out)
    at = best_cut(z[seen], y[seen]) if len(seen) else None
    if at is None:
        return model
    shift = float(np.log(cut / (1 - cut)) - at)
    model.out_bias += shift
    s, lang = 1 / (1 + np.exp(-(z[seen] + shift))), np.array([langs[i] or "" for i in seen], object)
    for name in ["", *sorted(set(lang) - {""})]:
        mine = np.ones(len(seen), bool) if name == "" else lang == name
        got = best_cut(s[mine], y[seen][mine])
        if got is not None:
            model.thresholds[name] = got
    return model


def fitting(rows: list[tuple], most: int, most_bytes: int) -> list[tuple]:
    """Of rows (id, bytes of a text, its hash, how often it occurs), those that fit and how often: first texts of at most a
    64th of the bytes, then longer ones, each in order; copies of a text come after every other text."""
    out, left = [0] * len(rows), most_bytes
    for copies in (False, True):
        for long in (False, True):
            for k, (_, size, _, n) in enumerate(rows):
                if (64 * size > most_bytes) == long:
                    n = min(n - out[k] if copies else 1, most, left // size if size else n)
                    out[k], left, most = out[k] + n, left - n * size, most - n
    return [(*r[:3], n) for r, n in zip(rows, out) if n]


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str | None, label_col: str, train_on, most: int | None = None, most_bytes: int | None = None) -> Model:
    """Trains on all labelled rows (fit_all). Only if most or most_bytes is given, on a bounded sample: at most `most` documents
    (6000) and most_bytes (12 MB) of text, by hash of the id, in the driver.

    train_on is a Column over id_col that says which rows may be learnt from. Rows without label or text are left out. In a sample, a text
    that no longer fits is skipped and later ones go on; texts above a 64th of most_bytes take what the others leave. Labelled
    texts of which none fits are an error. Without usable labels every text scores 0.5; with labels of one kind, about their share."""
    lab = labels.select(F.col(id_col).alias("__i"), F.col(label_col).cast("int").alias("__y")).where("__y is not null and __i is not null").groupBy("__i").agg(F.max("__y").alias("__y"))
    lab = lab.withColumnRenamed("__i", id_col).where(train_on).withColumnRenamed(id_col, "__i")
    rows = docs.select(F.col(id_col).alias("__d"), F.col(text_col).alias("t"), (F.col(lang_col) if lang_col else F.lit(None).cast("string")).alias("l"))
    if most is None and most_bytes is None:
        lab = stored(lab, "labels")
        data = rows.where("t is not null").join(F.broadcast(lab) if lab.count() <= LABELS else lab, F.col("__d") == F.col("__i"))
        with cleaned(docs.sparkSession):
            return fit_all(stored(data.select("__y", F.col("l").cast("string").alias("l"), F.pmod(F.xxhash64("__d"), F.lit(FOLDS)).cast("int").alias("f"), F.col("t").cast("string").alias("t")).withColumnRenamed("__y", "y"), "labelled"))
    most, most_bytes = most or 6000, most_bytes or 12 << 20
    chosen = lab.orderBy(F.xxhash64("__i"), "__i").limit(most)
    got = rows.join(F.broadcast(chosen), F.col("__d") == F.col("__i")).where("t is not null")  # at most `most` pairs of numbers
    got = got.withColumn("size", F.octet_length("t"))
    keys = ["__d", "size", F.xxhash64("t").alias("x")]
    rows = [tuple(r) for r in got.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(F.xxhash64("__d"), "__d", "size", "x").toLocalIterator()]
    taken = fitting(rows, most, most_bytes)
    if not taken:
        if rows:
            raise ValueError(f"none of {len(rows)} labelled texts fits into {most_bytes} bytes: nothing to train on")
        return train([], [])
    kind = got.select("__d", "size", F.xxhash64("t").alias("x"), F.lit(0).cast("long").alias("n")).schema
    chosen = got.sparkSession.createDataFrame(taken, kind).withColumnsRenamed({"__d": "d", "size": "s"})
    on = (F.col("__d") == F.col("d")) & (F.col("size") == F.col("s")) & (F.xxhash64("t") == F.col("x"))
    # Equal rows travel once and are repeated here.
    data = got.join(F.broadcast(chosen), on).groupBy("__d", "x", "t").agg(F.first("__y").alias("__y"), F.min("l").alias("l"), F.first("n").alias("n")).withColumn("h", F.xxhash64("__d")).collect()
    data = [r for r in data for _ in range(r["n"])]
    data.sort(key=lambda r: (r["h"], r["__d"], r["t"]))
    texts, ys, langs = [r["t"] for r in data], [r["__y"] for r in data], [r["l"] for r in data]
    return calibrated(texts, ys, langs)


FOLDS = 4


def small(m: Model) -> np.ndarray:
    """All weights but the embedding, in rows as long as its."""
    flat_ = np.concatenate([*[c.ravel() for c in m.conv], *m.bias, m.out, [m.out_bias]]).astype(np.float64)
    return np.append(flat_, np.zeros(-len(flat_) % DIM)).reshape(-1, DIM)


def put(m: Model, v: np.ndarray) -> None:
    """The inverse of small."""
    v, at = v.ravel(), 0
    for a in (*m.conv, *m.bias, m.out):
        a[...] = v[at : at + a.size].reshape(a.shape)
        at += a.size
    m.out_bias = float(v[at])


def sparse(m: Model, trained: np.ndarray) -> tuple:
    at = np.flatnonzero(trained).astype(np.int32)
    return at, m.embed[at], small(m)


def dense(packed: tuple) -> tuple[Model, np.ndarray]:
    at, e, v = packed
    m = Model(np.zeros((ROWS, DIM), np.float32), [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.zeros(FILTERS * len(WIDTHS)), 0.0)
    trained = np.zeros(ROWS, bool)
    m.embed[at], trained[at] = e, True
    put(m, v)
    return m, trained


MOVES = pa.schema([("f", pa.int32()), ("block", pa.int32()), ("task", pa.int32()), ("n", pa.float64()), ("body", pa.binary())])


def packed_moves(row: np.ndarray, v: np.ndarray, bits: int) -> Iterator[tuple[int, bytes]]:
    """Moves v of rows in ascending order, by block of 2^bits rows; 34 bytes a row."""
    block = row >> bits
    first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(row)]):
        yield int(block[a]), move_bytes(row[a:b] & ((1 << bits) - 1), v[a:b])


def move_bytes(low: np.ndarray, v: np.ndarray) -> bytes:
    return v.astype("<f4").tobytes() + low.astype("<u2").tobytes()


def unpacked_moves(body) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of move_bytes."""
    n = len(body) // (4 * DIM + 2)
    return np.frombuffer(body, "<u2", n, 4 * DIM * n), np.frombuffer(body, "<f4", DIM * n).reshape(n, DIM)


@contextmanager
def cleaned(spark) -> Iterator[None]:
    """Shuffle files of queries made inside go when each query ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def _slices(batches: Iterator[pa.RecordBatch]):
    """Embedding rows, bounds of documents, labels, folds and languages of about a megabyte of documents (y, l, f, t)."""
    for part, buf, offs in each_slice(batches, "t", 1 << 20):
        rows, starts = word_rows(buf, offs)
        yield rows, np.append(starts[: part.num_rows], len(rows)), part.column(0).to_numpy().astype(np.float64), part.column(2).to_numpy(), part.column(1)


def fit_all(data: DataFrame, rounds: int = 2, cut: float = 0.7) -> Model:
    """The network from all rows of data (y, l, f: a fold, t), which is read where it lies.

    Document counts of parts are exact sums over all rows. In each round every task takes Adagrad steps over all its rows
    from the same weights, and weights are averaged by rows (those of an embedding row over tasks that moved it). Models
    that leave out one fold each go the same way at once; the scores they give to rows that they left out, as counts in
    steps of 1/1024 of the log odds, set the cut and the thresholds of languages."""
    spark = data.sparkSession
    freed(spark)
    size = {r["f"]: (r["n"], r["p"]) for r in data.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).collect()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds, y, fold, _ in _slices(batches):
            doc = np.repeat(np.arange(len(y)), np.diff(bounds))
            for k in range(PARTS):
                pair = np.unique(rows[:, k].astype(np.int64) * len(y) + doc)
                row, of = pair // len(y), pair % len(y)
                key, at = np.unique((row * FOLDS + fold[of])[row > 0], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(k * ROWS + key // FOLDS), pa.array((key % FOLDS).astype(np.int32)), pa.array(np.bincount(at, minlength=len(key)).astype(np.int64)), pa.array(np.bincount(at, y[of][row > 0], len(key)).astype(np.int64))], names=["key", "f", "n", "p"])

    sums = [F.sum(F.when(F.col("f") == f, F.col(c))).alias(f"{c}{f}") for c in "np" for f in range(FOLDS)]
    known = data.mapInArrow(count, "key long, f int, n long, p long").groupBy("key").agg(F.sum("n").alias("n"), *sums).where(F.col("n") >= LEAST).toArrow()
    key = known["key"].to_numpy()
    table = {c: known[c].to_numpy().astype(np.float64) if not known[c].null_count else known[c].fill_null(0).to_numpy().astype(np.float64) for c in known.column_names if c != "n"}
    models = {}
    for left in [*range(FOLDS), FOLDS]:
        rest = [f for f in range(FOLDS) if f != left]
        n, p = (sum(size.get(f, (0, 0))[i] for f in rest) for i in (0, 1))
        if left < FOLDS and not (0 < p < n and left in size):
            continue
        every, toxic = (np.bincount(key, sum(table[f"{c}{f}"] for f in rest), PARTS * ROWS).reshape(PARTS, ROWS) for c in "np")
        m, trained = start(list(every), list(toxic), n, p, np.random.default_rng(5))
        models[left] = sparse(m, trained)
        if left == FOLDS and not 0 < p < n:
            return m
        del m, trained, every, toxic
    del known, table
    freed(spark)
    # Blocks of rows, so small that one block's moves by all tasks are some megabytes.
    bits = max(6, 16 - max(0, (data.rdd.getNumPartitions() - 1).bit_length() - 4))
    for r in range(rounds):
        sent = spark.sparkContext.broadcast(models)

        def learn(batches: Iterator[pa.RecordBatch], r=r, sent=sent) -> Iterator[pa.RecordBatch]:
            own = {f: (*dense(x), {}) for f, x in sent.value.items()}
            rng, seen = np.random.default_rng(5 + r), dict.fromkeys(own, 0)
            for rows, bounds, y, fold, _ in _slices(batches):
                for f, (m, trained, state) in own.items():
                    mine = np.flatnonzero(fold != f)
                    if len(mine):
                        wide = np.diff(bounds)[mine]
                        ends = np.cumsum(wide)
                        at = np.arange(ends[-1]) + np.repeat(bounds[:-1][mine] - (ends - wide), wide)
                        descend(m, trained, rows[at], np.append(0, ends), y[mine], 1, rng, state)
                        seen[f] += len(mine)
            for f, (m, _, _) in own.items():
                if seen[f]:
                    at, e, v = sent.value[f]
                    delta = m.embed[at] - e
                    moved = np.flatnonzero(np.abs(delta).sum(1) > 0)
                    row = np.concatenate([at[moved], ROWS + np.arange(len(v))])
                    parts = packed_moves(row, np.concatenate([delta[moved], (small(m) - v).astype(np.float32)]), bits)
                    names = ["f", "block", "task", "n", "body"]
                    task = TaskContext.get().partitionId()
                    yield from (pa.RecordBatch.from_pylist([dict(zip(names, (f, b, task, float(seen[f]), body)))], schema=MOVES) for b, body in parts)

        def mean(t: pa.Table) -> pa.Table:
            order = np.argsort(t["task"].to_numpy())
            total, weight = np.zeros((1 << bits, DIM)), np.zeros(1 << bits)
            for i in order.tolist():
                (low, v), n = unpacked_moves(t["body"][i].as_buffer()), t["n"][i].as_py()
                total[low] += n * v
                weight[low] += n
            low = np.flatnonzero(weight)
            return t.slice(0, 1).select(["f", "block"]).append_column("body", pa.array([move_bytes(low, total[low] / weight[low, None])], pa.binary()))

        got = data.mapInArrow(learn, "f int, block int, task int, n double, body binary").groupBy("f", "block").applyInArrow(mean, "f int, block int, body binary").toArrow()
        for f, block, body in zip(got["f"].to_pylist(), got["block"].to_pylist(), got["body"]):
            (at, e, w), (low, v) = models[f], unpacked_moves(body.as_buffer())
            row = (block << bits) + low.astype(np.int64)
            if row[0] < ROWS:
                e[np.searchsorted(at, row)] += v
            else:
                w[row - ROWS] += v
        del got
        sent.destroy()  # with the file that the driver keeps of it
        freed(spark)
    model = dense(models.pop(FOLDS))[0]
    sent = spark.sparkContext.broadcast(models)

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {f: dense(x)[0] for f, x in sent.value.items()}
        for rows, bounds, y, fold, lang in _slices(batches):
            s = np.stack([own[f].score(rows, bounds[:-1]) if f in own else np.full(len(y), np.nan) for f in range(FOLDS)])[fold, np.arange(len(y))]
            ok = np.flatnonzero(~np.isnan(s))
            z = np.round(1024 * np.log(s[ok] / (1 - s[ok]))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([lang.take(pa.array(ok)), pa.array(z), pa.array(y[ok].astype(np.int64))], names=["l", "z", "y"])

    scored = data.mapInArrow(left_out, "l string, z long, y long").groupBy(F.coalesce("l", F.lit("")).alias("l"), "z").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).toArrow()
    sent.destroy()
    lang, z, n, p = np.array(scored["l"].to_pylist(), object), *(scored[c].to_numpy() for c in "znp")
    at = counted_cut(z / 1024, p, n)
    if at is None:
        return model
    shift = float(np.log(cut / (1 - cut)) - at)
    model.out_bias += shift
    for name in ["", *sorted(set(lang) - {""})]:
        mine = np.ones(len(z), bool) if name == "" else lang == name
        got = counted_cut(z[mine] / 1024, p[mine], n[mine])
        if got is not None:
            model.thresholds[name] = float(1 / (1 + np.exp(-(got + shift))))
    return model


def counted_cut(z: np.ndarray, p: np.ndarray, n: np.ndarray) -> float | None:
    """best_cut of values that occur n times, p times with label 1."""
    if not 0 < p.sum() < n.sum():
        return None
    value, at = np.unique(-z, return_inverse=True)
    hit, every = np.cumsum(np.bincount(at, p)), np.cumsum(np.bincount(at, n))
    k = int((2 * hit / (every + p.sum())).argmax())
    return -float((value[k] + value[min(k + 1, len(value) - 1)]) / 2)


def toxicity(docs: DataFrame, model: Model, id_col: str, text_col: str, lang_col: str | None, cut: float = 0.7) -> DataFrame:
    """Scores every whole text: id_col, score (0 to 1), predicted (score >= cut), flagged (score reaches the threshold of
    the row's language, or that for all languages).

    The score depends on the text alone. Null and empty texts score like a text without words. Repeated rows each get a
    row, null ids stay; an empty table gives none. One narrow pass; the model is broadcast and of fixed size."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for part, buf, offs in each_slice(batches, "t", 1 << 20):
            s = m.score(*word_rows(buf, offs))
            other = m.thresholds.get("", cut)
            limit = np.array([m.thresholds.get(x or "", other) for x in part.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= cut).astype(np.int32)), pa.array(s >= limit)], names=[id_col, "score", "predicted", "flagged"])

    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), (F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")).alias("l"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int, flagged boolean")
