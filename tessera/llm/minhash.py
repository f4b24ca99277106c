"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations give all signature coordinates: one scatters the shingles over a universe of D places, the other ranks
places, and is shifted circularly by k for coordinate k: h_k = min over shingles of rank[(place - k) mod D].
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, each_slice, flat, give_back, mix, span_hash, stored, windows, words

#: Size of the universe (a power of two), bands and rows a band. At a similarity of 0.8 a pair shares no band with
#: probability (1 - 0.8^5)^28 = 1.5e-5, at 0.85 with 7e-8.
PLACES, BANDS, ROWS = 1 << 18, 28, 5
#: Rows of a bucket, and bytes of their sets, that are compared with each other in one task.
BLOCK, BLOCK_BYTES = 1024, 16 << 20
#: Node ids that are broadcast at most (24 bytes each); beyond that both sides are shuffled, with the same result.
BROADCAST = 2_000_000
_rank: dict[int, np.ndarray] = {}


def rank_table(seed: int = 11) -> np.ndarray:
    """The second permutation, doubled so that a circular shift is a view of it."""
    if seed not in _rank:
        p = np.random.default_rng(seed).permutation(PLACES).astype(np.int32)
        _rank[seed] = np.concatenate([p, p])
    return _rank[seed]


def shingles(buf: np.ndarray, offs: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle fingerprints of each document, in order within the document, and the n + 1 offsets into them.

    A document of fewer than k words has its whole sequence as one shingle; one without words has none."""
    low = LOWER[buf]
    start, end, doc = words(low, offs)
    n = len(offs) - 1
    h = span_hash(low, start, end)
    w = windows(h, k)
    inside = doc[: len(w)] == doc[k - 1 : k - 1 + len(w)]
    key, of = w[inside], doc[: len(w)][inside]
    count = np.bincount(doc, minlength=n) if len(doc) else np.zeros(n, np.int64)
    for size in range(1, k):
        short = np.flatnonzero(count == size)
        if len(short):
            at = np.searchsorted(doc, short)
            got = mix(windows(h, size)[at] + U64(size)) if size > 1 else mix(h[at] + U64(1))
            key, of = np.concatenate([key, got]), np.concatenate([of, short])
    order = np.lexsort((key, of))
    key, of = key[order], of[order]
    if len(key):
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])])
        key, of = key[fresh], of[fresh]
    return key, np.searchsorted(of, np.arange(n + 1))


def signatures(key: np.ndarray, at: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """coordinates x documents; documents without shingles get the rank of what follows and must be left out."""
    n = len(at) - 1
    if not len(key):
        return np.zeros((coordinates, n), np.int32)
    place = (mix(key ^ U64(0xC2B2AE3D27D4EB4F)) >> U64(64 - 18)).astype(np.int64)  # the first permutation
    rank, first = rank_table(), np.minimum(at[:-1], len(key) - 1)
    out = np.empty((coordinates, n), np.int32)
    for k in range(coordinates):
        out[k] = np.minimum.reduceat(rank[PLACES - k : 2 * PLACES - k].take(place), first)
    return out


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band and document; equal keys mean the same band and, but for chance, the same rows."""
    out = np.empty((bands, sig.shape[1]), np.int64)
    for b in range(bands):
        h = np.full(sig.shape[1], b + 1, U64)
        for r in range(rows):
            h = mix(h * U64(0x9E3779B97F4A7C15) ^ sig[b * rows + r].astype(U64))
        out[b] = h.view(np.int64)
    return out


def described(df: DataFrame, id_col: str, text_col: str, k: int = 5) -> DataFrame:
    """id, h (a hash of the text where the id is null, else null), n (set size), f1 and f2 (fingerprint of the set), bands (the
    keys as bytes) and sig (a byte of each coordinate)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in each_slice(batches, "t", 2 << 20):
            key, at = shingles(buf, offs, k)
            n = np.diff(at)
            sums = [np.concatenate([np.zeros(1, U64), np.cumsum(mix(key + U64(s)))]) for s in (3, 5)]
            f1, f2 = ((s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums)
            sig = signatures(key, at)
            packed = [np.ascontiguousarray(x.T) for x in (band_keys(sig), (sig & 255).astype(np.uint8))]
            packed = [pa.array([r.tobytes() if m else None for r, m in zip(x, n)], pa.binary()) for x in packed]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(f1), pa.array(f2), *packed], names=["id", "h", "n", "f1", "f2", "bands", "sig"])

    return named(df, id_col, text_col).mapInArrow(run, "id long, h long, n long, f1 long, f2 long, bands binary, sig binary")


def named(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, h and t: rows without an id are told apart by the hash of their text."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.select("id", F.when(F.col("id").isNull(), F.xxhash64("t")).alias("h"), "t")


def least_agreement(percent: int) -> int:
    """Coordinates in which a pair at the threshold agrees at least, but for six standard deviations."""
    k, p = BANDS * ROWS, percent / 100
    return max(0, math.floor(k * p - 6 * math.sqrt(k * p * (1 - p))))


def alike(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree enough to be worth their full sets."""
    s = nodes.select("node", "sig")
    both = pairs.join(s.withColumnsRenamed({"node": "na", "sig": "sa"}), F.col("a") == F.col("na")).select("a", "b", "sa")
    both = both.join(s.withColumnsRenamed({"node": "nb", "sig": "sb"}), F.col("b") == F.col("nb")).select("a", "b", "sa", "sb")
    least = least_agreement(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("sa", "sb"))
            yield b.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= least)) if b.num_rows else b.select(["a", "b"])

    return both.mapInArrow(run, "a long, b long")


class Rows:
    """Rows of one pair (i, j) of a bucket's blocks; a row is compared with later ones, of the other block where i < j."""

    def __init__(self, key: tuple[pa.Scalar, ...], t: pa.Table, percent: int):
        band, i, j = (k.as_py() for k in key)
        t = t.take(pa.array(np.lexsort((t["node"].to_numpy(), t["block"].to_numpy()))))
        self.t, self.percent, self.least = t, percent, least_agreement(percent)
        self.node, self.n, block = (t[c].to_numpy() for c in ("node", "n", "block"))
        self.comp = np.unique(t["root"].to_numpy(), return_inverse=True)[1]
        self.sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(len(t), -1)
        self.bands = np.frombuffer(b"".join(t["bands"].to_pylist()), np.int64).reshape(len(t), -1)
        self.here = int((self.bands[0] == band).argmax())
        self.half = int(np.searchsorted(block, j)) if i < j else 0
        self.cross = i < j

    def candidates(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each row and the later ones to compare it with: of another component by now, near enough in size and
        signature, and without a common band before this bucket's, whose bucket sees the pair too."""
        for x in range(self.half if self.cross else len(self.node)):
            lo = self.half if self.cross else x + 1
            small, large = np.minimum(self.n[lo:], self.n[x]), np.maximum(self.n[lo:], self.n[x])
            at = np.flatnonzero((self.comp[lo:] != self.comp[x]) & (100 * small >= self.percent * large)) + lo
            at = at[(self.sig[at] == self.sig[x]).sum(1) >= self.least]
            at = at[~(self.bands[at, : self.here] == self.bands[x, : self.here]).any(1)]
            if len(at):
                yield x, at


def spanning(rows: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the components of rows (key, node, n, root, m, size) as all links within the keys' buckets do.

    m is a bucket's number of rows and size their shingles: a large bucket is cut into blocks of bounded rows and bytes, and
    each pair of blocks is one group. A first pass keeps the rows that have a candidate in their group; only for these do
    full sets travel. The second verifies pairs on full sets, skips pairs that are joined by then, and emits a link only
    where it joins two components: fewer links than a group has rows, however many pairs it holds."""
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("size") * 8 / BLOCK_BYTES)).cast("int")
    cut = rows.withColumn("block", F.pmod(F.xxhash64("node"), blocks.cast("long")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cut = cut.select("key", "node", "n", "root", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    described = nodes.select(F.col("node").alias("sn"), "sig", "bands")
    kind = "key long, node long, n long, root long, block int, i int, j int"

    def worth(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        r = Rows(key, t, percent)
        keep = np.zeros(len(t), bool)
        for x, at in r.candidates():
            keep[x] = keep[at] = True
        return r.t.select(["key", "node", "n", "root", "block", "i", "j"]).filter(pa.array(keep))

    def joined(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        if t.nbytes > 1 << 20:
            give_back()
        r = Rows(key, t, percent)
        del t
        count = r.n
        starts = np.concatenate([[0], np.cumsum(count)])
        shingle = np.unique(flat(r.t["set"])[0].view(U64), return_inverse=True)[1].astype(np.int32)
        r.t = None
        mine = np.zeros(int(shingle.max()) + 1 if len(shingle) else 0, np.int64)
        a, b = [], []
        for x, at in r.candidates():
            mine[shingle[starts[x] : starts[x + 1]]] = 1
            first = np.cumsum(count[at]) - count[at]
            of = np.arange(int(count[at].sum())) + np.repeat(starts[at] - first, count[at])
            common = np.add.reduceat(mine[shingle[of]], first)
            mine[shingle[starts[x] : starts[x + 1]]] = 0
            for y in at[100 * common >= percent * (count[x] + count[at] - common)]:
                if r.comp[y] != r.comp[x]:
                    a.append(r.node[x])
                    b.append(r.node[y])
                    r.comp[r.comp == r.comp[y]] = r.comp[x]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    near = cut.join(described, F.col("node") == F.col("sn")).drop("sn").groupBy("key", "i", "j").applyInArrow(worth, kind)
    near = stored(near, "near")
    if near.isEmpty():
        return near.select(F.col("node").alias("a"), F.col("node").alias("b"))
    near = near.join(described, F.col("node") == F.col("sn")).drop("sn").join(sets.withColumnRenamed("node", "sn"), F.col("node") == F.col("sn")).drop("sn")
    return near.groupBy("key", "i", "j").applyInArrow(joined, "a long, b long")


def unpacked_bands(sets: DataFrame) -> DataFrame:
    """One row (key, node, n) for each band of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                s = b.slice(i, 2000)
                keys = np.frombuffer(b"".join(s.column("bands").to_pylist()), np.int64)
                idx = pa.array(np.repeat(np.arange(s.num_rows), BANDS))
                yield pa.RecordBatch.from_arrays([pa.array(keys), s.column("node").take(idx), s.column("n").take(idx)], names=["key", "node", "n"])

    return sets.select("node", "n", "bands").mapInArrow(run, "key long, node long, n long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes with 100 * intersection >= percent * union on their full sets. Both sides of each join are
    stored, so a node that is in very many pairs is split among tasks."""
    s = sets.select("node", "set")
    left = pairs.join(s.withColumnsRenamed({"node": "na", "set": "sa"}), F.col("a") == F.col("na")).select("a", "b", "sa")
    both = left.join(s.withColumnsRenamed({"node": "nb", "set": "sb"}), F.col("b") == F.col("nb")).select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            sa, sb = batch.column("sa"), batch.column("sb")
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), U64) for c in (sa, sb))
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                z = np.concatenate([x, y])
                z.sort()
                common = int((z[1:] == z[:-1]).sum())
                keep[i] = 100 * common >= percent * (len(z) - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, "a long, b long")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of links (a, b): alternating large-star and small-star steps until nothing moves.

    Each step is a group minimum and a join over stored edges; a node with very many links is combined before the shuffle."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    print_of = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    last = print_of(edges)
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "star")
        big = both.where("v > u").join(low.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        big = stored(big.where("u > v"), "edges")
        low = stored(big.groupBy("u").agg(F.min("v").alias("m")), "star")
        small = big.join(low.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").union(low.select("u", F.col("m").alias("v"))).distinct()
        edges = stored(small, "edges")
        now = print_of(edges)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components still move after {rounds} rounds")
    return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")


def near_duplicates(df: DataFrame, id_col: str, text_col: str, percent: int = 80, k: int = 5, hub_rounds: int = 2) -> DataFrame:
    """Components of documents whose k-word shingle sets have 100 * intersection >= percent * union.

    Returns id (long), n_shingles, component_id (the smallest id reachable) and kept (id = component_id). A document
    without words, or with a null text, links with nothing. A row with a null id is a document like others whose id comes after
    all others: a component of such rows alone has a null component_id, and all of them are kept (null-safe equality). Rows
    that repeat an id are documents of their own that share it. An empty table gives no rows.

    Documents with equal sets are one node. Nodes that share a band are candidates. A bucket does not emit all its pairs:
    each round verifies each node against one hub of its buckets on full sets, links are joined into components, and only
    buckets that still span components go on with another hub. What is then left of pairs between components within a
    bucket is compared in blocks, so no candidate link is lost, and only links that join components leave a block. Before
    full sets move, a pair must agree in as many coordinates as one at the threshold does, less six standard deviations:
    a link is lost there with a probability of about 1e-9, far below that of sharing no band."""
    out = linked(df, id_col, text_col, percent, k, hub_rounds)
    return out.select("id", F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def linked(df: DataFrame, id_col: str, text_col: str, percent: int, k: int, hub_rounds: int = 2) -> DataFrame:
    """id, n, f1, f2, component_id and root (a component's own number, null without words) of each row of near_duplicates."""
    docs = stored(described(df, id_col, text_col, k), "minhash")
    full = docs.where("n > 0")
    nodes = stored(full.groupBy("f1", "f2", "n").agg(F.min("id").alias("low"), F.min("h").alias("lh"), F.first("bands").alias("bands"), F.first("sig").alias("sig")).withColumn("node", F.xxhash64("f1", "f2", "n")), "nodes")
    bands = stored(unpacked_bands(nodes), "bands")
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(F.col("key").alias("k2"))
    bands = stored(bands.join(shared, F.col("key") == F.col("k2"), "left_semi"), "bands")
    wanted = bands.select("node").distinct().join(nodes.select(F.col("node").alias("w"), "low", "lh"), F.col("node") == F.col("w"))
    wanted = stored(wanted.select("node", "low", F.when(F.col("low").isNull(), F.col("lh")).alias("lh")), "wanted")
    sets = set_rows(df, id_col, text_col, wanted, k)

    state, links = None, None
    for r in range(hub_rounds + 1):
        if state is None:
            rows = bands.withColumn("root", F.col("node"))
        else:
            rows = bands.join(state.withColumnRenamed("node", "sn"), F.col("node") == F.col("sn"), "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
        hub = F.min_by(F.struct("node", "n", "root"), F.xxhash64("root", F.lit(r), "node") if r else F.col("node")).alias("hub")
        span = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("size"), hub).where("lo < hi")
        span = stored(span.withColumnRenamed("key", "hk"), "span")
        if span.isEmpty():
            break
        if r < hub_rounds:
            pairs = rows.join(span, F.col("key") == F.col("hk")).where("root <> hub.root").select(F.col("node"), F.col("n"), F.col("hub.node").alias("hn"), F.col("hub.n").alias("hs"))
            pairs = pairs.where(100 * F.least("n", "hs") >= percent * F.greatest("n", "hs")).groupBy("node").agg(F.min("hn").alias("hn"))
            pairs = pairs.select(F.least("node", "hn").alias("a"), F.greatest("node", "hn").alias("b")).distinct()
            found = verified(stored(alike(stored(pairs, "pairs"), nodes, percent), "pairs"), sets, percent)
        else:
            rows = rows.join(span.select("hk", "m", "size"), F.col("key") == F.col("hk")).select("key", "node", "n", "root", "m", "size")
            found = spanning(stored(rows, "open"), nodes, sets, percent)
        found = stored(found, "links")
        if found.isEmpty():
            continue
        links = found if links is None else links.union(found)
        state = stored(components(links), "components")
    if state is None:
        member = nodes.select("f1", "f2", "n", F.col("node").alias("root"), F.col("low").alias("component_id"))
    else:
        rooted = nodes.join(state.withColumnRenamed("node", "sn"), F.col("node") == F.col("sn"), "left").select("f1", "f2", "n", "low", F.coalesce("root", "node").alias("root"))
        lowest = stored(rooted.groupBy("root").agg(F.min("low").alias("component_id")).withColumnRenamed("root", "lr"), "lowest")
        member = rooted.join(lowest, F.col("root") == F.col("lr")).select("f1", "f2", "n", "root", "component_id")
    member = stored(member.withColumnsRenamed({"f1": "g1", "f2": "g2", "n": "gn"}), "member")
    out = docs.drop("bands", "sig").join(member, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("n") == F.col("gn")), "left")
    return out.select("id", "n", "f1", "f2", F.coalesce("component_id", "id").alias("component_id"), "root")


def one_of_each(df: DataFrame, id_col: str, text_col: str, percent: int = 80, k: int = 5) -> DataFrame:
    """The rows of df less near duplicates: of each component the document with the smallest id stays, with all columns.

    Rows that repeat an id, and rows without one, are documents of their own: of those in one component with its smallest id
    (null only where no row has one) the smallest by its text stays, and a row without words links with nothing and stays."""
    found = stored(linked(df, id_col, text_col, percent, k), "near")
    again = found.groupBy(F.col("id").alias("__again")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1 or __again is null")
    again = stored(again.select("__again"), "again")
    gone = found.where("not (id <=> component_id)").select(F.col("id").alias("__gone"))
    if again.isEmpty():
        return df.join(stored(gone, "gone"), df[id_col] == F.col("__gone"), "left_anti")
    left = df.join(stored(gone.union(again).distinct(), "gone"), df[id_col].eqNullSafe(F.col("__gone")), "left_anti")
    # Rows of an id that others have too are told apart by their sets, which are made once more for these rows only.
    mine = fingerprinted(df.join(again, df[id_col].eqNullSafe(F.col("__again")), "left_semi"), text_col, k)
    sets = found.join(again, F.col("id").eqNullSafe(F.col("__again")), "left_semi").where("id <=> component_id").select(F.col("id").alias("__id"), F.col("n").alias("__sn"), F.col("f1").alias("__s1"), F.col("f2").alias("__s2"), F.col("root").alias("__root")).distinct()
    at = mine[id_col].eqNullSafe(F.col("__id")) & (F.col("__n") == F.col("__sn")) & (F.col("__f1") == F.col("__s1")) & (F.col("__f2") == F.col("__s2"))
    mine = mine.join(stored(sets, "kept"), at).select(*[mine[c] for c in df.columns], "__root")
    single = mine.where("__root is not null").groupBy(id_col, "__root").agg(F.min_by(F.struct(*df.columns), F.struct(F.col(text_col).isNull(), text_col)).alias("__row")).select("__row.*")
    return left.union(single).union(mine.where("__root is null").drop("__root"))


def fingerprinted(df: DataFrame, text_col: str, k: int) -> DataFrame:
    """df with __n, __f1 and __f2 of each row's set, as in described."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in each_slice(batches, "__t", 2 << 20):
            key, at = shingles(buf, offs, k)
            sums = [np.concatenate([np.zeros(1, U64), np.cumsum(mix(key + U64(s)))]) for s in (3, 5)]
            f1, f2 = ((s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at), pa.int64()), pa.array(f1), pa.array(f2)], names=["__row", "__n", "__f1", "__f2"])

    made = df.select(F.struct(*df.columns).alias("__row"), F.col(text_col).alias("__t"))
    kind = made.schema["__row"].dataType.simpleString()
    return made.mapInArrow(run, f"__row {kind}, __n long, __f1 long, __f2 long").select("__row.*", "__n", "__f1", "__f2")


def set_rows(df: DataFrame, id_col: str, text_col: str, wanted: DataFrame, k: int) -> DataFrame:
    """(node, set), one stored row for each node of wanted (node, low, lh): made from the text of a document of the node, as
    sorted fingerprints. Where several rows share that document's id and set, one of them stays."""
    rows, many = named(df, id_col, text_col), wanted.count()
    small = F.broadcast(wanted) if many <= BROADCAST else wanted
    rows = rows.join(small, F.col("id").eqNullSafe(F.col("low")) & F.col("h").eqNullSafe(F.col("lh"))).select("node", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in each_slice(batches, "t", 2 << 20):
            key, at = shingles(buf, offs, k)
            raw = memoryview(key.tobytes())
            sums = [np.concatenate([np.zeros(1, U64), np.cumsum(mix(key + U64(s)))]) for s in (3, 5)]
            f1, f2 = ((s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at), pa.int64()), pa.array(f1), pa.array(f2), pa.array([bytes(raw[8 * a : 8 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())], names=["node", "n", "f1", "f2", "set"])

    made = rows.mapInArrow(run, "node long, n long, f1 long, f2 long, set binary")
    made = stored(made.where(F.col("node") == F.xxhash64("f1", "f2", "n")).select("node", "set"), "sets")
    return made if made.count() == many else stored(made.dropDuplicates(["node"]), "sets")
