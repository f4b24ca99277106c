"""Substring deduplication by prefix-partitioned suffix trees, cut at the depth of one window.

A suffix of a document, cut to its first 50 words, is a leaf; two suffixes meet in an internal node at depth 50 exactly if
their windows are equal. Before trees are built, anchors sift out suffixes that cannot meet another: a window's anchor is the
least fingerprint of the 8-word runs in it. Equal windows have equal anchors, so a window whose anchor no other document
holds is unique. An anchor with very many windows, as a line gives that very many documents hold, would make its shard grow
with the input; its windows are dealt by their own fingerprints instead, so that equal ones still meet.

The rest travels as stretches of words: neighbouring windows mostly share their anchor, so a stretch goes to its anchor's
shard once, with its words, instead of 50 times by the prefixes of its suffixes. A shard splits its suffixes by prefixes of
one word, or of more where many suffixes share them, into groups of bounded size, and builds each group's subtree: suffixes
sorted by words, and the length of the prefix that neighbours share, which lays out the internal nodes. A node at full depth
is a repeat; maximal repeats are the runs of neighbouring windows that end in such nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, span_hash, stored, windows, words
from .exchange import ARROW_MESSAGE, MESSAGE, Chunk, Chunks, freed, messages, runs, shard_count, shards_of, solve
from .packed import gaps, packed, summed, unpacked

GRAM = 8
#: A shard gets on average what this many chunks send: less than their own words where all of them repeat.
CHUNKS_A_SHARD = 1
#: Windows that one anchor may bring to its shard; they are some five times as many words.
BUSY = 1 << 18


class Suffixes:
    """The windows of a chunk: document of each word, which words start a window, and fingerprints."""

    def __init__(self, c: Chunk, size: int):
        self.size = size
        self.start, self.end, self.doc = words(c.buf, c.offs)
        self.word = span_hash(c.buf, self.start, self.end)
        n = len(self.doc) - size + 1
        self.at = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :]) if n > 0 else np.zeros(0, np.int64)
        self.id = c.ids[self.doc[self.at]] if len(self.at) else np.zeros(0, np.int64)

    def anchors(self) -> np.ndarray:
        """For each window the least fingerprint of the runs of GRAM words in it."""
        gram = min(GRAM, self.size)
        low, wide = windows(self.word, gram), self.size - gram + 1
        if not len(self.at):
            return np.zeros(0, U64)
        step = 1
        while step * 2 <= wide:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if wide > step:
            low = np.minimum(low[: len(low) - (wide - step)], low[wide - step :])
        return low[self.at]

    def prints(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        other = mix(self.word ^ U64(0xA0761D6478BD642F))
        return windows(self.word, self.size)[at], windows(other, self.size)[at]


def _lowest(keys: tuple[np.ndarray, ...], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of distinct keys: (row of each distinct key, its least id, its greatest id, distinct number of each row)."""
    order = np.lexsort((ids, *reversed(keys)))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    first = np.flatnonzero(new)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    last = np.append(first[1:], len(order)) - 1
    return order[first], ids[order[first]], ids[order[last]], number


def _anchor_rows(c: Chunk, size: int):
    s = Suffixes(c, size)
    a = mix(s.anchors())  # least values lie near 0, and a shard is a range
    row, low, high, number = _lowest((a,), s.id)
    return s, a[row], low, high, number


def _suffix_rows(c: Chunk, size: int, answers: list[tuple[int, bytes]], shards: int):
    """Of those suffixes whose anchors repeat: their places and ids, of distinct windows the row of one suffix, shard and
    least id, by shard and place, and the distinct window of each suffix."""
    s, keys, _, _, first = _anchor_rows(c, size)
    at = runs(shards_of(keys, shards))
    again, busy = np.zeros((2, len(keys)), bool)
    for shard, body in answers:
        mine = at[shard]
        again[mine], busy[mine] = np.unpackbits(np.frombuffer(body, np.uint8), count=2 * (mine.stop - mine.start)).astype(bool).reshape(2, -1)
    live = np.flatnonzero(again[first]) if len(first) else np.zeros(0, np.int64)
    at, ids, anchor = s.at[live], s.id[live], keys[first[live]] if len(live) else np.zeros(0, U64)
    prints = s.prints(at)
    row, low, _, number = _lowest(prints, ids)
    alone = busy[first[live]][row] if len(live) else np.zeros(0, bool)
    shard = shards_of(mix(np.where(alone, anchor[row] ^ prints[0][row], anchor[row])), shards)
    order = np.lexsort((row, shard))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return s, at, ids, row[order], shard[order], low[order], place[number]


def _stretches(word: np.ndarray, at: np.ndarray, low: np.ndarray, size: int) -> bytes:
    """Windows that start at the sorted places at, as stretches of neighbours: their lengths, words, and each window's id."""
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1))
    count = np.diff(np.append(first, len(at)))
    wide = count + size - 1
    idx = np.arange(int(wide.sum())) + np.repeat(at[first] - (np.cumsum(wide) - wide), wide)
    words_, spot = np.unique(word[idx], return_inverse=True)
    ids, which = np.unique(low, return_inverse=True)
    return packed(count, gaps(words_), spot, gaps(ids), which)


def _bit_answer(bodies: list[bytes], width: int, rule) -> tuple[list[bytes], None]:
    parts = [np.frombuffer(x, np.int64).reshape(width, -1) for x in bodies]
    every = np.concatenate(parts, 1)
    got = rule(every)
    out, i = [], 0
    for p in parts:
        out.append(np.packbits(got[:, i : i + p.shape[1]]).tobytes())
        i += p.shape[1]
    return out, None


def _repeats(every: np.ndarray, busy: int) -> np.ndarray:
    """Of anchors (key, least id, greatest id, windows): whether two different documents hold one, and whether it has more
    than busy windows in all."""
    _, number = np.unique(every[0], return_inverse=True)
    low, high = np.full(number.max() + 1, np.iinfo(np.int64).max), np.full(number.max() + 1, np.iinfo(np.int64).min)
    np.minimum.at(low, number, every[1])
    np.maximum.at(high, number, every[2])
    count = np.zeros(len(low), np.int64)
    np.add.at(count, number, every[3])
    return np.stack([low < high, count > busy])[:, number]


def ranks(word: np.ndarray, size: int) -> list[np.ndarray]:
    """For 1, 2, 4, ... words up to size: the rank of the run of so many words from each place, in lexicographic order."""
    out, k = [np.unique(word, return_inverse=True)[1]], 1
    while 2 * k <= size:
        after = np.zeros(len(word), np.int64)
        after[: max(0, len(word) - k)] = out[-1][k:] + 1
        out.append(np.unique(out[-1] * (len(word) + 2) + after, return_inverse=True)[1])
        k *= 2
    return out


def prefix_groups(at: np.ndarray, by: list[np.ndarray], most: int) -> list[np.ndarray]:
    """The suffixes that start at the places at, split by prefixes that grow until a group has at most `most` of them (or
    the prefix is as long as by has it); neighbouring small groups go together."""
    done, wide = [], [at]
    for rank in by:
        rest = []
        for part in wide:
            order = np.argsort(rank[part], kind="stable")
            part, key = part[order], rank[part][order]
            cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            ends = np.append(cut, len(part))
            i = 0
            while i < len(cut):
                j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, "right")) - 1)
                (done if ends[j] - ends[i] <= most else rest).append(part[ends[i] : ends[j]])
                i = j
        wide = rest
        if not wide:
            break
    return done + wide


def subtree(at: np.ndarray, by: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in lexicographic order of their first size words, and how many words each shares with the one before."""
    k = 1 << (len(by) - 1)
    order = np.lexsort((by[-1][at + size - k], by[-1][at]))
    leaf = at[order]
    shared = np.zeros(len(leaf), np.int64)
    for step, rank in reversed(list(enumerate(by))):
        for _ in range(2 if step == len(by) - 1 else 1):
            x, y = leaf[1:] + shared[1:], leaf[:-1] + shared[1:]
            same = (shared[1:] + (1 << step) <= size) & (rank[np.minimum(x, len(rank) - 1)] == rank[np.minimum(y, len(rank) - 1)])
            shared[1:] += same.astype(np.int64) << step
    return leaf, shared


def _deep_nodes(bodies: list[bytes], size: int, group: int) -> tuple[list[bytes], None]:
    """Of each chunk's windows: whether the node at full depth in which one ends has a smaller id below it."""
    parts = [unpacked(b) for b in bodies]
    word = np.concatenate([summed(p[1])[p[2]] for p in parts])
    low = np.concatenate([summed(p[3]).view(np.int64)[p[4]] for p in parts])
    count = np.concatenate([p[0] for p in parts])
    begin = np.cumsum(count + size - 1) - (count + size - 1)
    at = np.arange(int(count.sum())) + np.repeat(begin - (np.cumsum(count) - count), count)
    window = np.empty(len(word), np.int64)
    window[at] = np.arange(len(at))
    by, out = ranks(word, size), np.zeros(len(at), bool)
    for part in prefix_groups(at, by, group):
        leaf, shared = subtree(part, by, size)
        node = np.flatnonzero(shared < size)  # a deep node begins where fewer words are shared
        least = np.minimum.reduceat(low[window[leaf]], node)
        out[window[leaf]] = np.repeat(least, np.diff(np.append(node, len(leaf)))) < low[window[leaf]]
    ends = np.cumsum([len(p[4]) for p in parts])
    return [np.packbits(x).tobytes() for x in np.split(out, ends[:-1])], None


def dedup(df: DataFrame, id_col: str, text_col: str, size: int = 50, group: int = 1 << 20, with_text: bool = False, extra: list[str] | None = None, busy: int = BUSY) -> DataFrame:
    """Removes each word that lies in a window of size words whose sequence also starts in a document with a smaller id.

    Returns id (long), n_words, n_removed, kept_sha256 (of the kept words joined by one space), n_spans (removed stretches)
    and, if with_text, text (as it was if nothing is removed, else the kept words joined by one space) and the columns of
    extra as strings. Windows are judged on the input. Words are `[^\\x20\\x09-\\x0D]+`, unchanged. A null text has no
    words. Rows that repeat an id are no smaller than each other, so they do not remove each other's words; a row with a
    null id counts as one with the greatest possible id. An empty table gives no rows.

    group bounds the suffixes of one prefix group; prefixes with more grow longer. busy bounds the windows that one anchor
    brings to a shard."""
    spark = df.sparkSession
    none = np.iinfo(np.int64).max
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(none)).alias("id"), F.col(text_col).alias("text"), F.lit(True).alias("flag"), *[F.col(c).alias(f"e{i}") for i, c in enumerate(extra or [])])
    chunks = Chunks(docs, extra=[f"e{i}" for i in range(len(extra or []))])
    further = ["text", *(extra or [])] if with_text else []
    shards = shard_count(spark, chunks.count, CHUNKS_A_SHARD)

    def ask_anchors(c: Chunk) -> Iterator[tuple[int, bytes]]:
        s, keys, low, high, number = _anchor_rows(c, size)
        count = np.bincount(number, minlength=len(keys))
        for k, mine in runs(shards_of(keys, shards)).items():
            yield k, np.stack([keys[mine].view(np.int64), low[mine], high[mine], count[mine]]).tobytes()

    again = stored(solve(chunks.send(ask_anchors), lambda bodies: _bit_answer(bodies, 4, lambda every: _repeats(every, busy))), "repeats")
    freed(spark)

    def ask_suffixes(c: Chunk, answers: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        s, at, _, row, shard, low, _ = _suffix_rows(c, size, answers, shards)

        def parts() -> Iterator[tuple[int, bytes]]:
            for k, mine in runs(shard).items():
                yield k, _stretches(s.word, at[row[mine]], low[mine], size)

        yield from messages(c.number, parts())

    leaves = chunks.receive(again, ask_suffixes, MESSAGE, ARROW_MESSAGE)
    nodes = solve(leaves, lambda bodies: _deep_nodes(bodies, size, group))
    both = again.select((F.col("shard") * 2).alias("shard"), "chunk", "body").union(nodes.select((F.col("shard") * 2 + 1).alias("shard"), "chunk", "body"))
    names = ["id", "n_words", "n_removed", "kept_sha256", "n_spans", *further]
    arrow = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("n_spans", pa.int64()), *[(c, pa.string()) for c in further]])

    def cut(c: Chunk, got: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        s, at, ids, _, shard, low, number = _suffix_rows(c, size, [(k // 2, b) for k, b in got if k % 2 == 0], shards)
        places = runs(shard)
        smaller = np.zeros(len(low), bool)
        for k, body in got:
            if k % 2:
                mine = places[k // 2]
                smaller[mine] = np.unpackbits(np.frombuffer(body, np.uint8), count=mine.stop - mine.start).astype(bool)
        gone = at[smaller[number] | (ids > low[number])] if len(at) else at
        cover = np.zeros(len(s.doc) + 1, np.int32)
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + size, -1)
        drop = np.cumsum(cover[:-1]) > 0
        n = len(c.ids)
        total = np.bincount(s.doc, minlength=n) if n else np.zeros(0)
        lost = np.bincount(s.doc[drop], minlength=n) if n else np.zeros(0)
        edge = drop.copy()
        edge[1:] &= ~drop[:-1] | (s.doc[1:] != s.doc[:-1])
        spans = np.bincount(s.doc[edge], minlength=n) if n else np.zeros(0)
        raw, texts = c.buf.tobytes(), []
        first = np.searchsorted(s.doc, np.arange(n + 1))
        for d in range(n):
            i, j = first[d], first[d + 1]
            keep = np.flatnonzero(~drop[i:j]) + i
            texts.append(b" ".join([raw[x:y] for x, y in zip(s.start[keep].tolist(), s.end[keep].tolist())]))
        out = [pa.array(c.ids, pa.int64()), pa.array(total, pa.int64()), pa.array(lost, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array(spans, pa.int64())]
        if with_text:
            whole = [raw[a:b] for a, b in zip(c.offs[:-1].tolist(), c.offs[1:].tolist())]
            out.append(pa.array([(t if k else w).decode() for t, w, k in zip(texts, whole, lost.tolist())], pa.string()))
            out += c.extra
        yield pa.RecordBatch.from_arrays(out, schema=arrow)

    schema = "id long, n_words long, n_removed long, kept_sha256 string, n_spans long" + "".join(f", `{x}` string" for x in further)
    return chunks.receive(both, cut, schema, arrow).withColumn("id", F.when(F.col("id") != none, F.col("id"))).select(*names)
