"""Language-model scores from an n-gram trie in Elias-Fano levels.

A level holds, each as an Elias-Fano sequence, its contexts (numbers of the level above's entries), the pointers to where
each context's successors begin, and the successors, numbered relative to their context so that the whole level is monotone;
beside them stand quantised probabilities and the counts. The arrays are mapped from a file. An entry's place is its number,
by which the level below names it as a context. The trie is split into shards: an entry's successors lie in the shard where
it lies itself, those of a hot entry by their last word. Documents send distinct n-grams to the shards (exchange.py), so
neither the trie nor the corpus' counts ever meet in one place, and both grow with the input.

Smoothing is by a Dirichlet prior at each order: P(w | c) = (count(c w) + m P(w | shorter c)) / (count(c) + m), down to the
base P(w) = (count(w) + 1) / (N + V + 1). The trie holds the discounted part count(c w) / (count(c) + m), in 16 bits; the
back-off weight m / (count(c) + m) follows from the context's own count.

An n-gram whose context occurs once in all texts, learnt or not, is a leaf that no other text can ask for. Its probability
follows from that one occurrence, so it is not sent; neither is one whose context or word was never learnt.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, flat, span_hash, stored, words
from .eliasfano import EliasFano, mapped
from .exchange import ARROW_MESSAGE, CHUNK, MESSAGE, Bucketed, dealt, freed, messages, runs, shard_count, shards_of, solve
from .packed import gaps, packed, summed, unpacked

END = U64(0x5851F42D4C957F2D)
#: Steps of the quantised log10 probabilities.
FINE = 4096
#: A shard gets on average what this many chunks send.
CHUNKS_A_SHARD = 4


# ---------------------------------------------------------------- a chunk's tokens


def tokenised(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """(chunk, state): packed ids, flags, token counts of a chunk's documents, tokens as numbers of the chunk's distinct
    tokens (frequent ones first), and of these the fingerprints and how often they occur in learnt and in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, t in dealt(batches, size):
            buf, offs = flat(t["text"].combine_chunks())
            ids, learn = t["id"].to_numpy(), t["flag"].to_numpy().astype(bool)
            low = LOWER[buf]
            start, end, doc = words(low, offs)
            n = np.bincount(doc, minlength=len(ids)).astype(np.int64)
            keys, at = np.unique(np.insert(span_hash(low, start, end), np.cumsum(n), END), return_inverse=True)
            total, learnt = np.bincount(at), np.bincount(at, np.repeat(learn, n + 1)).astype(np.int64)
            order = np.argsort(-total, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            state = packed(ids.astype(np.int64), learn.astype(np.int64), n + 1, place[at], keys[order], learnt[order], total[order])
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([state], pa.binary())], names=["chunk", "state"])

    return docs.select("id", "flag", F.col("text").cast("string").alias("text")).mapInArrow(run, "chunk long, state binary")


def sent(states: DataFrame, ask) -> DataFrame:
    """(shard, chunk, body) rows of what ask yields for a chunk's state and the levels' answers so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield from messages(r["chunk"], ask(r["state"], r.get("levels") or []))

    return states.mapInArrow(run, MESSAGE)


def received(states: DataFrame, answers: DataFrame, use, schema: str, arrow: pa.Schema) -> DataFrame:
    """What use returns for each chunk's number, state, the levels' answers so far, and its new answers (shard, body)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return arrow.empty_table()
        r = left.to_pylist()[0]
        return use(r["chunk"], r["state"], r.get("levels") or [], sorted(zip(right["shard"].to_pylist(), right["body"].to_pylist())))

    return states.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


# ---------------------------------------------------------------- words


def _ask_words(shards: int):
    def ask(state: bytes, _: list) -> Iterator[tuple[int, bytes]]:
        keys, learnt, total = unpacked(state)[4:]
        keys = keys.view(U64)
        order = np.argsort(keys)
        keys, learnt, total = keys[order], learnt[order], total[order]
        for k, mine in runs(shards_of(keys, shards)).items():
            yield k, packed(gaps(keys[mine]), learnt[mine], total[mine])

    return ask


def _counted(learnt: np.ndarray, total: np.ndarray) -> np.ndarray:
    """0: not learnt; 1: occurs once in all texts, in a learnt one; else the learnt count and one."""
    return np.where(learnt == 0, 0, np.where(total == 1, 1, learnt + 1))


def _answer_words(bodies: list[bytes]) -> tuple[list[bytes], bytes]:
    """What each chunk's words count and their numbers in the shard; about the shard: its tokens and numbered words."""
    parts = [unpacked(b) for b in bodies]
    keys, number = np.unique(np.concatenate([summed(p[0]) for p in parts]), return_inverse=True)
    learnt, total = (np.bincount(number, np.concatenate([p[k] for p in parts]), len(keys)).astype(np.int64) for k in (1, 2))
    code, place = _counted(learnt, total), np.cumsum(learnt > 0) - 1
    out, i = [], 0
    for p in parts:
        mine = number[i : i + len(p[0])]
        out.append(packed(code[mine], gaps(place[mine][code[mine] > 0])))
        i += len(p[0])
    return out, struct.pack("<qq", int(learnt.sum()), int((learnt > 0).sum()))


def _know_words(state: bytes, answers: list[tuple[int, bytes]], shards: int, bases: np.ndarray) -> bytes:
    """The state with, in place of fingerprints, each distinct token's number and one (0: not learnt) and count, and END's place."""
    ids, learn, size, tok, keys, _, _ = unpacked(state)
    keys = keys.view(U64)
    order = np.argsort(keys)
    number, code = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    places = runs(shards_of(keys[order], shards))
    for k, body in answers:
        c, place = unpacked(body)
        mine = order[places[k]]
        code[mine] = c
        number[mine[c > 0]] = summed(place).view(np.int64) + bases[k] + 1
    return packed(ids, learn, size, tok, number, code, np.flatnonzero(keys == END))


# ---------------------------------------------------------------- the trie


class Level:
    """One order of a shard's trie: sorted contexts, how many successors each has, and of these words, counts, probabilities."""

    def __init__(self, contexts: np.ndarray, sizes: np.ndarray, word: np.ndarray, count: np.ndarray, p: np.ndarray, bits: int):
        self.bits = U64(bits)
        relative = (np.repeat(np.arange(len(sizes)), sizes).astype(U64) << self.bits) | word.astype(U64)
        self.contexts, self.pointers, self.words = EliasFano(contexts), EliasFano(np.append(0, np.cumsum(sizes))), EliasFano(relative)
        arrays = {"codes": quantised(p), "counts": count}
        for name in ("contexts", "pointers", "words"):
            arrays |= {f"{name}.{a}": getattr(getattr(self, name), a) for a in getattr(self, name).arrays()}
        for k, a in mapped(**arrays).items():
            name, _, part = k.partition(".")
            setattr(getattr(self, name) if part else self, part or name, a)

    def find(self, contexts: np.ndarray, sizes: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of sorted contexts' words among the entries, and whether they are there; sizes says how many words each asks for."""
        parent, known = self.contexts.find(contexts)
        some = np.flatnonzero(known)
        end = np.zeros(len(contexts), np.int64)
        end[some] = self.pointers.get(parent[some] + 1).astype(np.int64)
        at = np.flatnonzero(np.repeat(known, sizes))
        place, hit = np.zeros(len(word), np.int64), np.zeros(len(word), bool)
        place[at], hit[at] = self.words.find((np.repeat(parent, sizes)[at].astype(U64) << self.bits) | word[at].astype(U64))
        return place, hit & (place < np.repeat(end, sizes))


def quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-np.log10(p) * FINE) + 1, 1, 65535).astype(np.uint16)


def _answer_level(prior: float, bits: int, last: bool):
    """Builds a shard's level from all chunks' n-grams and looks up each of them."""

    def answer(bodies: list[bytes]) -> tuple[list[bytes], bytes]:
        parts = []
        for b in bodies:
            ctx, total, sizes, word, every, held = unpacked(b)
            count, some = every >> 1, np.flatnonzero(every & 1)
            learnt = count.copy()
            learnt[some] -= held
            first = np.cumsum(sizes) - sizes
            word = summed(word).view(np.int64)
            before = np.where(first > 0, word[np.maximum(first, 1) - 1], 0)
            parts.append((summed(ctx).view(np.int64), total, sizes, word - np.repeat(before, sizes), learnt, count))
        ctx, rank = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        total = np.zeros(len(ctx), np.int64)
        total[rank] = np.concatenate([p[1] for p in parts])
        key = (np.repeat(rank, np.concatenate([p[2] for p in parts])).astype(U64) << U64(bits)) | np.concatenate([p[3] for p in parts]).astype(U64)
        key, number = np.unique(key, return_inverse=True)
        learnt, every = (np.bincount(number, np.concatenate([p[k] for p in parts]), len(key)).astype(np.int64) for k in (4, 5))
        parent, word = (key >> U64(bits)).astype(np.int64), (key & U64((1 << bits) - 1)).astype(np.int64)
        held = np.flatnonzero(learnt)
        sizes = np.bincount(parent[held], minlength=len(ctx))
        some = np.flatnonzero(sizes)
        level = Level(ctx[some], sizes[some], word[held], _counted(learnt, every)[held], learnt[held] / (total[parent[held]] + prior), bits)
        place, hit = level.find(ctx, np.bincount(parent, minlength=len(ctx)), word)
        code, count = np.zeros(len(key), np.uint16), np.zeros(len(key), np.int64)
        code[hit], count[hit] = level.codes[place[hit]], level.counts[place[hit]]
        out, i = [], 0
        for p in parts:
            mine = number[i : i + len(p[3])]
            out.append(packed(code[mine]) if last else packed(code[mine], count[mine], gaps(place[mine][hit[mine]])))
            i += len(p[3])
        return out, struct.pack("<q", len(held))

    return answer


# ---------------------------------------------------------------- a chunk's n-grams


class Walk:
    """A chunk's tokens on their way down the trie: of the n-gram that ends at each token its number, its count, whether it
    occurs only there, and the token's smoothed probability by it."""

    def __init__(self, state: bytes, tokens: int, bases: np.ndarray, prior: float, shards: int):
        self.ids, self.learn, self.size, tok, number, code, end = unpacked(state)
        self.prior, self.shards, self.hot = prior, shards, max(64, tokens // (32 * shards))
        self.first = np.cumsum(self.size) - self.size
        learnt = np.where(code > 1, code - 1, code)
        self.count, self.node, self.alone = learnt[tok], number[tok] - 1, code[tok] == 1
        self.word, self.known, self.word_bases = self.node, self.count, bases
        self.base = (self.count + 1.0) / (tokens + int(bases[-1]) + 1.0)
        self.p, self.bases = self.base, bases
        self.begins = int(learnt[end[0]]) if len(end) else 0  # each document that is learnt from begins once and ends once

    def _before(self, x: np.ndarray, start) -> np.ndarray:
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[self.first] = start
        return out

    def ask(self) -> None:
        """Lays out the distinct n-grams of the next order by shard, context and word."""
        self.ctx, self.total, self.once = self._before(self.node, self.bases[-1]), self._before(self.count, self.begins), self._before(self.alone, False)
        at = np.flatnonzero((self.total > 0) & ~self.once & (self.word >= 0))
        ctx, word, total = self.ctx[at], self.word[at], self.total[at]
        home = np.where(total >= self.hot, np.searchsorted(self.word_bases, word, "right"), np.searchsorted(self.bases, ctx, "right")) - 1
        home = np.minimum(home, self.shards - 1)
        bits = [int(x.max(initial=0)).bit_length() for x in (home, ctx, word)]
        a, b = ctx, word
        if sum(bits) > 64:  # numbers within the chunk keep the order
            a, b = (np.unique(x, return_inverse=True)[1] for x in (ctx, word))
            bits = [bits[0], *(int(x.max(initial=0)).bit_length() for x in (a, b))]
        key = (home.astype(U64) << U64(bits[1] + bits[2])) | (a.astype(U64) << U64(bits[2])) | b.astype(U64)
        order = np.argsort(key)
        new = np.ones(len(order), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        self.number = np.full(len(self.word), -1)
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        self.number[at] = number
        one = order[new]
        self.q = ctx[one], total[one], word[one], home[one]
        self.asked = at

    def parts(self) -> Iterator[tuple[int, bytes]]:
        ctx, total, word, home = self.q
        every = np.bincount(self.number[self.asked], minlength=len(ctx))
        held = every - np.bincount(self.number[self.asked], np.repeat(self.learn, self.size)[self.asked], len(ctx)).astype(np.int64)
        for k, mine in runs(home).items():
            i, j = mine.start, mine.stop
            new = np.ones(j - i, bool)
            new[1:] = ctx[i:j][1:] != ctx[i:j][:-1]
            first = np.flatnonzero(new)
            step = gaps(word[i:j])
            step[first] = word[i:j][first]
            h = held[i:j]
            yield k, packed(gaps(ctx[i:j][first]), total[i:j][first], np.diff(np.append(first, j - i)), step, 2 * every[i:j] + (h > 0), h[h > 0])

    def learn_level(self, answers: list[tuple[int, bytes]], bases: np.ndarray | None) -> None:
        """Goes on by one order. bases: where each shard's numbers begin; None for the last order."""
        parts = [(k, unpacked(b)) for k, b in answers]
        get = lambda i, kind: np.concatenate([p[i] for _, p in parts]) if parts else np.zeros(0, kind)
        code, at, n = get(0, np.uint16), self.asked, self.number[self.asked]
        share = np.where(code > 0, 10.0 ** (-(code.astype(np.float64) - 1) / FINE), 0.0)
        p = self.prior * self.p / (self.total + self.prior)
        p[at] += share[n]
        p[self.once] += 1.0 / (1.0 + self.prior)
        self.p = p
        if bases is None:
            return
        count, node = get(1, np.int64), np.full(len(code), -1)
        node[count > 0] = np.concatenate([summed(p[2]).view(np.int64) + bases[k] for k, p in parts]) if parts else 0
        self.count, self.node, self.alone = self.once.astype(np.int64), np.full(len(self.p), -1), self.once.copy()
        self.count[at], self.node[at], self.alone[at] = np.where(count > 1, count - 1, count)[n], node[n], count[n] == 1
        self.bases = bases


def _bases(shards: int, numbers: dict[int, int]) -> np.ndarray:
    """Where each shard's numbers begin among all, and how many there are."""
    return np.append(0, np.cumsum([numbers.get(k, 0) for k in range(shards)])).astype(np.int64)


def score(df: DataFrame, id_col: str, text_col: str, learn, orders: int = 3, prior: float = 8.0) -> DataFrame:
    """Scores all whole texts by a model learnt from the rows where learn (a Column of df) is true.

    Returns id (long), n_tokens, n_known, train_tokens, base_score and score: the model's log10 probability of the text's
    lower-cased (A-Z) words `[^\\x20\\x09-\\x0D]+` and of its end. A null text has only the end; a null id stays null and its
    row is scored like any other. Rows that repeat an id are texts of their own. With nothing to learn from, every token is
    unknown. An empty table gives no rows. orders is the length of the longest n-gram; each order beyond the first is one more
    pass. prior is the weight m of shorter contexts."""
    spark = df.sparkSession
    none = np.iinfo(np.int64).max  # stands for a null id within the chunks
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(none)).alias("id"), F.col(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("flag"))
    states = Bucketed(tokenised(docs), "tokens")
    shards = shard_count(spark, states.table.count(), CHUNKS_A_SHARD)
    answers = stored(solve(sent(states.table, _ask_words(shards)), _answer_words), "word-counts")
    about = {r["shard"]: struct.unpack("<qq", r["body"]) for r in answers.where("chunk = -1").select("shard", "body").collect()}  # one row a shard
    tokens, bases = sum(a[0] for a in about.values()), _bases(shards, {k: a[1] for k, a in about.items()})
    binary = pa.schema([("chunk", pa.int64()), ("state", pa.binary()), ("levels", pa.list_(pa.struct([("order", pa.int32()), ("shard", pa.int32()), ("body", pa.binary())])))])
    kind = "chunk long, state binary, levels array<struct<order:int,shard:int,body:binary>>"

    def row(chunk: int, state: bytes, levels: list) -> pa.Table:
        return pa.Table.from_pylist([{"chunk": chunk, "state": state, "levels": levels}], schema=binary)

    known = received(states.table, answers.where("chunk >= 0"), lambda chunk, state, _, got: row(chunk, _know_words(state, got, shards, bases), []), kind, binary)
    known = Bucketed(known, "known")
    states.drop()
    places: list[np.ndarray] = []
    bits = max(1, int(bases[-1]).bit_length())

    def walked(state: bytes, levels: list, places: list[np.ndarray]) -> Walk:
        w = Walk(state, tokens, bases, prior, shards)
        for k, base in enumerate(places):
            w.ask()
            w.learn_level([(x["shard"], x["body"]) for x in levels if x["order"] == k + 2], base)
        return w

    for order in range(2, orders + 1):
        freed(spark)

        def ask(state: bytes, levels: list, places: list[np.ndarray] = list(places)) -> Iterator[tuple[int, bytes]]:
            w = walked(state, levels, places)
            w.ask()
            yield from w.parts()

        found = solve(sent(known.table, ask), _answer_level(prior, bits, order == orders))
        if order == orders:
            break
        found = stored(found, "level")
        numbers = {r["shard"]: struct.unpack("<q", r["body"])[0] for r in found.where("chunk = -1").select("shard", "body").collect()}  # one row a shard
        freed(spark)

        def keep(chunk: int, state: bytes, levels: list, got: list[tuple[int, bytes]], order: int = order) -> pa.Table:
            return row(chunk, state, levels + [{"order": order, "shard": s, "body": b} for s, b in got])

        more = Bucketed(received(known.table, found.where("chunk >= 0"), keep, kind, binary), "known")
        known.drop()
        known = more
        places.append(_bases(shards, numbers))

    arrow = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def add_up(chunk: int, state: bytes, levels: list, got: list[tuple[int, bytes]]) -> pa.Table:
        w = walked(state, levels, places)
        if orders > 1:
            w.ask()
            w.learn_level(got, None)
        doc = np.repeat(np.arange(len(w.size)), w.size)
        total = lambda x: np.bincount(doc, x, len(w.size))
        n = len(w.size)
        columns = [w.ids, w.size, total(w.known > 0).astype(np.int64), np.full(n, tokens), total(np.log10(w.base)), total(np.log10(w.p))]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    schema = "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    last = found.where("chunk >= 0") if orders > 1 else answers.where("chunk < -1")
    out = received(known.table, last, add_up, schema, arrow)
    return out.withColumn("id", F.when(F.col("id") != none, F.col("id")))
