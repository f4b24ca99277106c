"""Quality rules as a short-circuit cascade ordered by rejection per cost."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, each_slice, flat, slices, span_hash, windows, words

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
#: Characters of each sampled text on which rules are timed.
SAMPLE_CHARS = 20_000
#: Stop words of four languages, fixed values.
STOP = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were her all"
    " der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei"
    " de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son mais comme ou si leur y"
    " el los se del las por con no una su para es al lo como más o pero sus este ya porque esta entre cuando muy sin sobre".split()
)


class Text:
    """Whole documents of one run, with what rules derive from them; each measure is made at most once per run."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.buf, self.offs, self.n = buf, offs, len(offs) - 1
        self._made: dict[str, object] = {}

    def _once(self, name: str, f: Callable):
        if name not in self._made:
            self._made[name] = f()
        return self._made[name]

    @property
    def words(self):
        return self._once("words", lambda: words(self.buf, self.offs))

    @property
    def hashes(self):
        return self._once("hashes", lambda: span_hash(self.buf, *self.words[:2]))

    def per_doc(self, doc: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(doc, weights, self.n).astype(np.int64) if len(doc) else np.zeros(self.n, np.int64)

    def per_byte(self, mask: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return upto[self.offs[1:]] - upto[self.offs[:-1]]

    @property
    def n_words(self):
        return self._once("n_words", lambda: self.per_doc(self.words[2]))

    @property
    def word_chars(self):
        return self._once("word_chars", lambda: self.per_byte(((self.buf & 0xC0) != 0x80) & ~SPACE[self.buf]))

    @property
    def n_symbols(self):
        return self._once("n_symbols", lambda: self.per_byte(SYMBOL[self.buf]))

    @property
    def lines(self):
        """Start, end and document of each line that holds a word, split at \\n only."""

        def make():
            cut = np.unique(np.concatenate([self.offs[:-1], np.flatnonzero(self.buf == 10) + 1])) if len(self.buf) else np.zeros(0, np.int64)
            cut = cut[cut < len(self.buf)]
            end = np.append(cut[1:], len(self.buf))[: len(cut)]
            end = end - ((end > cut) & (self.buf[np.maximum(end - 1, 0)] == 10)) if len(cut) else end
            upto = np.concatenate([[0], np.cumsum(~SPACE[self.buf], dtype=np.int64)])
            full = upto[end] > upto[cut]
            cut, end = cut[full], end[full]
            return cut, end, np.searchsorted(self.offs, cut, "right") - 1

        return self._once("lines", make)

    @property
    def n_dup_lines(self):
        def make():
            start, end, doc = self.lines
            if not len(start):
                return np.zeros(self.n, np.int64)
            h = span_hash(self.buf, start, end)
            order = np.lexsort((h, doc))
            again = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
            return self.per_doc(doc[order][1:][again])

        return self._once("n_dup_lines", make)

    @property
    def n_lines(self):
        return self._once("n_lines", lambda: self.per_doc(self.lines[2]))

    @property
    def n_repeat_words(self):
        def make():
            doc = self.words[2]
            w = windows(self.hashes, 5)
            inside = np.flatnonzero(doc[: len(w)] == doc[4 : 4 + len(w)])
            if not len(inside):
                return np.zeros(self.n, np.int64)
            key, d = w[inside], doc[inside]
            order = np.lexsort((key, d))
            same = np.concatenate([[False], (key[order][1:] == key[order][:-1]) & (d[order][1:] == d[order][:-1])])
            twice = same | np.append(same[1:], False)
            cover = np.zeros(len(doc) + 1, np.int32)
            at = inside[order[twice]]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + 5, -1)
            return self.per_doc(doc[np.cumsum(cover[:-1]) > 0])

        return self._once("n_repeat_words", make)

    @property
    def n_stutter(self):
        """Words that repeat the word before them."""

        def make():
            doc, h = self.words[2], self.hashes
            return self.per_doc(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])])

        return self._once("n_stutter", make)

    @property
    def n_stop(self):
        """Words that are stop words of one of four languages."""
        return self._once("n_stop", lambda: self.per_doc(self.words[2][np.isin(span_hash(LOWER[self.buf], *self.words[:2]), _stop())]))

    @property
    def n_alpha(self):
        """Bytes of letters, where all bytes beyond ASCII count as such."""
        low = LOWER[self.buf]
        return self._once("n_alpha", lambda: self.per_byte((low >= 128) | ((low >= 97) & (low <= 122))))


def _stop() -> np.ndarray:
    if "h" not in _made:
        raw = [w.encode() for w in sorted(STOP)]
        end = np.cumsum([len(w) for w in raw])
        _made["h"] = span_hash(np.frombuffer(b"".join(raw), np.uint8), end - [len(w) for w in raw], end)
    return _made["h"]


_made: dict[str, np.ndarray] = {}


@dataclass(frozen=True)
class Rule:
    """name, and a function from Text to the mask of documents that the rule rejects."""

    name: str
    rejects: Callable[[Text], np.ndarray]


def base_rules() -> list[Rule]:
    return [
        Rule("few_words", lambda t: t.n_words < 10),
        Rule("repeats", lambda t: 100 * t.n_repeat_words > 20 * t.n_words),
    ]


def further_rules() -> list[Rule]:
    """Rules on whole texts, set so that plain prose passes by a wide margin."""
    return [
        Rule("symbols", lambda t: 100 * t.n_symbols > 10 * t.n_words),
        Rule("dup_lines", lambda t: (t.n_dup_lines >= 3) & (100 * t.n_dup_lines > 30 * t.n_lines)),
        Rule("stutter", lambda t: 100 * t.n_stutter > 25 * t.n_words),
        Rule("word_length", lambda t: (t.word_chars < 2 * t.n_words) | (t.word_chars > 15 * t.n_words)),
        Rule("letters", lambda t: 100 * t.n_alpha < 40 * t.per_byte(~SPACE[t.buf])),
        Rule("stop_words", lambda t: (t.n_words >= 50) & (100 * t.n_stop < t.n_words)),
    ]


def measured(texts: list, rules: list[Rule]) -> list[tuple[str, float, float]]:
    """(name, seconds a byte, share rejected) of each rule on its own over sample texts."""
    buf, offs = flat(pa.array(texts, pa.string()))
    out = []
    for r in rules:
        spent, rejected = 0.0, 0
        for i, j in slices(offs):
            t = Text(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            began = time.perf_counter()
            rejected += int(r.rejects(t).sum())
            spent += time.perf_counter() - began
        out.append((r.name, spent / max(1, len(buf)), rejected / max(1, len(texts))))
    return out


def cascade_order(figures: list[tuple[str, float, float]]) -> list[str]:
    """Rules by rejection per cost, the highest first: least expected cost when rules reject independently."""
    return [name for name, cost, share in sorted(figures, key=lambda f: (-(f[2] / max(f[1], 1e-12)), f[1], f[0]))]


def sample_order(df: DataFrame, text_col: str, rules: list[Rule], rows: int, spark_seed: int = 7) -> list[str]:
    """Order of rules from a sample of about rows documents. It changes what is computed, never a verdict."""
    n = df.count()
    share = min(1.0, 2.0 * rows / max(1, n))
    texts = [r[0] for r in df.select(F.substring(F.col(text_col), 1, SAMPLE_CHARS)).sample(share, spark_seed).limit(rows).collect()]
    return cascade_order(measured(texts, rules))


def part_of(buf: np.ndarray, offs: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents numbered in keep."""
    size = (offs[1:] - offs[:-1])[keep]
    at = np.concatenate([[0], np.cumsum(size)])
    return buf[np.arange(at[-1]) + np.repeat(offs[:-1][keep] - at[:-1], size)], at


def verdicts(buf: np.ndarray, offs: np.ndarray, rules: list[Rule]) -> np.ndarray:
    """The first rule that rejects each document, or -1. A rule sees only documents that all rules before it let pass;
    once a tenth has gone, their bytes are dropped."""
    out = np.full(len(offs) - 1, -1)
    live = np.arange(len(out))
    text = Text(buf, offs)
    within = np.arange(len(out))
    for k, r in enumerate(rules):
        if not len(live):
            break
        bad = r.rejects(text)[within]
        out[live[bad]] = k
        live, within = live[~bad], within[~bad]
        if len(within) < 0.9 * text.n and k + 1 < len(rules):
            text = Text(*part_of(text.buf, text.offs, within))
            within = np.arange(len(live))
    return out


def quality(df: DataFrame, id_col: str, text_col: str, rules: list[Rule] | None = None, sample_rows: int = 512) -> DataFrame:
    """Base measures and the cascade's verdict on every whole text.

    Returns id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept. Null text: no words, so
    base_failed. The sample (at most sample_rows texts, a documented bound, and of each what SAMPLE_CHARS allows) only
    orders the rules by measured seconds, so the rule that rejects a text first is not told; kept does not depend on it. Repeated rows each get a
    row, an empty table gives none, other columns are not read. One narrow pass without a shuffle."""
    rules = further_rules() if rules is None else rules
    order = sample_order(df, text_col, rules, sample_rows)
    by_name = {r.name: r for r in rules}
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]

    def run(batches: Iterator[pa.RecordBatch]):
        chain = [by_name[n] for n in order]
        for part, buf, offs in each_slice(batches, "t", 2 << 20):
            t = Text(buf, offs)
            failed = np.zeros(t.n, bool)
            for r in base_rules():
                failed |= r.rejects(t)
            rest = np.flatnonzero(~failed)
            first = np.full(t.n, -1)
            if len(rest):
                first[rest] = verdicts(*part_of(buf, offs, rest), chain) if len(rest) < t.n else verdicts(buf, offs, chain)
            counts = [pa.array(x, pa.int64()) for x in (t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words)]
            yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array(failed), pa.array(~failed & (first < 0))], names=names)

    rows = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


def keep_good(df: DataFrame, id_col: str, text_col: str, sample_rows: int = 512) -> DataFrame:
    """The rows of df whose text passes base rules and cascade, with all their columns, without a join."""
    rules = base_rules() + further_rules()
    order = sample_order(df, text_col, rules, sample_rows)
    by_name = {r.name: r for r in rules}

    def run(batches):
        chain = [by_name[n] for n in order]
        for part, buf, offs in each_slice(batches, text_col, 2 << 20):
            yield part.filter(pa.array(verdicts(buf, offs, chain) < 0))

    return df.mapInArrow(run, df.schema)
