"""Byte-level BPE compiled into deterministic finite-state transducers.

Two transducers do the work.

* The *splitter* has a dozen states and reads character classes; its output marks where pre-tokens start. A text is cut
  into lanes of equal length. The maps of states that classes generate are few, so each has a number and a product
  table composes them: each lane's map is one number, and a parallel prefix scan over lanes gives the true start states.
* The *merger* reads the bytes of a pre-token. Its state holds, for each place from which a vocabulary entry can still be
  in progress, the trie node reached, the token before that place and the token count there relative to now. That is all
  that can matter later, so the states are finitely many; they are compiled when first reached. Each transition carries
  the number of tokens that it adds (it may be negative when pieces merge).

A token sequence is the BPE encoding of its text exactly if each adjacent pair is the encoding of the pair's own text,
so one candidate fits at each byte and the machine is deterministic.
"""

from __future__ import annotations

import json
import pickle
import struct
from collections.abc import Iterator

import numpy as np

from .common import span_hash

#: Classes of characters. Fixed by the pre-tokenizer's pattern: letters of contractions have classes of their own.
LETTER, L_STMD, L_R, L_V, L_L, L_E, NUMBER, OTHER, QUOTE, BLANK, WHITE, END = range(12)
#: States of the splitter: what the open pre-token is.
(NONE, LETTERS, NUMBERS, OTHERS, ONE_BLANK, ONE_WHITE, RUN_BLANK, RUN_WHITE, QUOTED, QUOTE_R, QUOTE_V, QUOTE_L) = range(12)
HERE, BACK = 1, 2
LANE = 128
#: Under a node with more entries than this, tokens before it are not told apart by what may follow.
WIDE = 60


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Tables next[state, class] and out[state, class]; out says whether a pre-token starts here, one place back, or both."""
    to, out = np.zeros((12, 12), np.uint8), np.zeros((12, 12), np.uint8)
    letters = (LETTER, L_STMD, L_R, L_V, L_L, L_E)
    run = {**dict.fromkeys(letters, LETTERS), NUMBER: NUMBERS, OTHER: OTHERS}
    for state in range(12):
        for c in range(12):
            if c == END:
                nxt, o = NONE, BACK if state in (QUOTE_R, QUOTE_V, QUOTE_L) else 0
            elif state in (QUOTE_R, QUOTE_V, QUOTE_L) and c == (L_L if state == QUOTE_L else L_E):
                nxt, o = NONE, 0
            elif state in (QUOTE_R, QUOTE_V, QUOTE_L):  # no contraction: the letter began a pre-token
                nxt, o = {QUOTE: QUOTED, BLANK: ONE_BLANK, WHITE: ONE_WHITE}.get(c, run.get(c)), BACK | (0 if c in letters else HERE)
            elif c in (BLANK, WHITE):
                if state in (ONE_BLANK, ONE_WHITE, RUN_BLANK, RUN_WHITE):
                    nxt, o = RUN_BLANK if c == BLANK else RUN_WHITE, 0
                else:
                    nxt, o = ONE_BLANK if c == BLANK else ONE_WHITE, HERE
            elif state == QUOTED and c in letters:
                nxt, o = {L_STMD: (NONE, 0), L_R: (QUOTE_R, 0), L_V: (QUOTE_V, 0), L_L: (QUOTE_L, 0)}.get(c, (LETTERS, HERE))
            elif c == QUOTE:
                joins = state in (OTHERS, ONE_BLANK, RUN_BLANK, QUOTED)
                nxt = OTHERS if joins else QUOTED
                o = {OTHERS: 0, ONE_BLANK: 0, QUOTED: 0, RUN_BLANK: BACK, RUN_WHITE: BACK | HERE}.get(state, HERE)
            else:
                nxt = run[c]
                same = state in (nxt, ONE_BLANK) or (state == QUOTED and c == OTHER)
                o = 0 if same else {RUN_BLANK: BACK, RUN_WHITE: BACK | HERE}.get(state, HERE)
            to[state, c], out[state, c] = nxt, o
    return to, out


def char_classes() -> np.ndarray:
    """The class of every code point, as the tokenizer library's own pattern engine has it."""
    from tokenizers import Regex, pre_tokenizers

    table = np.full(0x110000, OTHER, np.uint8)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, points))
    place = np.array(points)
    for pattern, c in ((r"\s+", WHITE), (r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for _, (a, b) in pre_tokenizers.Split(Regex(f"(?:{pattern})"), "isolated").pre_tokenize_str(text):
            run = place[a:b]
            if _matches(pattern, text[a]):
                table[run] = c
    for chars, c in (("stmd", L_STMD), ("r", L_R), ("v", L_V), ("l", L_L), ("e", L_E), ("'", QUOTE), (" ", BLANK)):
        for x in chars:
            table[ord(x)] = c
    return table


def _matches(pattern: str, char: str) -> bool:
    """Whether the library's engine finds the pattern in one character."""
    from tokenizers import Regex, pre_tokenizers

    return not pre_tokenizers.Split(Regex(pattern), "removed").pre_tokenize_str(char)


def state_maps(to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All maps of states that classes generate: maps[m, state], by_class[m, c] for m followed by a class,
    and times[m, n] for m followed by n. Map 0 changes nothing. There are few, as most classes forget the state."""
    maps = [bytes(range(len(to))), *(bytes(to[:, c]) for c in range(to.shape[1]))]
    number = {}
    for m in maps:
        number.setdefault(m, len(number))
    known, k = list(number), 0
    while k < len(known):
        for c in range(to.shape[1]):
            got = bytes(known[k]).translate(bytes(to[:, c]) + bytes(256 - len(to)))
            if got not in number:
                number[got] = len(known)
                known.append(got)
        k += 1
    maps = np.array([list(m) for m in known], np.uint8)
    times = np.array([[number[bytes(n[m])] for n in maps] for m in maps], np.int16)
    rows = np.array([number[bytes(to[:, c])] for c in range(to.shape[1])], np.int16)
    return maps, times[:, rows], times


def prefix_scan(own: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The map of all lanes before each lane, composed in log2(lanes) rounds."""
    upto, step = own.copy(), 1
    while step < len(upto):
        upto[step:] = times[upto[:-step], upto[step:]]
        step *= 2
    return np.concatenate([np.zeros(1, own.dtype), upto[:-1]])


class Transducer:
    """The compiled tokenizer of a byte-level BPE file.

    memo bounds the remembered pre-tokens and compiled states; beyond it both start anew, so memory stays bounded."""

    def __init__(self, path: str, classes: np.ndarray | None = None, memo: int = 600_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.memo_most = spec["model"], memo
        back = {c: b for b, c in enumerate(byte_chars())}
        self.text = {i: bytes(back[c] for c in t) for t, i in model["vocab"].items()}
        self.special = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        self.ids = {b: i for i, b in self.text.items() if b not in self.special}
        merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        vocab = model["vocab"]
        self.rank = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(merges)}
        self.made, self.parts = [-1] * (max(self.text) + 1), {}
        for pair, (r, i) in self.rank.items():
            if self.made[i] < 0:
                self.made[i], self.parts[i] = r, pair
        self.classes = char_classes() if classes is None else classes
        self.next, self.out = splitter()
        self.maps = state_maps(self.next)
        self.child: dict[int, int] = {}
        self.token = [-1]
        for b, i in self.ids.items():
            if self._merge(b) == [i]:  # only such an entry can come out of the merges
                node = 0
                for x in b:
                    nxt = self.child.get(node << 8 | x)
                    if nxt is None:
                        nxt = self.child[node << 8 | x] = len(self.token)
                        self.token.append(-1)
                    node = nxt
                self.token[node] = i
        self.below: list[list[int]] = [[] for _ in self.token]  # entries that lie strictly under a node
        for k, node in reversed(self.child.items()):  # a child is numbered after its parent
            up = self.below[k >> 8]
            if self.token[node] >= 0:
                up.append(self.token[node])
            up += self.below[node]
        self.parent = {k >> 8 for k in self.child}
        self._forget()

    def _forget(self) -> None:
        """Starts the compiled machine anew."""
        start = ((0, -1, 0),)
        self.alike: dict[tuple[int, int], int | None] = {}
        self.stands: dict[tuple[int, tuple[int, ...]], int] = {}
        self.states, self.number, self.last, self.edges = [start], {start: 0}, [-1], {}
        self.counts: dict[bytes, int] = {}
        self.coded: dict[bytes, bytes] = {}

    def _merge(self, text: bytes) -> list[int]:
        """The merges applied to a short text, lowest rank first: what the transducer is compiled from."""
        ids = [self.ids[text[i : i + 1]] for i in range(len(text))]
        while len(ids) > 1:
            r, i = min((self.rank.get(p, (1 << 30, 0))[0], i) for i, p in enumerate(zip(ids, ids[1:])))
            if r == 1 << 30:
                break
            ids[i : i + 2] = [self.rank[ids[i], ids[i + 1]][1]]
        return ids

    def _fits(self, a: int, b: int) -> bool:
        """Whether a then b is the encoding of their joint text.

        Undoes merges next to the border, the latest first. If what then meets at the border merges earlier than the
        merge just undone, it would have merged across the border."""
        if a < 0:
            return True
        made, parts, rank = self.made, self.parts, self.rank
        limit = 1 << 30
        while True:
            meet = rank.get((a, b))
            if meet is not None and meet[0] < limit:
                return False
            ra, rb = made[a], made[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, parts[a][1]
            else:  # at equal rank the left one merges first, so it blocks too
                limit, b = rb + 1, parts[b][0]

    def _class(self, node: int, last: int) -> int | None:
        """A token that stands for all those before a place that let the same entries under the node follow; None if none can."""
        got = self.alike.get((node, last), 0)
        if got == 0:
            can = tuple(t for t in self.below[node] if self._fits(last, t))
            got = self.alike[node, last] = self.stands.setdefault((node, can), last) if can else None
        return got

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition's target and the tokens that it adds."""
        going, found, child, token = [], None, self.child, self.token
        for node, last, rel in self.states[state]:
            nxt = child.get(node << 8 | byte)
            if nxt is not None:
                tok = token[nxt]
                if nxt in self.parent:
                    same = last if len(self.below[nxt]) > WIDE else self._class(nxt, last)
                    if same is not None:
                        going.append((nxt, same, rel))
                if tok >= 0 and found is None and self._fits(last, tok):
                    found, delta = tok, rel + 1
        tok = found
        key = (*((n, t, rel - delta) for n, t, rel in going), (0, tok, 0))
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
            self.last.append(tok)
        self.edges[state << 8 | byte] = to, delta
        return to, delta

    def count(self, token: bytes) -> int:
        """Tokens of one pre-token."""
        n = self.counts.get(token)
        if n is None:
            state = n = 0
            edges = self.edges
            for b in token:
                state, d = edges.get(state << 8 | b) or self._compile(state, b)
                n += d
            self.counts[token] = n
        return n

    def encode(self, token: bytes) -> bytes:
        """Token ids of one pre-token, as little-endian 32-bit integers, read back from the tokens that end the states."""
        out = self.coded.get(token)
        if out is None:
            state, last, edges = 0, [], self.edges
            for b in token:
                state, _ = edges.get(state << 8 | b) or self._compile(state, b)
                last.append(self.last[state])
            at, ids = len(token), []
            while at:
                ids.append(last[at - 1])
                at -= len(self.text[ids[-1]])
            out = self.coded[token] = np.array(ids[::-1], "<u4").tobytes()
        return out

    def _segments(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Offsets of texts cut at special strings, the document of each piece, and its special id or -1."""
        raw = buf.tobytes()
        cuts: dict[int, tuple[int, int]] = {}
        for s, i in self.special.items():
            at = raw.find(s)
            while at >= 0:
                d = int(np.searchsorted(offs, at, "right")) - 1
                if at + len(s) <= offs[d + 1]:
                    cuts[at] = at + len(s), i
                    at = raw.find(s, at + len(s))
                else:
                    at = raw.find(s, at + 1)
        if not cuts:
            return offs, np.arange(len(offs) - 1), np.full(len(offs) - 1, -1)
        pieces = [(int(a), -1) for a in offs[:-1]] + [(a, i) for a, (_, i) in cuts.items()] + [(b, -1) for b, _ in cuts.values()]
        docs = [*range(len(offs) - 1)] + [int(np.searchsorted(offs, a, "right")) - 1 for a in cuts] * 2
        order = sorted(range(len(pieces)), key=lambda k: (docs[k], pieces[k][0], pieces[k][1] >= 0))
        starts = np.array([pieces[k][0] for k in order] + [offs[-1]], np.int64)
        return starts, np.array([docs[k] for k in order]), np.array([pieces[k][1] for k in order])

    def split(self, buf: np.ndarray, seg: np.ndarray) -> np.ndarray:
        """Byte offsets at which pre-tokens start, for segments of text by the offsets seg."""
        lead = np.flatnonzero((buf & 0xC0) != 0x80)
        points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
        ends = np.searchsorted(lead, seg[1:])
        cls = np.insert(self.classes[points], ends, END)  # an end after each segment
        place = np.insert(np.arange(len(points)), ends, ends)
        n = len(cls)
        lanes = -(-n // LANE)
        grid = np.full(lanes * LANE, END, np.uint8)
        grid[:n] = cls
        grid = np.ascontiguousarray(grid.reshape(lanes, LANE).T)
        both = (self.next.astype(np.uint16) | self.out.astype(np.uint16) << 8).ravel()
        maps, by_class, times = self.maps
        flat_maps, own = by_class.ravel(), np.zeros(lanes, np.int16)
        for row in grid:
            own = flat_maps.take(own * np.int16(12) + row)
        state = maps[prefix_scan(own, times), NONE].astype(np.uint16)
        marks = np.empty((LANE, lanes), np.uint8)
        for k, row in enumerate(grid):
            got = both.take((state & 255) * np.uint16(12) + row)
            marks[k] = got >> 8
            state = got
        marks = marks.T.ravel()[:n]
        at = np.concatenate([place[np.flatnonzero(marks & HERE)], place[np.flatnonzero(marks & BACK)] - 1])
        at.sort()
        return lead[at]

    def _distinct(self, buf: np.ndarray, offs: np.ndarray):
        """Documents of pre-tokens, which distinct one each is, the distinct ones' bytes, and special strings' places."""
        if len(self.counts) + len(self.coded) > self.memo_most:
            self.counts, self.coded = {}, {}
        if len(self.states) + len(self.alike) > self.memo_most:
            self._forget()
        seg, doc, special = self._segments(buf, offs)
        start = self.split(buf, seg)
        piece = np.searchsorted(seg, start, "right") - 1
        plain = special[piece] < 0
        end = np.concatenate([start[1:], [len(buf)]]) if len(start) else start
        end = np.minimum(end, seg[piece + 1]) if len(start) else end
        start, end, piece = start[plain], end[plain], piece[plain]
        _, first, inverse = np.unique(span_hash(buf, start, end), return_index=True, return_inverse=True)
        raw = buf.tobytes()
        return doc[piece], start, inverse, [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())], seg[:-1][special >= 0], doc[special >= 0], special[special >= 0]

    def count_texts(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        n = len(offs) - 1
        doc, _, inverse, distinct, _, special_doc, _ = self._distinct(buf, offs)
        each = np.array([self.count(t) for t in distinct], np.int64)
        total = np.bincount(doc, each[inverse], n) if len(doc) else np.zeros(n)
        return total.astype(np.int64) + np.bincount(special_doc, minlength=n).astype(np.int64)

    def encode_texts(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (32-bit), and the n + 1 offsets into them."""
        n = len(offs) - 1
        doc, start, inverse, distinct, at, special_doc, special = self._distinct(buf, offs)
        coded = [self.encode(t) for t in distinct] + [np.uint32(i).tobytes() for i in special.tolist()]
        inverse = np.concatenate([inverse, len(distinct) + np.arange(len(special))]).astype(np.int64)
        doc, start = np.concatenate([doc, special_doc]).astype(np.int64), np.concatenate([start, at])
        if len(special):
            order = np.argsort(start, kind="stable")
            inverse, doc = inverse[order], doc[order]
        size = np.array([len(c) // 4 for c in coded], np.int64)
        pool, first = np.frombuffer(b"".join(coded), "<u4"), np.concatenate([[0], np.cumsum(size)])
        each = size[inverse]
        upto = np.concatenate([[0], np.cumsum(each)])
        ids = pool[np.arange(upto[-1]) + np.repeat(first[inverse] - upto[:-1], each)]
        per = np.bincount(doc, each, n).astype(np.int64) if len(doc) else np.zeros(n, np.int64)
        return ids, np.concatenate([[0], np.cumsum(per)])


def byte_chars() -> Iterator[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or the next one from 256 on."""
    spare = 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            yield chr(b)
        else:
            yield chr(spare)
            spare += 1


class Library(Transducer):
    """The same splitter, with the merges of each distinct pre-token left to the tokenizer library's own model."""

    def __init__(self, path: str, classes: np.ndarray | None = None, memo: int = 600_000):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        self.memo_most, self.model = memo, tok.model
        self.special = {t.content.encode(): i for i, t in tok.get_added_tokens_decoder().items()}
        self.classes = char_classes() if classes is None else classes
        self.next, self.out = splitter()
        self.maps = state_maps(self.next)
        self.chars = dict(enumerate(byte_chars()))
        self._forget()

    def encode(self, token: bytes) -> bytes:
        out = self.coded.get(token)
        if out is None:
            ids = [t.id for t in self.model.tokenize(token.decode("latin-1").translate(self.chars))]
            out = self.coded[token] = struct.pack(f"<{len(ids)}I", *ids)
        return out


_ready: dict[tuple, Transducer] = {}


def compiled(spark, path: str):
    """The compiled tokenizer as a broadcast: a fixed size, whatever the input. Workers unpack it once."""
    key = ("sent", path, spark.sparkContext.applicationId)
    if key not in _ready:
        _ready[key] = spark.sparkContext.broadcast(pickle.dumps(Transducer(path), protocol=5))
    return _ready[key]


def unpacked(sent, path: str) -> Transducer:
    """The transducer of the tokenizer at path, kept for the worker's life."""
    key = ("got", path)
    if key not in _ready:
        _ready[key] = pickle.loads(sent.value)
    return _ready[key]


def library(path: str, classes) -> Library:
    """The library's tokenizer behind the splitter, kept for the worker's life."""
    if ("lib", path) not in _ready:
        _ready["lib", path] = Library(path, np.frombuffer(classes.value, np.uint8))
    return _ready["lib", path]


def sent_classes(spark):
    """The character classes as a broadcast of 1.1 MB."""
    key = ("classes", spark.sparkContext.applicationId)
    if key not in _ready:
        _ready[key] = spark.sparkContext.broadcast(char_classes().tobytes())
    return _ready[key]
