"""Packing documents into sequences: bin completion branch and bound over the histogram of piece lengths.

How many pieces have each length is all that the number of sequences depends on, and there are at most `capacity`
lengths. So the driver plans on a histogram of bounded size, and executors place the pieces by rank within their length.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import library, sent_classes
from .common import each_slice, ranked, stored

#: A plan is a list of (number of sequences, lengths in one sequence, longest first).
Plan = list[tuple[int, tuple[int, ...]]]


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing on a histogram: the incumbent. Equal pieces that see equal bins are placed in one step."""
    rooms: dict[int, dict[tuple[int, ...], int]] = {}
    free: list[int] = []

    def put(room: int, filling: tuple[int, ...], n: int) -> None:
        if room not in rooms:
            rooms[room] = {}
            bisect.insort(free, room)
        rooms[room][filling] = rooms[room].get(filling, 0) + n

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            k = bisect.bisect_left(free, size)
            if k == len(free):
                each = capacity // size
                full, rest = divmod(left, each)
                if full:
                    put(capacity - each * size, (size,) * each, full)
                if rest:
                    put(capacity - rest * size, (size,) * rest, 1)
                left = 0
            else:
                room = free[k]
                filling, n = next(iter(rooms[room].items()))
                used = min(n, left)
                if used == n:
                    del rooms[room][filling]
                    if not rooms[room]:
                        del rooms[room]
                        free.pop(k)
                else:
                    rooms[room][filling] = n - used
                put(room - size, (*filling, size), used)
                left -= used
    return [(n, f) for by in rooms.values() for f, n in by.items()]


def fillings(room: int, sizes: list[int], counts: dict[int, int], most: int, width: int) -> list[tuple[int, tuple[int, ...]]]:
    """Undominated ways to fill room around the largest piece, the least waste first: (waste, lengths).

    A filling is dominated if a piece left over could still be added, or could replace a smaller one within the room
    (Martello and Toth). Depth first with larger pieces first; most bounds the nodes, width the fillings kept."""
    found: dict[tuple[int, ...], int] = {}
    nodes = 0
    small = [s for s in sizes if s <= room]  # ascending

    def go(left: int, top: int, chosen: tuple[int, ...]) -> bool:
        nonlocal nodes
        nodes += 1
        k = min(bisect.bisect_right(small, left), top)
        fits = False
        while k > 0:
            size = small[k - 1]
            if chosen.count(size) < counts[size]:
                fits = True
                if go(left - size, k, (*chosen, size)):
                    return True
            k -= 1
            if nodes > most:
                return True
            if fits and left - size > 0 and k and len(chosen) >= 3:
                break  # deep down only the largest piece that fits is tried
        if not fits and (not small or left < small[0] or all(chosen.count(s) >= counts[s] for s in small[: bisect.bisect_right(small, left)])):
            found[chosen] = left
            return left == 0 and len(found) >= width
        return False

    go(room, len(small), ())
    kept: list[tuple[int, tuple[int, ...]]] = []
    for chosen, waste in sorted(found.items(), key=lambda x: (x[1], len(x[0]), tuple(-s for s in x[0]))):
        if len(kept) == width:
            break
        if not any(_dominates(k, chosen) for _, k in kept):
            kept.append((waste, chosen))
    return kept


def _dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether each piece of b can stand in place of a distinct piece of a that is as large, one for one."""
    return len(a) >= len(b) and all(x >= y for x, y in zip(a, b))


def bin_completion(counts: dict[int, int], capacity: int, nodes: int = 20_000, width: int = 4, tries: int = 400) -> Plan:
    """As few sequences as branch and bound finds within its limits, never more than best fit gives.

    Each node takes the largest length left and one of its undominated fillings, as often as the counts allow. A branch
    is cut when its waste can no longer beat the incumbent, which starts as the best-fit plan. nodes bounds the search
    over all, tries that for one filling list, width its branches; the bounds hold down time, not input."""
    counts = {s: n for s, n in counts.items() if n > 0}
    total = sum(s * n for s, n in counts.items())
    least = -(-total // capacity)
    best = best_fit(counts, capacity)
    size = sum(n for n, _ in best)
    spent = 0

    def take(left: dict[int, int], order: list[int], plan: Plan, bins: int, waste: int) -> bool:
        """Depth first by an explicit stack of alternatives; True when the lower bound is met."""
        nonlocal best, size, spent
        stack = [(left, order, plan, bins, waste)]
        while stack and spent < nodes:
            left, order, plan, bins, waste = stack.pop()
            while order:
                spent += 1
                if waste > (size - 1) * capacity - total or spent >= nodes + len(counts) * 2:
                    break
                big = order[-1]
                pool = dict(left)
                pool[big] -= 1
                small = order if pool[big] else order[:-1]
                ways = fillings(capacity - big, small, pool, tries, width) or [(capacity - big, ())]
                nexts = []
                for w, chosen in ways:
                    need: dict[int, int] = {}
                    for s in (big, *chosen):
                        need[s] = need.get(s, 0) + 1
                    times = min(left[s] // n for s, n in need.items())
                    rest = dict(left)
                    for s, n in need.items():
                        rest[s] -= n * times
                        if not rest[s]:
                            del rest[s]
                    nexts.append((rest, [s for s in order if s in rest], [*plan, (times, (big, *chosen))], bins + times, waste + w * times))
                stack.extend(reversed(nexts[1:]))
                left, order, plan, bins, waste = nexts[0]
            else:
                if bins < size:
                    best, size = plan, bins
                    if size == least:
                        return True
        return False

    if size > least and counts:
        take(counts, sorted(counts), [], 0, 0)
    return sorted(best, key=lambda p: (tuple(-s for s in p[1]), p[0]))


def token_pieces(df: DataFrame, id_col: str, text_col: str, path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Documents as token ids, each with end_id after it, cut into pieces of at most capacity.

    Returns id_col, piece (from 0), start, length, ids_crc32, and ids as little-endian 32-bit bytes if with_ids. A longer
    document is cut so that all pieces but the first are full. Null text: empty, so one piece of just end_id."""
    classes = sent_classes(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        tok = library(path, classes)
        for part, buf, offs in each_slice(batches, "t", 4 << 20):
            ids, at = tok.encode_texts(buf, offs)
            n = len(at) - 1
            all_ids = np.insert(ids, at[1:], np.uint32(end_id)).astype("<u4", copy=False)
            at = at + np.arange(n + 1)
            size = at[1:] - at[:-1]
            pieces = -(-size // capacity)
            doc = np.repeat(np.arange(n), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = size - (pieces - 1) * capacity
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[doc], capacity)
            raw = memoryview(all_ids.tobytes())
            begin = ((at[doc] + start) * 4).tolist()
            spans = [raw[b : b + m] for b, m in zip(begin, (length * 4).tolist())]
            out = [part.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([zlib.crc32(x) for x in spans], pa.int64())]
            if with_ids:
                out.append(pa.array([bytes(x) for x in spans], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, names=[id_col, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, schema)


def pack(pieces: DataFrame, order: list[str], capacity: int = 2048, **limits: int) -> DataFrame:
    """Adds sequence_id (from 0) and offset to rows with a length of 1 to capacity; pieces must be stored.

    order names columns that tell rows of equal length apart. Rows of one length, however many, are ranked in buckets.
    What is broadcast is the plan: at most about capacity patterns."""
    histogram = {int(r["length"]): int(r["count"]) for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    plan = bin_completion(histogram, capacity, **limits)
    runs: dict[int, list[tuple[int, int, int, int]]] = {}  # by length: first rank, first sequence, times in it, offset
    given: dict[int, int] = {}
    sequence = 0
    for n, filling in plan:
        offset = 0
        for size in dict.fromkeys(filling):
            k = filling.count(size)
            runs.setdefault(size, []).append((given.get(size, 0), sequence, k, offset))
            given[size] = given.get(size, 0) + n * k
            offset += k * size
        sequence += n
    sent = pieces.sparkSession.sparkContext.broadcast({s: np.array(r, np.int64) for s, r in runs.items()})
    names = [*pieces.columns, "sequence_id", "offset"]

    def run(batches):
        table = sent.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("__rank").to_numpy()
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for size in np.unique(length).tolist():
                rows, mine = table[size], np.flatnonzero(length == size)
                r = rank[mine]
                row = rows[np.searchsorted(rows[:, 0], r, "right") - 1]
                r = r - row[:, 0]
                seq[mine], off[mine] = row[:, 1] + r // row[:, 2], row[:, 3] + r % row[:, 2] * size
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:-2]), pa.array(seq), pa.array(off)], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked(pieces, ["length"], order, "__rank").mapInArrow(run, schema)


def pack_documents(df: DataFrame, id_col: str, text_col: str, path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Packs whole documents into as few sequences of at most capacity tokens as the search finds.

    Returns a row per piece: token_pieces' columns with sequence_id and offset (gapless from 0 in each sequence). Nulls
    and empty texts are pieces of one token; repeated rows are packed once each; an empty table gives no rows."""
    pieces = stored(token_pieces(df, id_col, text_col, path, capacity, end_id, with_ids), "pieces")
    return pack(pieces, [id_col, "piece", "ids_crc32"], capacity)
