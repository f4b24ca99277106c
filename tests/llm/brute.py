"""Plain restatements of the operators' contracts, for small inputs."""

import hashlib
import zlib
from collections import Counter, defaultdict


def words(text):
    return (text or "").encode().split()


def low(text):
    return (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()


def dedup(rows, size=50):
    least = {}
    docs = [(i, words(t)) for i, t in rows]
    for i, w in docs:
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if least[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def shingle_set(text, k=5):
    w = low(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def near(rows, percent=85):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    by = defaultdict(list)
    for n, (_, s) in enumerate(sets):
        for x in s:
            by[x].append(n)
    seen = Counter()
    for group in by.values():
        for a in range(len(group)):
            for b in range(a):
                seen[group[b], group[a]] += 1
    for (a, b), common in seen.items():
        if 100 * common >= percent * (len(sets[a][1]) + len(sets[b][1]) - common):
            parent[find(a)] = find(b)
    lowest = {}
    for n, (i, _) in enumerate(sets):
        r = find(n)
        lowest[r] = min(lowest.get(r, i), i, key=lambda x: (x is None, x or 0))
    return [(i, len(s), lowest[find(n)], i == lowest[find(n)]) for n, (i, s) in enumerate(sets)]


def held(i, mod, rest):
    return zlib.crc32(str(i).encode()) % mod == rest
