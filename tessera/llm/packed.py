"""Arrays of integers as bytes: seven bits a byte, the least first, then zstd over all."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

U64 = np.uint64
_codec = pa.Codec("zstd", compression_level=1)


def varint(x: np.ndarray) -> bytes:
    x = x.astype(U64)
    if not len(x):
        return b""
    size, top = np.ones(len(x), np.int64), int(x.max())
    for k in range(7, 64, 7):
        if top >> k:
            size += x >= U64(1 << k)
    end = np.cumsum(size)
    out, at = np.empty(int(end[-1]), np.uint8), end - size
    for j in range(int(size.max())):
        if j:
            mine = size > j
            x, at, size = x[mine], at[mine] + 1, size[mine]
        out[at] = (x & U64(127)).astype(np.uint8) | ((size > j + 1).astype(np.uint8) << 7)
        x = x >> U64(7)
    return out.tobytes()


def unvarint(raw: np.ndarray) -> np.ndarray:
    if not len(raw):
        return np.zeros(0, U64)
    end = np.flatnonzero(raw < 128)
    start = np.concatenate([[0], end[:-1] + 1])
    out = (raw[start] & 127).astype(U64)
    live, j = np.flatnonzero(end > start), 1
    while len(live):
        out[live] |= (raw[start[live] + j] & 127).astype(U64) << U64(7 * j)
        j += 1
        live = live[end[live] >= start[live] + j]
    return out


def packed(*arrays: np.ndarray) -> bytes:
    """16-bit arrays stand as they are, others as varints: values are read back as unsigned 64-bit numbers."""
    parts = [a.tobytes() if a.dtype == np.uint16 else varint(a) for a in arrays]
    raw = b"".join(parts)
    head = [x for a, p in zip(arrays, parts) for x in (len(p), a.dtype == np.uint16)]
    return struct.pack(f"<qq{len(head)}q", len(arrays), len(raw), *head) + (_codec.compress(raw, asbytes=True) if raw else b"")


def unpacked(body: bytes) -> list[np.ndarray]:
    """16-bit arrays as such, others as int64 (a value of 2^63 or more is negative)."""
    n, size = struct.unpack_from("<qq", body)
    head = struct.unpack_from(f"<{2 * n}q", body, 16)
    raw = np.frombuffer(_codec.decompress(memoryview(body)[16 + 16 * n :], size), np.uint8) if size else np.zeros(0, np.uint8)
    out, at = [], 0
    for length, short in zip(head[::2], head[1::2]):
        part = raw[at : at + length]
        out.append(np.frombuffer(part.tobytes(), np.uint16) if short else unvarint(part).view(np.int64))
        at += length
    return out


def gaps(x: np.ndarray) -> np.ndarray:
    """Sorted 64-bit values as differences."""
    out = x.astype(U64)
    out[1:] = out[1:] - out[:-1]
    return out


def summed(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x.view(U64), dtype=U64)
