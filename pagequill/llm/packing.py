"""Arrays as compact binary values, so that a shuffle moves a few large rows in place of millions of small ones."""

from __future__ import annotations

import struct

import numpy as np
import zstandard


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as one value: the bytes of each rank lie together and the whole is compressed."""
    n = len(arrays[0])
    head = struct.pack("<IB", n, len(arrays)) + "".join(a.dtype.str for a in arrays).encode()
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(n, a.dtype.itemsize).T.tobytes() for a in arrays]
    return zstandard.compress(head + b"".join(planes), 1)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    n, count = struct.unpack_from("<IB", raw)
    at = 5 + 3 * count
    out = []
    for k in range(count):
        kind = np.dtype(raw[5 + 3 * k : 8 + 3 * k].decode())
        size = n * kind.itemsize
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += size
    return out


def deltas(values: np.ndarray) -> np.ndarray:
    """Differences from the value before; :func:`undelta` turns them back."""
    return np.diff(values, prepend=values.dtype.type(0))


def undelta(values: np.ndarray) -> np.ndarray:
    return np.cumsum(values, dtype=values.dtype)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values in sorted ``keys``."""
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return starts, np.append(starts[1:], len(keys))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions start, start + 1, … of each range, one range after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths - starts, lengths)
