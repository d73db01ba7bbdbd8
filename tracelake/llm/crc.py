"""CRC-32 of many byte ranges at once, in numpy."""

from __future__ import annotations

import zlib

import numpy as np

#: Ranges longer than this go one by one, so that one long range does not hold up a loop over byte places.
LONG = 64


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_TABLE = _table()


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """Unsigned CRC-32 of data[start:end] for all pairs; before: the CRC of what precedes each range, as in zlib."""
    size = ends - starts
    out = np.zeros(len(size), np.uint32) if before is None else before.astype(np.uint32)
    order = np.argsort(-size, kind="stable")
    far = int(np.searchsorted(-size[order], -LONG))
    for i in order[:far].tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(out[i]))
    order = order[far:]
    if len(order):
        at, left = starts[order], -size[order]
        state = ~out[order]
        for k in range(int(-left[0])):
            n = int(np.searchsorted(left, -k))  # ranges with a byte at place k come first
            state[:n] = _TABLE[(state[:n] ^ data[at[:n] + k]) & 255] ^ (state[:n] >> np.uint32(8))
        out[order] = ~state
    return out
