"""Top-level fields of protobuf payloads, read for a whole batch of payloads at once in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tracelake.plans.ship import ship

#: Bytes looked at together, whatever the lengths of payloads; a key, a varint and a fixed word take less than AHEAD.
WINDOW, AHEAD = 1 << 20, 32
#: Bytes of a key or a size, and of a varint value, at most.
KEY_BYTES, VALUE_BYTES = 6, 10
VARINT, WORD8, SIZED, WORD4 = 0, 1, 2, 5

_FIELD = pa.struct([("number", pa.int64()), ("wire", pa.int32()), ("value", pa.int64()), ("size", pa.int64())])


def wire_fields(payload: str) -> Column:
    """array of (number, wire type, value, size); null where the payload is null or isn't well formed, empty where it is empty.

    value is set for varints (wire type 0) and fixed words (1, 5, little endian); size for
    length-delimited fields (2). Every byte is taken for the start of a field, which says where the next one would start; the starts
    that a payload's first byte leads to are found by doubling the distance, so the work grows with bytes times the
    logarithm of fields. Memory is bounded by WINDOW and by the batch.
    """
    ship(SparkSession.active())
    return F.arrow_udf(read_fields, "array<struct<number:bigint,wire:int,value:bigint,size:bigint>>")(F.col(payload))


def read_fields(payloads: pa.Array) -> pa.Array:
    payloads = payloads.cast(pa.large_binary())
    null = np.asarray(payloads.is_null())
    _, offsets, raw = payloads.buffers()
    edges = np.frombuffer(offsets, np.int64)[payloads.offset : payloads.offset + len(payloads) + 1] if len(payloads) else np.zeros(1, np.int64)
    data = np.frombuffer(raw, np.uint8)[edges[0] : edges[-1]] if raw is not None else np.zeros(0, np.uint8)
    edges = edges - edges[0]
    found, bad, carried = [], null.copy(), -1
    for base in range(0, len(data), WINDOW):
        end = min(base + WINDOW, len(data))
        first, last = np.searchsorted(edges, [base, end])
        entries = edges[first:last][edges[first:last] < edges[first + 1 : last + 1]]
        entries = np.concatenate([[carried], entries]) if base <= carried < end else entries
        if not len(entries):
            continue
        at, ok, fields, carried_on = _window(data, edges, base, end, entries)
        doc = np.searchsorted(edges, at, "right") - 1
        bad[doc[~ok]] = True
        found.append((doc[ok], *(f[ok] for f in fields)))
        carried = max(carried, carried_on)
    doc, number, wire, value, size = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 5
    good = ~bad[doc]
    doc, number, wire, value, size = (c[good] for c in (doc, number, wire, value, size))
    lists = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(payloads)))]).astype(np.int32)
    sized = wire == SIZED
    columns = [pa.array(number), pa.array(wire.astype(np.int32)), pa.array(value, mask=sized), pa.array(size, mask=~sized)]
    return pa.ListArray.from_arrays(pa.array(lists), pa.StructArray.from_arrays(columns, fields=list(_FIELD)), mask=pa.array(bad))


def _window(data: np.ndarray, edges: np.ndarray, base: int, end: int, entries: np.ndarray) -> tuple:
    """Starts of fields in data[base:end] that entries lead to, whether each is well formed, its columns, and the start beyond the window that the last one leads to (or -1)."""
    n = end - base
    seen = np.zeros(n + AHEAD, np.uint8)
    known = data[base : end + AHEAD]
    seen[: len(known)] = known
    place = np.arange(n)
    limit = edges[np.searchsorted(edges, base + place, "right")] - base
    stop = np.minimum.accumulate(np.where(seen < 128, np.arange(len(seen)), len(seen) + AHEAD)[::-1])[::-1]
    wire = seen[:n] & 7
    ok = (stop[:n] - place < KEY_BYTES) & (stop[:n] < limit)
    body = np.where(ok, stop[:n] + 1, 0)
    ok &= np.isin(wire, (VARINT, WORD8, SIZED, WORD4)) & (_varint(seen, place, np.where(ok, body - place, 0)) >> 3 > 0)
    size, after = np.zeros(n, np.int64), np.where(wire == WORD8, body + 8, body + 4)
    for kind, most in ((VARINT, VALUE_BYTES), (SIZED, KEY_BYTES)):
        own = np.flatnonzero(ok & (wire == kind))
        close = stop[body[own]]
        fits = (close - body[own] < most) & (close < limit[own])
        ok[own[~fits]] = False
        own, close = own[fits], close[fits]
        after[own] = close + 1
        if kind == SIZED:
            size[own] = _varint(seen, body[own], close - body[own] + 1)
            after[own] += size[own]
    ok &= after <= limit
    goes_on = ok & (after < limit)
    jump = np.where(goes_on & (after < n), after, place)
    marked = np.zeros(n, bool)
    marked[entries - base] = True
    while True:
        at = np.flatnonzero(marked)
        marked[jump[at]] = True
        if np.count_nonzero(marked) == len(at):
            break
        jump = jump[jump]
    value = np.zeros(len(at), np.int64)
    varint = np.flatnonzero(ok[at] & (wire[at] == VARINT))
    value[varint] = _varint(seen, body[at[varint]], after[at[varint]] - body[at[varint]])
    for kind, width in ((WORD8, 8), (WORD4, 4)):
        own = np.flatnonzero(ok[at] & (wire[at] == kind))
        for i in range(width):
            value[own] |= seen[body[at[own]] + i].astype(np.int64) << (8 * i)
    number = _varint(seen, at, np.where(ok[at], body[at] - at, 0)) >> 3
    beyond = at[goes_on[at] & (after[at] >= n)]
    return base + at, ok[at], (number, wire[at], value, size[at]), base + int(after[beyond[-1]]) if len(beyond) else -1


def _varint(seen: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Values of varints of the given lengths (0: the value 0)."""
    value = np.zeros(len(at), np.int64)
    for i in range(int(length.max(initial=0))):
        own = np.flatnonzero(length > i)
        value[own] |= (seen[at[own] + i] & 127).astype(np.int64) << (7 * i)
    return value
