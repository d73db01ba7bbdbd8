"""Shared helpers of the text operators: tables, staged results and numpy word arithmetic.

The numpy helpers work on slices of an Arrow text column: the UTF-8 bytes of several
documents in one array with their offsets. A slice holds about ``SLICE`` bytes, or one
document if that is longer, so memory follows the longest document and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.plans.shared import shared_dir

SLICE = 1 << 19
#: Bytes of a side that may be broadcast (values and ROW_BYTES for each row); larger sides are shuffled.
BROADCAST_BYTES, ROW_BYTES = 8 << 20, 16
#: The column of keyed().
ROW = "_row_key"

#: Bytes between words: space and 0x09 to 0x0D.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_R = 0x9E3779B97F4A7C15
_R_INVERSE = pow(_R, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: a cut lineage."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed(df: DataFrame) -> DataFrame:
    """df staged with a unique ROW for every row, the same each time it is read."""
    return stage(df.withColumn(ROW, F.monotonically_increasing_id()))


def sized(small: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """small with a hint to broadcast it if its values have at most limit bytes, else as it is.

    Its size is computed, so a costly one is to be staged before.
    """
    wide = {"string", "binary"}
    fixed = ROW_BYTES + 8 * sum(t not in wide for _, t in small.dtypes)
    size = sum((F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)) for c, t in small.dtypes if t in wide), F.lit(fixed))
    return F.broadcast(small) if (small.agg(F.sum(size.cast("long"))).first()[0] or 0) <= limit else small


def sized_join(big: DataFrame, small: DataFrame, on: str, how: str) -> DataFrame:
    """big joined with small, which is broadcast if it is small enough and shuffled else."""
    return big.join(sized(small), on, how)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns that an operator is about to add (its own replace equal names)."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


# --- numpy -------------------------------------------------------------------------------


def byte_slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """(first row, end row) of consecutive rows of a text or binary column with about limit bytes together."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(ends):
        before = int(ends[first - 1]) if first else 0
        end = max(first + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield first, end
        first = end


def text_slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive rows; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every maximal run of bytes that are no separators."""
    inside = ~separator[data]
    if not inside.any():
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    at = offsets[:-1]
    before[at[at < len(data)]] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    at = offsets[1:]
    after[at[at > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2**64; those for a slice are kept."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    made = []
    for base in (_R, _R_INVERSE):
        step = np.full(max(n, SLICE + 1), base, np.uint64)
        step[0] = 1
        made.append(np.cumprod(step, out=step))
    if n <= SLICE + 1:
        _powers[:] = made
    return made[0][:n], made[1][:n]


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[start:end] for all pairs at once, from one prefix sum."""
    power, inverse = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.multiply(values, power[:-1], out=sums[1:])
    np.cumsum(sums[1:], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    values = data.astype(np.uint64)
    values += np.uint64(1)
    return rolling(values, starts, ends)


def window_hashes(words: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and hash of every window of n words inside one document."""
    if len(words) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
    return first, rolling(words, first, first + n)
