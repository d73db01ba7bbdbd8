"""Importance resampling towards a target text distribution, drawn by a radix sort.

Features are runs of words hashed to buckets. Two passes over the texts: one counts features by bucket, the
other adds up the gains of a document's features from an array with one value for each bucket. The documents
with the highest noisy weights are found by their ranks in a distributed sort (radix.py).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import kit
from tracelake.llm.crc import crc32
from tracelake.llm.radix import radix_ranks
from tracelake.plans.ship import map_arrow

#: Bytes between words: all of ASCII but digits and small letters (texts are lower-cased before).
SEPARATOR = np.ones(256, bool)
SEPARATOR[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ranges one after the other with a space behind each: bytes, new starts and ends."""
    size = ends - starts + 1
    new = np.cumsum(size) - size
    at = np.repeat(starts - new, size) + np.arange(int(size.sum()))
    out = data[np.minimum(at, len(data) - 1)]
    out[new + size - 1] = 0x20
    return out, new, new + size - 1


def features(column: pa.Array, words: int, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, number of words of each row, bucket and row of every feature) of consecutive rows."""
    for first, end, data, offsets in kit.text_slices(column):
        data = kit.LOWER[data]
        starts, ends, doc = kit.spans(data, offsets, SEPARATOR)
        found = np.bincount(doc, minlength=end - first)
        if words > 1 and len(doc):
            data, starts, ends = _joined(data, starts, ends)
        bucket, of = [], []
        for n in range(1, words + 1):
            at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :]) if len(doc) >= n else np.zeros(0, np.int64)
            bucket.append(crc32(data, starts[at], ends[at + n - 1]).astype(np.int64) % buckets)
            of.append(doc[at])
        yield first, end, found, np.concatenate(bucket), np.concatenate(of)


def _counting(words: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for *_, bucket, _ in features(batch.column(0), words, buckets):
                total += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, words: int, buckets: int) -> np.ndarray:
    """Features of all rows of texts (one column) by bucket: an array of fixed size."""
    out = np.zeros(buckets, np.int64)
    for bucket, n in map_arrow(texts, _counting(words, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """scale times the log of the ratio of smoothed frequencies of every bucket, rounded down."""
    s_all, t_all, n = float(raw.sum()), float(target.sum()), float(len(raw))
    ratio = lambda s, t: (t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n))
    return np.array([math.floor(scale * math.log(ratio(float(s), float(t)))) for s, t in zip(raw, target, strict=True)], np.int64)


def noise(ident: int | None, seed: str, scale: int = 1000) -> int:
    """A standard Gumbel variable times scale, rounded down, the same for an id in every run; a null id counts as no text."""
    h = int(hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).hexdigest()[:8], 16)
    return math.floor(-scale * math.log(-math.log((h + 0.5) / 4294967296)))


def _scoring(gain: np.ndarray, words: int, seed: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, weight = (np.zeros(len(batch), np.int64) for _ in range(3))
            for first, end, found, bucket, of in features(batch.column(2), words, len(gain)):
                n_words[first:end] = found
                n_features[first:end] = np.bincount(of, minlength=end - first)
                np.add.at(weight[first:end], of, gain[bucket])
            score = weight + np.array([noise(i, seed) for i in batch.column(1).to_pylist()], np.int64)
            yield pa.record_batch([batch.column(0), batch.column(1), *map(pa.array, (n_words, n_features, weight, score))], ["_row", "ident", "n_words", "n_features", "weight", "score"])

    return run


def draw_towards(
    docs: DataFrame, target: DataFrame, text: str = "text", ident: str = "doc_id", target_text: str = "text",
    words: int = 1, buckets: int = 10_000, min_words: int = 20, percent: int = 10, seed: str = "2024",
) -> DataFrame:
    """(ident, n_features, weight, score, rank) of every row of docs; rank is null for those not drawn.

    Of the rows with at least min_words words, percent in a hundred (rounded down) with the highest scores are drawn;
    ties go to the smaller id, a null id last, and of rows equal in both the first as staged. Null and empty
    texts have no features and weight 0. An empty target leaves all buckets to the smoothing. Repeated rows are
    rows like others. Other columns are not looked at. An empty table gives an empty result.

    The driver holds one number for each bucket. Ids are whole numbers.
    """
    gain = gains(bucket_counts(docs.select(text), words, buckets), bucket_counts(target.select(target_text), words, buckets))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(ident).cast("long").alias("ident"), F.col(text).alias("text"))
    scored = kit.stage(map_arrow(rows, _scoring(gain, words, seed), "_row long, ident long, n_words long, n_features long, weight long, score long"))
    able = scored.filter(F.col("n_words") >= min_words)
    # scores are taken from the highest, so that few digits differ
    n, top = able.agg(F.count("*"), F.max("score")).first()
    ranks = radix_ranks(able, [F.lit(top) - F.col("score"), F.col("ident")], "_row").filter(F.col("rank") <= n * percent // 100)
    return scored.join(ranks, "_row", "left").select(F.col("ident").alias(ident), "n_features", "weight", "score", "rank")
