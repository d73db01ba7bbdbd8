"""Quality by importance resampling.

Two bags of hashed word n-grams are counted: one over the target texts (those labelled as of quality),
one over all texts. A text's log weight is the sum over its n-grams of the log ratio of the two
smoothed models; the k texts with the greatest log weight plus Gumbel noise are a sample without
replacement in proportion to the weights. The noise is a function of the id, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm import kit
from tracelake.plans.ship import map_arrow

#: Buckets of the n-gram models: a fixed number, whatever the corpus.
BUCKETS = 1 << 14
BINS = 4096

_BLANK = kit.SEPARATOR
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of every word, run of marks, and pair of neighbours among them."""
    data = kit.LOWER[data]
    words = kit.spans(data, offsets, _BLANK | _MARK)
    marks = kit.spans(data, offsets, ~_MARK)
    starts, ends = np.concatenate([words[0], marks[0]]), np.concatenate([words[1], marks[1]])
    order = np.argsort(starts, kind="stable")
    starts, ends, doc = starts[order], ends[order], np.concatenate([words[2], marks[2]])[order]
    single = kit.word_hashes(data, starts, ends)
    first, double = kit.window_hashes(single, doc, 2)
    both = np.concatenate([single, double])
    return (both & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate([doc, doc[first]])


def models(docs: DataFrame, text: str = "text", target: str = "target") -> DataFrame:
    """(bucket, aimed, every): n-grams of each bucket in the rows with target true, and in all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, aimed = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            chosen = np.array(batch.column("target").to_pylist(), bool)
            for i, _, data, offsets in kit.text_slices(batch.column("text")):
                bucket, doc = grams(data, offsets)
                every += np.bincount(bucket, minlength=BUCKETS)
                aimed += np.bincount(bucket[chosen[i + doc]], minlength=BUCKETS)
        at = np.flatnonzero(every)
        yield pa.record_batch([pa.array(at), pa.array(aimed[at]), pa.array(every[at])], ["bucket", "aimed", "every"])

    rows = docs.select(F.col(text).alias("text"), F.coalesce(F.col(target), F.lit(False)).alias("target"))
    return map_arrow(rows, run, "bucket long, aimed long, every long").groupBy("bucket").agg(F.sum("aimed").alias("aimed"), F.sum("every").alias("every"))


def log_weights(df: DataFrame, ratio: np.ndarray, text: str = "text") -> DataFrame:
    """df with n_grams and log_weight; null and empty texts have 0 of both."""
    df = kit.without(df, "n_grams", "log_weight")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in kit.text_slices(batch.column(text)):
                bucket, doc = grams(data, offsets)
                new = [pa.array(np.bincount(doc, minlength=j - i)), pa.array(np.bincount(doc, ratio[bucket], j - i).astype(float))]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, *new], [*batch.schema.names, "n_grams", "log_weight"])

    return map_arrow(df, run, df.selectExpr("*", "0L n_grams", "cast(0 as double) log_weight").schema)


def largest(df: DataFrame, key: str, k: int) -> tuple[float, int]:
    """The k-th largest value of key, and how many rows with exactly that value belong to the k largest.

    Counts the rows of BINS cells of a range in each pass and goes on inside the cell that holds the rank.
    """
    low, high = df.agg(F.min(key), F.max(key)).first()
    need = k
    while low < high:
        width = (high - low) / BINS
        cell = F.least(F.lit(BINS - 1), F.floor((F.col(key) - F.lit(low)) / F.lit(width)))
        inside = df.filter((F.col(key) >= F.lit(low)) & (F.col(key) <= F.lit(high))) if width > 0 else df.filter(F.col(key).between(low, high))
        counted = inside.groupBy((cell if width > 0 else F.col(key)).alias("cell")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).orderBy(F.desc("cell")).collect()
        for row in counted:
            if row["n"] >= need:
                low, high = row["low"], row["high"]
                break
            need -= row["n"]
    return low, need


def gumbel(ident: Column, seed: int) -> Column:
    """Standard Gumbel noise of the id: never infinite, the same in every run."""
    uniform = (F.conv(F.substring(F.md5(F.concat(F.coalesce(ident.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def resample(docs: DataFrame, targets: DataFrame, share: float | None = None, seed: int = 1, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(ident, n_grams, log_weight, sample_key, kept) of every row.

    targets has the ids and a boolean ``target`` for the labelled ones; a share of all rows is kept, by
    default the labelled rows' share of targets. Of equal keys the smaller ids are kept. Rows that
    repeat share a key, so more than the share may be kept of them. Without labels all rows are kept.
    Null ids share their noise; an empty table gives an empty result.
    """
    marked = targets.select(F.col(ident).alias("_id"), F.col("target").cast("boolean").alias("target")).filter("_id is not null and target is not null")
    marked = marked.groupBy("_id").agg(F.max("target").alias("target"))
    n, hits = marked.agg(F.count("*"), F.coalesce(F.sum(F.col("target").cast("int")), F.lit(0))).first()
    share = (hits / n if n else 1.0) if share is None else share
    rows = docs.select(F.col(ident).alias("_id"), F.col(text).alias("text"))
    counted = models(kit.sized_join(rows, marked.filter("target"), "_id", "left")).collect()  # at most BUCKETS rows
    aimed, every = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counted:
        aimed[r["bucket"]], every[r["bucket"]] = r["aimed"], r["every"]
    ratio = np.log((aimed + 1) / (aimed.sum() + BUCKETS)) - np.log((every + 1) / (every.sum() + BUCKETS)) if hits else np.zeros(BUCKETS)
    scored = log_weights(rows, ratio).select("_id", "n_grams", "log_weight")
    scored = kit.stage(scored.withColumn("sample_key", F.col("log_weight") + gumbel(F.col("_id"), seed)))
    total = scored.count()
    k = round(share * total)
    if not 0 < k < total:
        kept = F.lit(k > 0)
    else:
        edge, ties = largest(scored, "sample_key", k)
        same = scored.filter(F.col("sample_key") == F.lit(edge)).select((-F.coalesce(F.col("_id"), F.lit(0))).cast("double").alias("back"))
        last = -largest(same, "back", ties)[0]
        kept = (F.col("sample_key") > F.lit(edge)) | (F.col("sample_key") == F.lit(edge)) & (F.coalesce(F.col("_id"), F.lit(0)) <= F.lit(last))
    return scored.select(F.col("_id").alias(ident), "n_grams", "log_weight", "sample_key", kept.alias("kept"))
