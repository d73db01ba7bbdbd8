"""Ranks of rows by a least-significant-digit radix sort over the cluster.

A row's composite key is cut in digits of DIGIT_BITS. Each pass takes one digit, the least first: rows lie in
blocks of consecutive places, the rows of each (block, digit) are counted, prefix sums of the counts over
digits and then blocks give where each (block, digit) begins, and a row's new place is that plus its place
among the rows of its block with the same digit. The old places order those, so passes are stable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm import kit

DIGIT_BITS = 12
#: Places of a block: 2 ** BLOCK_BITS rows at most are sorted in one group.
BLOCK_BITS = 16


def digits_of(key: Column, bits: int = DIGIT_BITS) -> list[Column]:
    """The digits of a long key, least first; the sign bit is turned, so negative keys come before others."""
    turned = key.bitwiseXOR(F.lit(-(1 << 63)))
    return [F.shiftrightunsigned(turned, k).bitwiseAND(F.lit((1 << bits) - 1)).cast("int") for k in range(0, 64, bits)]


def counting_pass(rows: DataFrame, digit: Column, place: str) -> DataFrame:
    """rows with their places after a stable counting sort by digit; places become gapless from 0."""
    dealt = rows.withColumns({"_digit": digit, "_block": F.shiftright(place, BLOCK_BITS)})
    counts = dealt.groupBy("_digit", "_block").agg(F.count("*").alias("_n"))
    ahead = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row for each digit, at most 2 ** DIGIT_BITS
    totals = counts.groupBy("_digit").agg(F.sum("_n").alias("_n")).select("_digit", ahead(Window.orderBy("_digit")).alias("_below"))
    begin = counts.withColumn("_left", ahead(Window.partitionBy("_digit").orderBy("_block"))).join(F.broadcast(totals), "_digit")
    begin = begin.select("_digit", "_block", (F.col("_below") + F.col("_left")).alias("_begin"))
    within = F.row_number().over(Window.partitionBy("_block", "_digit").orderBy(place)) - 1
    ranked = dealt.withColumn("_within", within).join(begin, ["_block", "_digit"])
    return ranked.withColumn(place, F.col("_begin") + F.col("_within")).select(rows.columns)


def radix_ranks(rows: DataFrame, keys: list[Column], row: str, rank: str = "rank") -> DataFrame:
    """(row, rank): ranks from 1 by the long keys, the first the most significant, all ascending, nulls last.

    row names a unique non-negative long; equal keys are ranked by it, so every row has a rank of its own and
    reruns agree. Digits in which all rows agree need no pass. An empty table gives an empty result. Each pass
    is written in the shared folder: its rows are read twice, and a lost executor costs one pass.
    """
    named = {f"_key_{i}": k.cast("long") for i, k in enumerate(keys)}
    placed = kit.stage(rows.select(F.col(row).alias("_row"), F.col(row).alias("_place"), *(k.alias(n) for n, k in named.items())))
    passes = []
    for name in reversed(named):
        passes += [*digits_of(F.coalesce(name, F.lit(0))), F.col(name).isNull().cast("int")]
    ends = placed.agg(*(F.min(d) != F.max(d) for d in passes)).first()
    # without a digit that differs, a pass over a constant makes the places gapless
    for digit in [d for d, differ in zip(passes, ends, strict=True) if differ] or [F.lit(0)]:
        placed = kit.stage(counting_pass(placed, digit, "_place"))
    return placed.select(F.col("_row").alias(row), (F.col("_place") + 1).alias(rank))
