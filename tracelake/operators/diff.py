"""Comparison of two captures, as-of joins, set differences."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import fields
from tracelake.functions.fields import meta
from tracelake.operators import scan
from tracelake.operators.aggregates import PERCENTS, aggregate_metrics
from tracelake.plans.ship import map_arrow

WINDOW_NS = 100_000_000


def _side(df: DataFrame, method: str) -> DataFrame:
    return df.filter("src is not null and dst is not null").select("src", "dst", "id", "ts_ns", meta(method).alias("method"))


def _runs(left: DataFrame, right: DataFrame, window_ns: int) -> DataFrame:
    """Both sides with run: rows of one pair of addresses whose neighbours in time are within the window.

    A match never leaves a run, so runs and not address pairs are the groups of the greedy step.
    """
    both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
    by, order = ["src", "dst"], ["ts_ns", "side", "id"]
    timed = scan.running(scan.dealt(both, by, order), by, order, _before=("last", F.col("ts_ns")))
    apart = F.coalesce((F.col("ts_ns") - F.col("_before") > window_ns).cast("int"), F.lit(0))
    runs = scan.running(timed, by, order, _earlier=("sum", apart))
    return runs.select(*both.columns, (F.col("_earlier") + apart).alias("run"))


def _greedy(left: list[tuple], right: list[tuple], window_ns: int) -> Iterator[tuple]:
    """(left id, right id, match) of one run; rows are (id, time, method)."""
    second = sorted(right, key=lambda r: (r[1], r[0]))
    times, free = [r[1] for r in second], [True] * len(second)
    for one, ts, method in sorted(left):
        near = [
            (abs(times[k] - ts), second[k][0], k) for k in range(bisect_left(times, ts - window_ns), bisect_right(times, ts + window_ns))
            if free[k] and (second[k][2] is None or method is None or second[k][2] == method)
        ]
        if near:
            _, other, k = min(near)
            free[k] = False
            yield one, other, "both"
        else:
            yield one, None, "first"
    yield from ((None, r[0], "second") for r, unused in zip(second, free, strict=True) if unused)


def _matched(window_ns: int):
    """Rows come sorted by run; one run is held at a time."""

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["left_id", "right_id", "match"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sides, out = None, ([], []), []
        for batch in batches:
            for *key, side, ident, ts, method in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != at:
                    out += _greedy(*sides, window_ns)
                    at, sides = key, ([], [])
                sides[side].append((ident, ts, method))
            if out:
                yield packed(out)
                out = []
        out += _greedy(*sides, window_ns)
        if out:
            yield packed(out)

    return run


def diff_events(first: DataFrame, second: DataFrame, method: str = "grpc.method", window_ns: int = WINDOW_NS) -> DataFrame:
    """(left_id, right_id, match): each event of the first capture, in order of id, takes the closest free event of the second (of equally close ones the smaller id).

    Equal src and dst, a method that is equal or absent on a side, and at most the window apart. Events
    without addresses match nothing and are left out. Ids are unique on each side. A task holds one run: events of an address pair without
    a silence of the window among them.
    """
    own = ["src", "dst", "run"]
    rows = _runs(_side(first, method), _side(second, method), window_ns).repartition(*own).sortWithinPartitions(*own)
    return map_arrow(rows.select(*own, "side", "id", "ts_ns", "method"), _matched(window_ns), "left_id long, right_id long, match string")


def diff_events_mutual(first: DataFrame, second: DataFrame, method: str = "grpc.method", window_ns: int = WINDOW_NS) -> DataFrame:
    """Pairs that are each other's closest, by columns only: time is cut in windows and neighbours looked up."""
    at = lambda c: F.call_function("div", F.col(c), F.lit(window_ns))
    a = _side(first, method).select("src", "dst", F.col("id").alias("left_id"), F.col("ts_ns").alias("a"), F.col("method").alias("ma"), F.explode(F.array(at("ts_ns") - 1, at("ts_ns"), at("ts_ns") + 1)).alias("slot"))
    b = _side(second, method).select("src", "dst", F.col("id").alias("right_id"), F.col("ts_ns").alias("b"), F.col("method").alias("mb"), at("ts_ns").alias("slot"))
    gap = F.abs(F.col("a") - F.col("b"))
    near = a.join(b, ["src", "dst", "slot"]).filter((gap <= window_ns) & (F.col("ma").isNull() | F.col("mb").isNull() | (F.col("ma") == F.col("mb")))).withColumn("gap", gap)
    best_a = F.row_number().over(Window.partitionBy("left_id").orderBy("gap", "right_id"))
    best_b = F.row_number().over(Window.partitionBy("right_id").orderBy("gap", "left_id"))
    return near.withColumns({"_a": best_a, "_b": best_b}).filter("_a = 1 and _b = 1").select("left_id", "right_id", "gap")


def diff_conversations(first: DataFrame, second: DataFrame) -> DataFrame:
    """Full outer on id: same, changed (state, or duration by over a tenth of the first's), first or second only."""
    side = lambda df, p: df.select("conversation_id", F.col("state").alias(f"{p}_state"), F.col("duration_ns").alias(f"{p}_duration_ns"))
    rows = side(first, "first").join(side(second, "second"), "conversation_id", "full_outer")
    a, b = F.col("first_duration_ns"), F.col("second_duration_ns")
    changed = (F.col("first_state") != F.col("second_state")) | (F.abs(a - b) > F.call_function("div", a, F.lit(10)))
    what = F.when(a.isNull(), "second").when(b.isNull(), "first").when(changed, "changed").otherwise("same")
    return rows.withColumn("change", what)


def _errors(df: DataFrame) -> DataFrame:
    return df.filter("state = 'error'").select("conversation_id").distinct()


def error_difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """Conversations that are errors in the first and not in the second."""
    return _errors(first).join(_errors(second), "conversation_id", "left_anti")


def regression_report(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: change of p50 and p95 in percent, of the error rate in points, new and fixed errors."""
    a, b = (aggregate_metrics(df).select(*(F.col(c).alias(f"{p}_{c}") for c in ("error_rate", *PERCENTS))) for df, p in ((first, "a"), (second, "b")))
    new, fixed = error_difference(second, first).agg(F.count("*").alias("new_errors")), error_difference(first, second).agg(F.count("*").alias("fixed_errors"))
    rows = a.join(F.broadcast(b)).join(F.broadcast(new)).join(F.broadcast(fixed))  # one row each
    change = lambda c: F.coalesce(100.0 * (F.col(f"b_{c}") - F.col(f"a_{c}")) / F.nullif(F.col(f"a_{c}"), F.lit(0)), F.lit(0.0))
    return rows.select(
        change("p50_ns").alias("p50_change"), change("p95_ns").alias("p95_change"), (100.0 * (F.col("b_error_rate") - F.col("a_error_rate"))).alias("error_points"), "new_errors", "fixed_errors"
    )


def dds_topic_asof(rows: DataFrame, announced: DataFrame) -> DataFrame:
    """rows (id, writer, ts_ns) with the topic last announced (writer, topic, ts_ns) before or at their time, and a warning where there is none."""
    both = rows.select("writer", "ts_ns", F.lit(None).cast("string").alias("topic"), "id", F.lit(1).alias("_side")).unionByName(
        announced.select("writer", "ts_ns", "topic", F.lit(None).cast("long").alias("id"), F.lit(0).alias("_side"))
    )
    by, order = ["writer"], ["ts_ns", "_side", "topic"]
    found = scan.running(scan.dealt(both, by, order), by, order, _topic=("last", F.col("topic"))).filter("_side = 1").drop("topic").withColumnRenamed("_topic", "topic")
    return found.select("id", "writer", "ts_ns", "topic", F.when(F.col("topic").isNull(), "no discovery for writer").alias("warning"))


def diff_fields(pairs: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Field by field comparison of pairs (left_id, right_id): same, changed, only left, only right."""

    def exploded(df: DataFrame, side: str) -> DataFrame:
        own = F.create_map(
            F.lit("direction"), F.col("direction"), F.lit("transport"), F.col("transport"), F.lit("time"), F.substring(fields.iso_timestamp(F.col("ts_ns")), 12, 12),
            F.lit("payload_type"), F.col("payload_type"), F.lit("size"), F.octet_length("payload").cast("string"), F.lit("schema"), F.col("schema_name"),
        )
        named = F.transform_keys("metadata", lambda k, _: F.concat(F.lit("metadata."), k))
        facts = F.map_filter(F.map_concat(own, named), lambda _, v: v.isNotNull())
        keyed = pairs.join(df.withColumnRenamed("id", f"{side}_id"), f"{side}_id")
        return keyed.select("left_id", "right_id", F.explode(facts).alias("field", f"{side}_value"))

    rows = exploded(first, "left").join(exploded(second, "right"), ["left_id", "right_id", "field"], "full_outer")
    a, b = F.col("left_value"), F.col("right_value")
    return rows.withColumn("change", F.when(b.isNull(), "only left").when(a.isNull(), "only right").when(a == b, "same").otherwise("changed"))
