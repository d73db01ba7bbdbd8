"""Spans: conversion, merging with messages, summaries, trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import fields
from tracelake.functions.tracectx import trace_ctx_of_message
from tracelake.operators import scan
from tracelake.plans.shared import staged


def spans_to_messages(spans: DataFrame) -> DataFrame:
    """Spans with attributes as messages."""
    a = lambda k: F.try_element_at("attributes", F.lit(k))
    plain = F.map_filter("attributes", lambda k, _: ~k.isin("net.peer.ip", "net.host.ip", "tracelake.transport", "tracelake.direction"))
    metadata = F.transform_keys(plain, lambda k, _: F.regexp_replace(k, r"^tracelake\.metadata\.", ""))
    ids = F.map_filter(F.create_map(F.lit("otel.trace_id"), F.col("trace_id"), F.lit("otel.span_id"), F.col("span_id"), F.lit("otel.parent_span_id"), F.col("parent_span_id")), lambda _, v: v.isNotNull())
    both = a("net.peer.ip").isNotNull() & a("net.host.ip").isNotNull()
    return spans.select(
        F.col("start_ns").alias("ts_ns"), F.when(both, a("net.peer.ip")).alias("src"), F.when(both, a("net.host.ip")).alias("dst"),
        F.coalesce(fields.transport_display(a("tracelake.transport")), F.lit("gRPC")).alias("transport"),
        F.when(F.col("kind").isin(2, 5), "inbound").when(F.col("kind").isin(3, 4), "outbound").otherwise("unknown").alias("direction"),
        F.encode("name", "UTF-8").alias("payload"), F.map_concat(F.map_filter(metadata, lambda k, _: ~k.startswith("otel.")), ids).alias("metadata"),
    )


def last_spans(spans: DataFrame) -> DataFrame:
    """One span per (trace, span): the last by start, then id."""
    w = Window.partitionBy("trace_id", "span_id").orderBy(F.desc("start_ns"), F.desc("id"))
    return spans.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def span_summary(spans: DataFrame) -> DataFrame:
    """service, operation and status of each span, with its duration."""
    status = F.when(F.col("status_code") == 1, "OK").when(F.col("status_code") == 2, "ERROR (2)").otherwise("UNKNOWN")
    return spans.select(
        "trace_id", "span_id", "service", F.coalesce("name", F.lit("unknown")).alias("operation"), status.alias("status"),
        F.call_function("div", F.col("end_ns") - F.col("start_ns"), F.lit(1000)).alias("duration_us"), "start_ns",
    )


def with_trace(messages: DataFrame) -> DataFrame:
    ctx = trace_ctx_of_message()
    return messages.withColumns({"trace_id": ctx["trace_id"], "span_id": ctx["span_id"]})


def merge_traces(messages: DataFrame, spans: DataFrame) -> DataFrame:
    """Messages with the summary of their span, and spans without any message; by time."""
    summary = span_summary(last_spans(spans))
    left = with_trace(messages).select(F.col("id").alias("event_id"), "ts_ns", "transport", "trace_id", "span_id")
    merged = left.join(summary, ["trace_id", "span_id"], "full_outer").withColumn("ts_ns", F.coalesce("ts_ns", "start_ns")).drop("start_ns")
    return merged.orderBy("ts_ns", F.col("event_id").asc_nulls_last(), "span_id")


def trace_tree(spans: DataFrame) -> DataFrame:
    """Spans with is_root: no parent, or one that isn't in the trace."""
    one = last_spans(spans)
    parents = one.select("trace_id", F.col("span_id").alias("parent_span_id"), F.lit(True).alias("_known"))
    return one.join(parents, ["trace_id", "parent_span_id"], "left").withColumn("is_root", F.col("_known").isNull()).drop("_known")


def trace_children(spans: DataFrame, trace_id: str, span_id: str) -> DataFrame:
    return spans.filter((F.col("trace_id") == trace_id) & (F.col("parent_span_id") == span_id))


def tour(spans: DataFrame) -> DataFrame:
    """The Euler tour of every trace: each span is entered and left (side 0 and 1), and knows the step before, to and to_side (null: none).

    Roots and children follow each other by start and id. nodes is the length of the trace's tour.
    """
    tree = trace_tree(spans.filter("trace_id is not null and span_id is not null"))
    of, order = ["trace_id", "up"], ["start_ns", "span_id"]
    parts = scan.dealt(tree.select("trace_id", "span_id", "start_ns", F.when(~F.col("is_root"), F.col("parent_span_id")).alias("up")), of, order)
    placed = scan.running(parts, of, order, elder=("last", F.col("span_id")))
    youngest = parts.filter("up is not null").groupBy("trace_id", F.col("up").alias("span_id")).agg(F.max(F.struct(*order))["span_id"].alias("child"))
    entered = placed.select("trace_id", "span_id", F.lit(0).alias("side"), F.coalesce("elder", "up").alias("to"), F.col("elder").isNotNull().cast("int").alias("to_side"))
    left = parts.join(youngest, ["trace_id", "span_id"], "left").select(
        "trace_id", "span_id", F.lit(1).alias("side"), F.coalesce("child", "span_id").alias("to"), F.col("child").isNotNull().cast("int").alias("to_side")
    )
    lengths = parts.groupBy("trace_id").agg((2 * F.count("*")).alias("nodes"))
    return entered.unionByName(left).join(lengths, "trace_id")


def trace_levels(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, level, ordinal): the depth of a span and its place, from 0, in the depth-first listing of its trace.

    Roots and children are listed by start, then id. Steps of the tour are ranked by pointer doubling: each knows the sums of what lies
    between it and an earlier step, and each round doubles that distance. A step takes the same space however deep its span
    is, no two steps point to the same one, so no key is hot, and a trace takes part in as many rounds as its length has bits.
    Spans of a cycle and those below it reach no root and are left out, as are spans without a trace or an id.
    """
    down = F.col("side") == 0
    front = staged(tour(spans).withColumns({"depth": F.when(down, 1).otherwise(-1).cast("long"), "entered": F.when(down, 1).otherwise(0).cast("long")}))
    ranked, reach = [], 1
    while True:
        earlier = front.select("trace_id", F.col("span_id").alias("to"), F.col("side").alias("to_side"), *(F.col(c).alias(f"_{c}") for c in ("to", "to_side", "depth", "entered")))
        moved = front.filter("to is not null").join(earlier, ["trace_id", "to", "to_side"]).select(
            "trace_id", "span_id", "side", F.col("_to").alias("to"), F.col("_to_side").alias("to_side"), "nodes", *((F.col(c) + F.col(f"_{c}")).alias(c) for c in ("depth", "entered"))
        )
        reach *= 2
        turned = staged(front.filter("to is null").unionByName(moved))
        ranked.append(turned.filter((F.col("nodes") <= reach) & F.col("to").isNull() & down))
        front = turned.filter(F.col("nodes") > reach)
        if front.isEmpty():
            break
    return reduce(DataFrame.unionByName, ranked).select("trace_id", "span_id", (F.col("depth") - 1).cast("int").alias("level"), (F.col("entered") - 1).alias("ordinal"))


def trace_summary(messages: DataFrame) -> DataFrame:
    """Per trace: events and duration in ms."""
    traced = with_trace(messages).filter("trace_id is not null")
    ms = F.call_function("div", F.max("ts_ns") - F.min("ts_ns"), F.lit(1_000_000))
    return traced.groupBy("trace_id").agg(F.count("*").alias("events"), ms.alias("duration_ms"))


def trace_listing(messages: DataFrame) -> DataFrame:
    """Messages of traces with their place in it, arrow, label, status and size."""
    w = Window.partitionBy("trace_id").orderBy("ts_ns", "id")
    arrow = F.when(F.col("direction") == "outbound", "→").when(F.col("direction") == "inbound", "←").otherwise("•")
    return with_trace(messages).filter("trace_id is not null").select(
        "trace_id", (F.row_number().over(w)).alias("n"), "id", "span_id", arrow.alias("arrow"), fields.method_label().alias("label"),
        fields.meta("grpc.status").alias("status"), fields.payload_size().alias("size"),
    )


def untraced(messages: DataFrame) -> DataFrame:
    return with_trace(messages).agg(F.count_if(F.col("trace_id").isNull()).alias("untraced"))


def spans_for_service(messages: DataFrame, spans: DataFrame, service: str) -> DataFrame:
    """Messages of all traces that a service takes part in."""
    traces = spans.filter(F.col("service") == service).select("trace_id").distinct()
    return with_trace(messages).join(traces, "trace_id", "left_semi")
