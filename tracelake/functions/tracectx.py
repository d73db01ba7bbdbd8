"""Trace context: header parsing, extraction, enrichment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions.fields import meta

_NONE = "struct<trace_id:string,span_id:string,sampled:boolean,tracestate:string>"


def _context(trace: Column, span: Column, sampled: Column, ok: Column, state: Column | None = None) -> Column:
    state = F.lit(None).cast("string") if state is None else state
    return F.when(F.coalesce(ok, F.lit(False)), F.struct(trace.alias("trace_id"), span.alias("span_id"), F.coalesce(sampled, F.lit(False)).alias("sampled"), state.alias("tracestate")))


def _not_zero(c: Column) -> Column:
    return ~F.rlike(c, F.lit("^0*$"))


def parse_traceparent(header: Column, state: Column | None = None) -> Column:
    """W3C: version 00, lower-case hex ids that aren't all zero, flags of two digits."""
    part = lambda k: F.regexp_extract(header, "^00-([0-9a-f]{32})-([0-9a-f]{16})-([0-9a-f]{2})$", k)
    sampled = F.conv(part(3), 16, 10).cast("int").bitwiseAND(F.lit(1)) == 1
    return _context(part(1), part(2), sampled, (part(1) != "") & _not_zero(part(1)) & _not_zero(part(2)), state)


def _b3_ids(trace: Column, span: Column) -> Column:
    return F.rlike(trace, F.lit("^([0-9A-Fa-f]{16}|[0-9A-Fa-f]{32})$")) & F.rlike(span, F.lit("^[0-9A-Fa-f]{16}$")) & _not_zero(trace) & _not_zero(span)


def parse_b3_single(header: Column) -> Column:
    """trace-span[-sampled[-parent]]; 16-digit trace ids are filled to 32."""
    parts = F.split(header, "-")
    at = lambda k: F.get(parts, F.lit(k))
    ok = F.size(parts).between(2, 4) & _b3_ids(at(0), at(1))
    return _context(F.lpad(F.lower(at(0)), 32, "0"), F.lower(at(1)), at(2).isin("1", "d"), ok)


def parse_b3_multi(headers: Column) -> Column:
    one = lambda a, b: F.coalesce(F.try_element_at(headers, F.lit(a)), F.try_element_at(headers, F.lit(b)))
    trace, span, sampled = one("x-b3-traceid", "X-B3-TraceId"), one("x-b3-spanid", "X-B3-SpanId"), one("x-b3-sampled", "X-B3-Sampled")
    return _context(F.lpad(F.lower(trace), 32, "0"), F.lower(span), sampled.isin("1", "d"), _b3_ids(trace, span))


def parse_uber_trace(header: Column) -> Column:
    """trace:span:parent:flags; flags is a decimal below 256 whose lowest bit is the sampling."""
    parts = F.split(header, ":")
    at = lambda k: F.get(parts, F.lit(k))
    flags = F.when(F.rlike(at(3), F.lit("^[0-9]+$")), at(3).try_cast("int"))
    hexed = F.rlike(at(0), F.lit("^[0-9A-Fa-f]{1,32}$")) & F.rlike(at(1), F.lit("^[0-9A-Fa-f]{1,16}$"))
    ok = (F.size(parts) == 4) & hexed & _not_zero(at(0)) & _not_zero(at(1)) & (flags < 256)
    return _context(F.lpad(F.lower(at(0)), 32, "0"), F.lpad(F.lower(at(1)), 16, "0"), flags.bitwiseAND(F.lit(1)) == 1, ok)


def extract_trace_context(headers: Column) -> Column:
    """The first that parses: traceparent, b3, x-b3-*, uber-trace-id."""
    h = lambda k: F.try_element_at(headers, F.lit(k))
    return F.coalesce(parse_traceparent(h("traceparent"), h("tracestate")), parse_b3_single(h("b3")), parse_b3_multi(headers), parse_uber_trace(h("uber-trace-id")))


def enrich_trace_metadata(df, headers: str):
    """Adds otel.* metadata and a trace correlation key from a column of header maps."""
    ctx = extract_trace_context(F.col(headers))
    new = F.create_map(F.lit("otel.trace_id"), ctx["trace_id"], F.lit("otel.span_id"), ctx["span_id"], F.lit("otel.trace_sampled"), ctx["sampled"].cast("string"))
    old = F.map_filter("metadata", lambda k, _: ~k.isin("otel.trace_id", "otel.span_id", "otel.trace_sampled"))
    none = F.lit(None).cast("string")
    key = F.struct(F.lit("trace-context").alias("type"), none.alias("id"), none.alias("name"), ctx["trace_id"].alias("trace_id"), ctx["span_id"].alias("span_id"), none.alias("key"), none.alias("value"))
    return df.withColumns({
        "metadata": F.when(ctx.isNotNull(), F.map_concat(old, new)).otherwise(F.col("metadata")),
        "correlation_keys": F.when(ctx.isNotNull(), F.array_append("correlation_keys", key)).otherwise(F.col("correlation_keys")),
    })


def trace_ctx_of_message() -> Column:
    """struct(trace_id, span_id, parent_span_id): the correlation key first, then metadata."""
    key = F.get(F.filter("correlation_keys", lambda k: k["type"] == "trace-context"), F.lit(0))
    trace, span = F.coalesce(key["trace_id"], meta("otel.trace_id")), F.coalesce(key["span_id"], meta("otel.span_id"))
    return F.when(trace.isNotNull() & span.isNotNull(), F.struct(trace.alias("trace_id"), span.alias("span_id"), meta("otel.parent_span_id").alias("parent_span_id")))
