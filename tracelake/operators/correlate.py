"""Messages grouped into conversations with timing, error, state, kind and summary.

Every row gets its flow by one CASE expression, so all strategies share one shuffle by flow id; only
request-reply pairing goes along each connection first (see scan).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import fields
from tracelake.functions.fields import meta
from tracelake.operators import scan
from tracelake.plans.registry import CORRELATORS, Correlator, register_correlator

PAIRED = ("REQ", "REP", "DEALER", "ROUTER")
_BY_TIME = lambda: F.struct(F.lit(0).alias("none"), F.lit(0).cast("long").alias("seq"), "ts_ns", "id")
_BY_SEQUENCE = lambda: F.struct(F.col("sequence").isNull().cast("int").alias("none"), F.coalesce("sequence", F.lit(0)).cast("long").alias("seq"), "ts_ns", "id")


def _text(value: Column, missing: str) -> Column:
    return F.coalesce(value, F.lit(missing))


def connection(separator: str = "->") -> Column:
    return F.coalesce(F.concat("src", F.lit(separator), "dst"), F.col("origin"))


def grpc_key(canonical: bool = False) -> Column:
    """canonical puts the smaller address first, so both directions are one conversation."""
    src, dst = (F.least("src", "dst"), F.greatest("src", "dst")) if canonical else (F.col("src"), F.col("dst"))
    stream = _text(meta("h2.stream_id"), "?")
    return F.coalesce(F.concat(F.lit("grpc:"), src, F.lit("->"), dst, F.lit("/ s"), stream), F.concat(F.lit("grpc:unknown/s"), stream))


def pubsub_key() -> Column:
    return F.concat(F.lit("zmq:pubsub:"), _text(meta("zmq.topic"), "(no-topic)"))


def push_pull_key() -> Column:
    return F.coalesce(F.concat(F.lit("zmq:pushpull:"), "src", F.lit(":"), "dst"), F.concat(F.lit("zmq:pushpull:"), "origin"))


def zmq_other_key() -> Column:
    return F.concat(F.lit("zmq:unknown:"), connection())


def dds_key() -> Column:
    return F.concat(F.lit("dds:d"), _text(meta("dds.domain_id"), "?"), F.lit("/"), _text(meta("dds.topic_name"), "(unknown)"), F.lit(":w"), _text(meta("dds.writer_guid"), "?"))


def fallback_key() -> Column:
    return F.concat(F.col("transport"), F.lit(":"), connection())


def zmq_key() -> Column:
    socket = meta("zmq.socket_type")
    return (
        F.when(socket.isin("PUB", "SUB"), pubsub_key()).when(socket.isin("PUSH", "PULL"), push_pull_key())
        .when(socket.isin(*PAIRED), F.col("_pair")).otherwise(zmq_other_key())
    )


register_correlator(Correlator("gRPC", grpc_key, _BY_TIME, ("grpc.method", "grpc.authority", "grpc.status", "grpc.message")))
register_correlator(Correlator("ZMQ", zmq_key, _BY_TIME, ("zmq.topic", "zmq.socket_type")))
register_correlator(Correlator("DDS-RTPS", dds_key, _BY_SEQUENCE, ("dds.domain_id", "dds.topic_name", "dds.writer_guid")))


def pair_req_rep(df: DataFrame) -> DataFrame:
    """df of paired sockets with _pair: the pair's id, null for rows of no pair.

    Per connection by time: an outbound row starts a pair if the row before isn't outbound or if no
    inbound follows at all; an inbound row closes the pair of an outbound row just before it. Rows of
    unknown direction are looked past.
    """
    known = F.col("direction").isin("inbound", "outbound")
    out, inn = F.col("direction") == "outbound", F.col("direction") == "inbound"
    by, order = ["_conn"], ["ts_ns", "id"]
    df = df.withColumn("_conn", connection())
    seen = scan.running(scan.dealt(df.filter(known), by, order), by, order, _before=("last", F.col("direction")), _later=("-max", inn.cast("int")))
    after_out = F.col("_before").eqNullSafe(F.lit("outbound"))
    start = out & (~after_out | (F.coalesce("_later", F.lit(0)) == 0))
    marked = seen.withColumns({"_start": start.cast("int"), "_close": (inn & after_out).cast("int")})
    numbered = scan.running(marked, by, order, _started=("sum", F.col("_start"))).withColumn("_number", F.col("_started") + F.col("_start") - 1)
    paired = numbered.select(*df.columns, F.when((F.col("_start") == 1) | (F.col("_close") == 1), F.col("_number")).alias("pair_index"))
    named = paired.withColumn("_pair", F.when(F.col("pair_index").isNotNull(), F.concat("_conn", F.lit(":rr"), F.col("pair_index").cast("string"))))
    rest = df.filter(~F.coalesce(known, F.lit(False))).withColumns({"pair_index": F.lit(None).cast("long"), "_pair": F.lit(None).cast("string")})
    return named.unionByName(rest)


def assign_flows(df: DataFrame) -> DataFrame:
    """df with flow_id, flow_order and claimed (false: the fallback's)."""
    paired = (F.col("transport") == "ZMQ") & F.coalesce(meta("zmq.socket_type").isin(*PAIRED), F.lit(False))
    rows = df.filter(~paired).withColumns({"_conn": F.lit(None).cast("string"), "pair_index": F.lit(None).cast("long"), "_pair": F.lit(None).cast("string")})
    rows = rows.unionByName(pair_req_rep(df.filter(paired)))
    key, order = F.lit(None).cast("string"), _BY_TIME()
    for rule in CORRELATORS.values():
        key = F.when(F.col("transport") == rule.transport, rule.key()).otherwise(key)
        order = F.when(F.col("transport") == rule.transport, rule.order()).otherwise(order)
    return rows.withColumn("_key", key).select(
        *df.columns, F.coalesce("_key", fallback_key()).alias("flow_id"), order.alias("flow_order"), F.col("_key").isNotNull().alias("claimed")
    )


def conversation_events(flows: DataFrame) -> DataFrame:
    """(id, conversation_id): the bridge table."""
    return flows.select("id", F.col("flow_id").alias("conversation_id"))


def _first(value: Column) -> Column:
    return F.min(F.when(value.isNotNull(), F.struct(F.col("flow_order").alias("o"), value.alias("v"))))["v"]


def conversation_metrics() -> dict[str, Column]:
    """Aggregates of a flow: start, end, duration, time to first response, counts, bytes."""
    at = lambda d: F.min(F.when(F.col("direction") == d, F.struct(F.col("flow_order").alias("o"), F.col("ts_ns").alias("t"))))["t"]
    return {
        "start_ns": F.min("ts_ns"), "end_ns": F.max("ts_ns"), "duration_ns": F.max("ts_ns") - F.min("ts_ns"),
        "ttfr_ns": F.when(at("inbound").isNotNull() & at("outbound").isNotNull(), F.greatest(at("inbound") - at("outbound"), F.lit(0).cast("long"))),
        "request_count": F.count_if(F.col("direction") == "outbound"), "response_count": F.count_if(F.col("direction") == "inbound"),
        "total_bytes": F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).cast("long"),
    }


def conversation_error() -> tuple[Column, Column]:
    """(first error event's kind, code and message; missing sequence numbers) as aggregates."""
    status, none = meta("grpc.status"), F.lit(None).cast("string")
    grpc = F.struct(F.lit("grpc-status").alias("kind"), status.alias("code"), F.coalesce(meta("grpc.message"), F.concat(F.lit("gRPC error status "), status)).alias("message"))
    reset = F.struct(F.lit("rst-stream").alias("kind"), none.alias("code"), F.lit("HTTP/2 stream reset").alias("message"))
    error = F.when(status != "0", grpc).when(meta("h2.frame_type") == "RST_STREAM", reset)
    dds = F.when(F.col("transport") == "DDS-RTPS", F.col("sequence"))
    return _first(error), F.greatest(F.max(dds) - F.min(dds) + 1 - F.count_distinct(dds), F.lit(0))


def conversation_state(status: Column, requests: Column, responses: Column) -> Column:
    return (
        F.when(status != "0", "error").when((requests > 0) & (responses == 0), "timeout").when((requests == 0) & (responses > 0), "incomplete")
        .when(responses > 0, "complete").otherwise("active")
    )


def conversation_kind(transport: Column, socket: Column, requests: Column, responses: Column) -> Column:
    grpc = (
        F.when((requests == 1) & (responses > 1), "server-streaming").when((requests > 1) & (responses == 1), "client-streaming")
        .when((requests > 1) & (responses > 1), "bidirectional-streaming").otherwise("unary-rpc")
    )
    zmq = F.when(socket.isin("PUB", "SUB"), "pubsub-channel").when(socket.isin(*PAIRED), "request-reply").when(socket.isin("PUSH", "PULL"), "pipeline").otherwise("unknown")
    return F.when(transport == "gRPC", grpc).when(transport == "ZMQ", zmq).when(transport == "DDS-RTPS", "topic-exchange").when(transport == "TCP", "tcp-stream").otherwise("unknown")


def conversation_summary() -> Column:
    """One line, by the first of method, topic, DDS topic; else kind and state."""
    total = (F.col("request_count") + F.col("response_count")).cast("string")
    ms = F.call_function("div", F.col("duration_ns"), F.lit(1_000_000)).cast("string")
    seconds = F.format_string("%.1f", F.col("duration_ns") / 1e9)
    status = F.coalesce(fields.grpc_status_name(meta("grpc.status")), F.col("state"))
    dds = F.concat(F.lit("Topic="), meta("dds.topic_name"), F.lit(" domain="), _text(meta("dds.domain_id"), "?"), F.lit(" — "), total, F.lit(" samples"))
    return F.coalesce(
        F.concat(meta("grpc.method"), F.lit(" → "), status, F.lit(" ("), ms, F.lit("ms)")),
        F.concat(F.lit("PUB topic="), meta("zmq.topic"), F.lit(" — "), total, F.lit(" messages ("), seconds, F.lit("s)")), dds,
        F.concat("kind", F.lit(" conversation — "), "state", F.lit(" state")),
    )


def build_conversations(df: DataFrame) -> DataFrame:
    """Conversations of all messages: the registered strategies, then the fallback for rows none claimed.

    Event ids are not nested here; conversation_events is the bridge, so a busy flow stays one small row.
    """
    flows = assign_flows(df)
    keys = [k for rule in CORRELATORS.values() for k in rule.metadata]
    own = lambda k: F.coalesce(meta("grpc.authority"), meta("h2.authority")) if k == "grpc.authority" else meta(k)
    error, gaps = conversation_error()
    wired = F.concat("src", F.lit(" → "), "dst")
    grouped = flows.groupBy(F.col("flow_id").alias("conversation_id")).agg(
        F.min("transport").alias("protocol"), F.bool_and("claimed").alias("claimed"), F.count("*").alias("events"), F.min("id").alias("first_id"),
        *(c.alias(n) for n, c in conversation_metrics().items()), error.alias("first_error"), gaps.alias("gaps"),
        F.min(F.struct("flow_order", wired.alias("w")))["w"].alias("connection"), *(_first(F.when(F.col("claimed"), own(k))).alias(f"_{k}") for k in keys),
    )
    pairs = [x for k in keys for x in (F.lit(k), F.col(f"`_{k}`"))]
    grpc_wired = F.when((F.col("protocol") == "gRPC") & F.col("claimed"), F.col("connection"))
    shaped = grouped.withColumn("metadata", F.map_filter(F.create_map(*pairs, F.lit("connection"), grpc_wired), lambda _, v: v.isNotNull()))
    requests, responses = F.col("request_count"), F.col("response_count")
    shaped = shaped.withColumns({
        "kind": F.when(F.col("claimed"), conversation_kind(F.col("protocol"), meta("zmq.socket_type"), requests, responses)).otherwise("tcp-stream"),
        "state": F.when(F.col("claimed"), conversation_state(meta("grpc.status"), requests, responses)).otherwise("incomplete"),
    })
    none = F.lit(None).cast("string")
    named = lambda kind, text: F.struct(F.lit(kind).alias("kind"), none.alias("code"), text.alias("message"))
    error = (
        F.when(F.col("first_error").isNotNull(), F.col("first_error")).when(F.col("gaps") > 0, named("sequence-gap", F.concat(F.col("gaps").cast("string"), F.lit(" missing sequence numbers"))))
        .when((requests > 0) & (responses == 0), named("timeout", F.lit("No response received")))
    )
    summary = F.when(F.col("claimed"), conversation_summary()).otherwise(F.concat(F.lit("Fallback "), "protocol", F.lit(" conversation")))
    return shaped.select(
        "conversation_id", "kind", "protocol", "state", "events", "first_id", "start_ns", "end_ns", "duration_ns", "ttfr_ns", "request_count", "response_count", "total_bytes",
        error.alias("error"), "metadata", summary.alias("summary"),
    )


def conversation_for_event(conversations: DataFrame, bridge: DataFrame, event_id: int) -> DataFrame:
    one = bridge.filter(F.col("id") == event_id)
    return conversations.join(F.broadcast(one), "conversation_id", "left_semi")


def conversations_by_protocol(conversations: DataFrame, protocol: str) -> DataFrame:
    return conversations.filter(F.col("protocol") == fields.canonical_transport(protocol))


def conversations_by_time(conversations: DataFrame) -> DataFrame:
    return conversations.orderBy("start_ns", "conversation_id")


def sort_conversations(conversations: DataFrame, messages: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """By id, protocol, source, dest, requests, duration or status; addresses are the first event's."""
    names = {"id": "conversation_id", "requests": "request_count", "duration": "duration_ns"}
    if by in ("source", "dest"):
        ends = messages.select(F.col("id").alias("first_id"), F.coalesce("src" if by == "source" else "dst", F.lit("")).alias("_key"))
        rows = conversations.join(ends, "first_id", "left")
    else:
        order = {"active": 0, "complete": 1, "error": 2, "timeout": 3, "incomplete": 4}
        key = fields.lookup(order, F.col("state")) if by == "status" else fields.transport_order(F.col("protocol")) if by == "protocol" else F.col(names[by])
        rows = conversations.withColumn("_key", key)
    return rows.orderBy(F.col("_key").desc() if descending else F.col("_key").asc(), "conversation_id").drop("_key")


def conversations_of_filter(conversations: DataFrame, bridge: DataFrame, messages: DataFrame, condition: Column) -> DataFrame:
    """Conversations with at least one message that passes."""
    hit = messages.filter(condition).select("id")
    return conversations.join(bridge.join(hit, "id", "left_semi"), "conversation_id", "left_semi")


def waterfall(conversations: DataFrame, bridge: DataFrame, messages: DataFrame, condition: Column, by: str = "start", descending: bool = False) -> DataFrame:
    """Conversations of a filter with the whole range (min start, max end), sorted; absent starts last."""
    rows = conversations_of_filter(conversations, bridge, messages, condition)
    ends = rows.agg(F.min("start_ns").alias("range_start_ns"), F.max("end_ns").alias("range_end_ns"))
    key = {"start": "start_ns", "duration": "duration_ns", "status": "state"}[by]
    order = F.col(key).desc_nulls_first() if descending else F.col(key).asc_nulls_last()
    return rows.join(F.broadcast(ends)).orderBy(order, "conversation_id")


def follow_stream(messages: DataFrame, flows: DataFrame, conversation_id: str) -> DataFrame:
    """Messages of one conversation in order: arrow, addresses, offset from the first."""
    rows = flows.filter(F.col("flow_id") == conversation_id)
    first = F.first("ts_ns").over(Window.partitionBy("flow_id").orderBy("flow_order"))
    arrow = F.when(F.col("direction") == "outbound", "→").when(F.col("direction") == "inbound", "←").otherwise("•")
    label = F.coalesce(fields.method_label(), F.col("schema_name"), F.col("payload_type"))
    return rows.select("id", "flow_order", arrow.alias("arrow"), F.coalesce("src", "origin").alias("source"), "dst", (F.col("ts_ns") - first).alias("offset_ns"), label.alias("label")).orderBy("flow_order").drop("flow_order")


def latency_breakdown(conversations: DataFrame) -> DataFrame:
    """Shares of a conversation's time before and after its first response."""
    share = 100.0 * F.col("ttfr_ns") / F.nullif(F.col("duration_ns"), F.lit(0))
    return conversations.filter("ttfr_ns is not null").select("conversation_id", F.coalesce(share, F.lit(0.0)).alias("ttfr_percent"), (100.0 - F.coalesce(share, F.lit(0.0))).alias("response_percent"))
