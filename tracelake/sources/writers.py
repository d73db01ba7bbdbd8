"""Export projections and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import fields
from tracelake.functions.tracectx import trace_ctx_of_message

#: Spans of one document at most.
SPANS_PER_DOCUMENT = 10_000


def flatten_messages(df: DataFrame) -> DataFrame:
    """The fixed 20 columns."""
    m = fields.meta
    filled = lambda c: F.when(F.size(c) > 0, F.to_json(c))
    return df.select(
        "id", F.col("ts_ns").alias("timestamp_nanos"), fields.iso_timestamp(F.col("ts_ns")).alias("timestamp_iso"), "adapter", "origin",
        F.col("src").alias("src_addr"), F.col("dst").alias("dst_addr"), "transport", "direction", "payload_type", fields.payload_size().alias("payload_size"),
        "schema_name", F.when(F.col("payload_type") == "decoded", F.col("fields")).alias("decoded_fields"), filled("metadata").alias("metadata"),
        m("grpc.method").alias("grpc_method"), m("grpc.status").alias("grpc_status"), m("zmq.topic").alias("zmq_topic"), m("dds.topic_name").alias("dds_topic_name"),
        "sequence", filled("warnings").alias("warnings"),
    )


def csv_rows(df: DataFrame) -> DataFrame:
    """The flat columns as text, absent values empty."""
    flat = flatten_messages(df)
    return flat.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in flat.columns))


def write_csv(df: DataFrame, path: str) -> None:
    csv_rows(df).write.option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def parquet_rows(df: DataFrame) -> DataFrame:
    return flatten_messages(df).withColumnRenamed("metadata", "metadata_json").withColumn("metadata_json", F.coalesce("metadata_json", F.lit("{}")))


def write_parquet(df: DataFrame, path: str, by_transport: bool = False) -> None:
    out = parquet_rows(df)
    (out.repartition("transport", F.spark_partition_id()).write.partitionBy("transport") if by_transport else out.write).parquet(path)


def event_json(df: DataFrame) -> DataFrame:
    """Messages in the nested shape of the event JSON; empty collections are left out."""
    wire = fields.lookup(fields.WIRE_NAMES, F.col("transport"))
    network = F.when(F.col("src").isNotNull() & F.col("dst").isNotNull(), F.struct("src", "dst"))
    some = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    return df.select(
        "id", F.col("ts_ns").alias("timestamp"), F.struct("adapter", "origin", network.alias("network")).alias("source"), wire.alias("transport"), "direction",
        F.struct(F.col("payload_type").alias("type"), F.base64("payload").alias("raw"), "fields", "schema_name").alias("payload"),
        some("metadata"), some("correlation_keys"), "sequence", some("warnings"),
    )


def write_messages_ndjson(df: DataFrame, path: str) -> None:
    event_json(df).write.json(path)


def save_filtered(df: DataFrame, condition: Column, path: str) -> None:
    write_messages_ndjson(df.filter(condition), path)


def messages_to_spans(df: DataFrame) -> DataFrame:
    """Messages as spans; ids are kept where known, else derived by md5 from connection, addresses or origin."""
    ctx = trace_ctx_of_message()
    connection = F.get(F.filter("correlation_keys", lambda k: k["type"] == "connection-id"), F.lit(0))["id"]
    pair = F.concat("src", F.lit("->"), "dst")
    status = fields.meta("grpc.status")
    warned = F.get("warnings", F.lit(0))
    attributes = F.map_concat(
        F.map_filter(
            F.create_map(
                F.lit("tracelake.transport"), F.col("transport"), F.lit("tracelake.direction"), F.col("direction"), F.lit("net.peer.ip"), F.col("src"), F.lit("net.host.ip"), F.col("dst"),
                F.lit("tracelake.adapter"), F.col("adapter"), F.lit("tracelake.origin"), F.col("origin"), F.lit("tracelake.event_id"), F.col("id").cast("string"),
                F.lit("tracelake.sequence"), F.col("sequence").cast("string"), F.lit("tracelake.warning"), F.array_join("warnings", "; "),
            ),
            lambda _, v: F.coalesce(v, F.lit("")) != "",
        ),
        F.transform_keys(F.map_filter("metadata", lambda k, _: ~k.startswith("otel.")), lambda k, _: F.concat(F.lit("tracelake.metadata."), k)),
    )
    return df.select(
        F.coalesce(ctx["trace_id"], F.md5(F.coalesce(connection, pair, "origin").cast("binary"))).alias("trace_id"),
        F.coalesce(ctx["span_id"], F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 16)).alias("span_id"),
        fields.meta("otel.parent_span_id").alias("parent_span_id"),
        F.coalesce(fields.meta("grpc.method"), F.concat_ws(" ", "transport", "direction")).alias("name"),
        F.when(F.col("direction") == "outbound", 3).when(F.col("direction") == "inbound", 2).otherwise(1).alias("kind"),
        F.col("ts_ns").alias("start_ns"), F.col("ts_ns").alias("end_ns"), attributes.alias("attributes"),
        F.when(status == "0", 1).when(status.isNotNull() | warned.isNotNull(), 2).otherwise(0).alias("status_code"),
        F.when(status != "0", F.concat(F.lit("gRPC status "), status)).when(status.isNull(), warned).alias("status_message"), "adapter", "origin",
    )


def otlp_documents(spans: DataFrame, per_document: int = SPANS_PER_DOCUMENT) -> DataFrame:
    """One row per resource and shard: a resource with many spans gives several documents of bounded size.

    The shard is a hash of the span's id, over as many shards as the resource's count asks for.
    """
    sizes = spans.groupBy("adapter", "origin").agg(F.ceil(F.count("*") / per_document).alias("shards"))
    sharded = spans.join(F.broadcast(sizes) if sizes.limit(100_001).count() <= 100_000 else sizes, ["adapter", "origin"])
    sharded = sharded.withColumn("shard", F.pmod(F.xxhash64("span_id"), F.col("shards")))
    text = lambda v: F.struct(F.lit(None).cast("string").alias("intValue"), v.alias("stringValue"))
    whole = lambda e: e["key"] == "tracelake.event_id"
    value = lambda e: F.struct(F.when(whole(e), e["value"]).alias("intValue"), F.when(~whole(e), e["value"]).alias("stringValue"))
    pairs = F.transform(F.map_entries("attributes"), lambda e: F.struct(e["key"].alias("key"), value(e).alias("value")))
    span = F.struct(
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.col("parent_span_id").alias("parentSpanId"), "name", "kind",
        F.col("start_ns").cast("string").alias("startTimeUnixNano"), F.col("end_ns").cast("string").alias("endTimeUnixNano"), pairs.alias("attributes"),
        F.struct(F.col("status_code").alias("code"), F.col("status_message").alias("message")).alias("status"),
    )
    grouped = sharded.groupBy("adapter", "origin", "shard").agg(F.sort_array(F.collect_list(F.struct("start_ns", "span_id", span.alias("span")))).alias("rows"))
    name = F.struct(F.lit("service.name").alias("key"), text(F.concat_ws("/", "adapter", "origin")).alias("value"))
    scope = F.struct(F.struct(F.lit("tracelake").alias("name")).alias("scope"), F.transform("rows", lambda r: r["span"]).alias("spans"))
    return grouped.select("adapter", "origin", "shard", F.array(F.struct(F.struct(F.array(name).alias("attributes")).alias("resource"), F.array(scope).alias("scopeSpans"))).alias("resourceSpans"))


def write_otlp(spans: DataFrame, path: str) -> None:
    otlp_documents(spans).select("resourceSpans").write.json(path)


def har_entries(df: DataFrame) -> DataFrame:
    """gRPC messages as HTTP-archive entries."""
    m = fields.meta
    status, text = fields.grpc_to_http(m("grpc.status"))
    header = lambda name, value: F.when(value.isNotNull(), F.struct(F.lit(name).alias("name"), value.alias("value")))
    listed = lambda *hs: F.filter(F.array(*hs), lambda h: h.isNotNull())
    url = F.concat(F.lit("https://"), F.coalesce(m("grpc.authority"), m("h2.authority"), "dst", F.lit("")), F.coalesce(m("grpc.method"), F.lit("POST")))
    kind = F.lit("application/grpc")
    return df.filter(F.col("transport") == "gRPC").select(
        "id", fields.iso_timestamp(F.col("ts_ns")).alias("startedDateTime"), url.alias("url"),
        listed(header("content-type", kind), header("grpc-encoding", m("grpc.encoding"))).alias("request_headers"),
        listed(header("content-type", kind), header("grpc-status", m("grpc.status")), header("grpc-message", m("grpc.message"))).alias("response_headers"),
        status.alias("status"), text.alias("status_text"), fields.payload_size().alias("body_size"), F.substring_index("dst", ":", 1).alias("server_ip"),
    )


def har_omitted(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.col("transport") != "gRPC").alias("omitted"))


def message_table(df: DataFrame) -> DataFrame:
    """The listing: time, transport, IN/OUT/?, source, first metadata pair by key."""
    first = F.array_min(F.map_keys("metadata"))
    pair = F.when(F.size("metadata") > 0, F.concat(first, F.lit("="), F.try_element_at("metadata", first))).otherwise("-")
    way = F.when(F.col("direction") == "inbound", "IN").when(F.col("direction") == "outbound", "OUT").otherwise("?")
    return df.select("id", fields.iso_timestamp(F.col("ts_ns")).alias("time"), "transport", way.alias("way"), F.coalesce("src", "origin").alias("source"), pair.alias("summary"))
