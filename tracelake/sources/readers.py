"""Readers: messages, fixture documents, spans, flat tables, packets; validation with rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import fields

EVENT = (
    "id BIGINT, timestamp BIGINT, source STRUCT<adapter: STRING, origin: STRING, network: STRUCT<src: STRING, dst: STRING>>, transport STRING, direction STRING, "
    "payload STRUCT<type: STRING, raw: STRING, fields: STRING, schema_name: STRING>, metadata MAP<STRING, STRING>, "
    "correlation_keys ARRAY<STRUCT<type: STRING, id: STRING, name: STRING, trace_id: STRING, span_id: STRING, key: STRING, value: STRING>>, sequence BIGINT, warnings ARRAY<STRING>"
)
FIXTURE = (
    "version BIGINT, description STRING, events ARRAY<STRUCT<timestamp_ns: BIGINT, transport: STRING, direction: STRING, payload_base64: STRING, payload_utf8: STRING, "
    "metadata: MAP<STRING, STRING>, source: STRUCT<src: STRING, dst: STRING>>>"
)
_KV = "ARRAY<STRUCT<key: STRING, value: STRUCT<stringValue: STRING, intValue: STRING, boolValue: BOOLEAN, doubleValue: DOUBLE>>>"
OTLP = (
    f"resourceSpans ARRAY<STRUCT<resource: STRUCT<attributes: {_KV}>, scopeSpans: ARRAY<STRUCT<scope: STRUCT<name: STRING, version: STRING>, spans: ARRAY<STRUCT<traceId: STRING, "
    f"spanId: STRING, parentSpanId: STRING, name: STRING, kind: INT, startTimeUnixNano: STRING, endTimeUnixNano: STRING, attributes: {_KV}, status: STRUCT<code: INT, message: STRING>>>>>>>"
)
NO_KEYS = "array<struct<type:string,id:string,name:string,trace_id:string,span_id:string,key:string,value:string>>"
DIRECTIONS = ("inbound", "outbound", "unknown")


def _empty(column: str, kind: str):
    return F.coalesce(F.col(column), F.expr(f"cast({kind}() as {'map<string,string>' if kind == 'map' else 'array<string>'})"))


def from_event_json(rows: DataFrame) -> DataFrame:
    """Rows of the event JSON as messages."""
    return rows.select(
        "id", F.col("timestamp").alias("ts_ns"), "source.adapter", "source.origin", "source.network.src", "source.network.dst",
        fields.transport_display(F.col("transport")).alias("transport"), "direction", F.col("payload.type").alias("payload_type"),
        F.unbase64("payload.raw").alias("payload"), "payload.fields", "payload.schema_name", _empty("metadata", "map").alias("metadata"),
        F.coalesce("correlation_keys", F.array().cast(NO_KEYS)).alias("correlation_keys"), "sequence", _empty("warnings", "array").alias("warnings"),
    )


def read_messages_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """One JSON event a line; blank lines are skipped, a bad line fails the query."""
    return from_event_json(spark.read.schema(EVENT).option("mode", "FAILFAST").json(path))


def read_messages_json(spark: SparkSession, path: str) -> DataFrame:
    """Documents that are an array of events or one event."""
    return from_event_json(spark.read.schema(EVENT).option("multiLine", True).option("mode", "FAILFAST").json(path))


def validate_messages(events: DataFrame, version: str = "version") -> tuple[DataFrame, DataFrame]:
    """(good, rejects with a reason) of exploded fixture events."""
    e = F.col("event")
    reason = (
        F.when(F.coalesce(F.col(version), F.lit(-1)) != 1, "unsupported version")
        .when(e["timestamp_ns"].isNull(), "missing timestamp")
        .when(fields.transport_display(e["transport"]).isNull(), "unknown transport")
        .when(~F.coalesce(e["direction"], F.lit("unknown")).isin(*DIRECTIONS), "unknown direction")
        .when(e["payload_base64"].isNotNull() & e["payload_utf8"].isNotNull(), "two payloads")
        .when(e["payload_base64"].isNull() & e["payload_utf8"].isNull(), "no payload")
        .when(e["payload_base64"].isNotNull() & F.try_to_binary(e["payload_base64"], F.lit("base64")).isNull(), "bad base64")
    )
    marked = events.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def fixture_events(docs: DataFrame, origin) -> DataFrame:
    """(version, origin, n, event): one row per event of fixture documents."""
    return docs.withColumn("_origin", origin).select("version", F.col("_origin").alias("origin"), F.posexplode("events").alias("n", "event"))


def read_fixture_docs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(messages, rejects) of versioned documents. Ids number the events of a document from 1."""
    docs = spark.read.schema(FIXTURE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    good, bad = validate_messages(fixture_events(docs, F.input_file_name()))
    e = F.col("event")
    wired = e["source"]["src"].isNotNull() & e["source"]["dst"].isNotNull()
    none = F.lit(None).cast("string")
    return good.select(
        (F.col("n") + 1).cast("long").alias("id"), e["timestamp_ns"].alias("ts_ns"), F.lit("json-fixture").alias("adapter"), "origin",
        F.when(wired, e["source"]["src"]).alias("src"), F.when(wired, e["source"]["dst"]).alias("dst"), fields.transport_display(e["transport"]).alias("transport"),
        F.coalesce(e["direction"], F.lit("unknown")).alias("direction"), F.lit("raw").alias("payload_type"),
        F.coalesce(F.unbase64(e["payload_base64"]), F.encode(e["payload_utf8"], "UTF-8")).alias("payload"), none.alias("fields"), none.alias("schema_name"),
        F.coalesce(e["metadata"], F.create_map().cast("map<string,string>")).alias("metadata"), F.array().cast(NO_KEYS).alias("correlation_keys"),
        F.lit(None).cast("long").alias("sequence"), F.array().cast("array<string>").alias("warnings"),
    ), bad


def _attributes(pairs) -> F.Column:
    """Key-value list as a map: text before integer before truth value before double; the last of equal keys."""
    value = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["boolValue"].cast("string"), v["doubleValue"].cast("string"))
    return F.map_from_entries(F.filter(F.transform(F.coalesce(pairs, F.array().cast(_KV.lower())), lambda p: F.struct(p["key"], value(p["value"]))), lambda p: p["key"].isNotNull()))


def otlp_spans(docs: DataFrame) -> DataFrame:
    """Nested trace documents as one row per span."""
    per = docs.select(F.explode("resourceSpans").alias("r")).select("r.resource", F.explode("r.scopeSpans").alias("s")).select("resource", F.explode("s.spans").alias("x"))
    service = F.try_element_at(_attributes(F.col("resource.attributes")), F.lit("service.name"))
    return per.select(
        F.coalesce(service, F.lit("unknown")).alias("service"), F.col("x.traceId").alias("trace_id"), F.col("x.spanId").alias("span_id"),
        F.nullif(F.col("x.parentSpanId"), F.lit("")).alias("parent_span_id"), "x.name", "x.kind", F.col("x.startTimeUnixNano").try_cast("long").alias("start_ns"),
        F.col("x.endTimeUnixNano").try_cast("long").alias("end_ns"), _attributes(F.col("x.attributes")).alias("attributes"),
        F.coalesce(F.col("x.status.code"), F.lit(0)).alias("status_code"), F.col("x.status.message").alias("status_message"),
    )


def read_otlp_spans(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """Spans of trace documents: one a file, or one a line as writers.write_otlp puts them."""
    return otlp_spans(spark.read.schema(OTLP).option("multiLine", not one_per_line).option("mode", "FAILFAST").json(path))


def read_flat_parquet(spark: SparkSession, path: str) -> DataFrame:
    """The flat table of writers.write_parquet, with its metadata as a map again."""
    flat = spark.read.parquet(path)
    return flat.withColumns({"metadata": F.from_json("metadata_json", "map<string,string>"), "warnings": F.from_json("warnings", "array<string>")})


def read_packets_table(spark: SparkSession, path: str) -> DataFrame:
    """(linktype, ts_us, data) packets."""
    return spark.read.parquet(path).select("linktype", "ts_us", "data")
