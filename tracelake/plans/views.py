"""Messages, packets and segments derived from the driver's tables.

The SQL text of a view is one string for both engines; only the placeholders differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.plans.shared import shared_dir

_MESSAGES = """
SELECT event_id AS id, us * 1000 AS ts_ns,
  CASE WHEN user_id % 2 = 0 THEN 'capture' ELSE 'fixture' END AS adapter,
  concat('node', CAST(user_id % 3 AS STRING)) AS origin,
  CASE WHEN k % 11 <> 0 THEN concat('10.0.0.', CAST(user_id % 250 AS STRING), ':', CAST(40000 + user_id AS STRING)) END AS src,
  CASE WHEN k % 11 <> 0 THEN concat('10.0.1.', CAST(user_id % 7 AS STRING), ':', CAST(CASE user_id % 5 WHEN 0 THEN 50051
         WHEN 1 THEN 5555 WHEN 2 THEN 7400 WHEN 3 THEN 443 ELSE 53 END AS STRING)) END AS dst,
  CASE user_id % 5 WHEN 0 THEN 'gRPC' WHEN 1 THEN 'ZMQ' WHEN 2 THEN 'DDS-RTPS' WHEN 3 THEN 'TCP' ELSE 'UDP' END AS transport,
  CASE event_type WHEN 'click' THEN 'outbound' WHEN 'purchase' THEN 'outbound' WHEN 'signup' THEN 'unknown' ELSE 'inbound' END AS direction,
  CASE WHEN user_id % 5 = 0 THEN 'decoded' ELSE 'raw' END AS payload_type,
  props AS payload_text,
  CASE WHEN user_id % 5 = 0 THEN 'demo.Message' END AS schema_name,
  CASE WHEN user_id % 5 = 0 AND k % 7 <> 0 THEN concat('/svc.S', CAST(k % 3 AS STRING), '/M', CAST(k % 5 AS STRING)) END AS grpc_method,
  CASE WHEN user_id % 5 = 0 THEN CAST(k % 4 * 2 + 1 AS STRING) END AS h2_stream,
  CASE WHEN user_id % 5 = 0 AND event_type = 'error' THEN CAST(k % 17 AS STRING)
       WHEN user_id % 5 = 0 AND event_type = 'view' THEN '0' END AS grpc_status,
  CASE WHEN user_id % 5 = 0 AND event_type = 'error' AND k % 2 = 0 THEN concat('failed ', CAST(k AS STRING)) END AS grpc_message,
  CASE WHEN user_id % 5 = 0 AND k % 3 = 0 THEN 'api.example' END AS grpc_authority,
  CASE user_id % 35 WHEN 1 THEN 'PUB' WHEN 6 THEN 'REQ' WHEN 11 THEN 'PUSH' WHEN 16 THEN 'DEALER' WHEN 21 THEN 'SUB' WHEN 26 THEN 'PULL' WHEN 31 THEN 'PAIR' END AS zmq_socket,
  CASE WHEN user_id % 35 IN (1, 21) AND k % 4 <> 0 THEN concat('t', CAST(k % 4 AS STRING)) END AS zmq_topic,
  CASE WHEN user_id % 5 = 2 THEN CAST(k % 3 AS STRING) END AS dds_domain,
  CASE WHEN user_id % 5 = 2 AND k % 5 <> 0 THEN concat('dt', CAST(k % 3 AS STRING)) END AS dds_topic,
  CASE WHEN user_id % 5 = 2 THEN concat('w', CAST(user_id % 7 AS STRING)) END AS dds_writer,
  CASE WHEN user_id % 5 = 2 AND k % 6 <> 0 THEN CAST(k AS BIGINT) END AS sequence,
  CASE WHEN user_id % 5 = 3 THEN CASE WHEN k % 9 = 0 THEN '503' WHEN k % 4 = 0 THEN '404' ELSE '200' END END AS http_status,
  CASE WHEN user_id % 5 IN (0, 3) AND k % 10 <> 0 THEN md5(concat(CAST(user_id AS STRING), ':', CAST({DAY} AS STRING))) END AS trace_id,
  CASE WHEN user_id % 5 IN (0, 3) AND k % 10 <> 0 THEN substring(md5(CAST(event_id AS STRING)), 1, 16) END AS span_id,
  CASE WHEN k % 13 = 0 THEN 'late' END AS warning, k, user_id
FROM (SELECT *, {US} AS us, {K} AS k FROM {events}) base
"""
_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"

#: ``m``: the scalar columns of messages, for DuckDB.
M = "m AS (" + _MESSAGES.format(US="epoch_us(ts)", K=_K, DAY="us // 86400000000", events="events").strip() + ")"

METADATA = {
    "grpc.method": "grpc_method", "h2.stream_id": "h2_stream", "grpc.status": "grpc_status", "grpc.message": "grpc_message", "grpc.authority": "grpc_authority",
    "zmq.socket_type": "zmq_socket", "zmq.topic": "zmq_topic", "dds.domain_id": "dds_domain", "dds.topic_name": "dds_topic", "dds.writer_guid": "dds_writer",
    "http.status": "http_status", "otel.trace_id": "trace_id", "otel.span_id": "span_id",
}


def scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalar columns of messages."""
    us = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))"
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(_MESSAGES.format(US=us, K=_K, DAY="us div 86400000000", events="{events}"), events=events)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with the full schema: metadata map, correlation keys, warnings, binary payload."""
    m = scalars(spark, sf_dir)
    pairs = [x for key, column in METADATA.items() for x in (F.lit(key), F.col(column))]
    keys = F.array(
        F.when(F.col("h2_stream").isNotNull(), _key("stream-id", id=F.col("h2_stream"))),
        F.when(F.col("zmq_topic").isNotNull(), _key("topic", name=F.col("zmq_topic"))),
        F.when(F.col("trace_id").isNotNull(), _key("trace-context", trace_id=F.col("trace_id"), span_id=F.col("span_id"))),
    )
    return m.select(
        "id", "ts_ns", "adapter", "origin", "src", "dst", "transport", "direction", "payload_type", F.encode("payload_text", "UTF-8").alias("payload"),
        F.when(F.col("payload_type") == "decoded", F.col("payload_text")).alias("fields"), "schema_name",
        F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()).alias("metadata"), F.filter(keys, lambda x: x.isNotNull()).alias("correlation_keys"),
        "sequence", F.when(F.col("warning").isNotNull(), F.array("warning")).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )


def _key(kind: str, **values) -> F.Column:
    names = ("id", "name", "trace_id", "span_id", "key", "value")
    return F.struct(F.lit(kind).alias("type"), *(values.get(n, F.lit(None).cast("string")).alias(n) for n in names))


#: Segments of a flow per order: 100 bytes at 100 * (line - 1), with repeats and gaps.
S = """s AS (SELECT l_orderkey AS flow, CAST(l_linenumber - 1 AS BIGINT) * 100 AS rel, l_linenumber AS line, CAST(l_partkey AS BIGINT) AS arrival FROM lineitem)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(flow, dir, epoch, rel, arrival, payload): one direction of one connection per order."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    letter = F.expr("char(64 + l_linenumber)")
    return lines.select(
        F.col("l_orderkey").alias("flow"), F.lit(0).alias("dir"), F.lit(0).alias("epoch"), ((F.col("l_linenumber") - 1).cast("long") * 100).alias("rel"),
        F.col("l_partkey").cast("long").alias("arrival"), F.encode(F.repeat(letter, F.lit(100)), "UTF-8").alias("payload"),
    )


def packets(spark: SparkSession, sf_dir: str, *kept: str) -> DataFrame:
    """(linktype, ts_us, data, id, *kept): an Ethernet frame for every message that has addresses, and columns of the message; TCP for gRPC, ZMQ and TCP, else UDP.

    A field holds the first hex digits of a number that is too long for it: four of a port (105536 is 19C40, so 0x19C4 = 6596), eight of a sequence number.
    """
    m = scalars(spark, sf_dir).filter("src is not null")
    hexed = lambda c, n: F.lpad(F.hex(c), n, "0")
    ip = lambda a: F.concat(*(hexed(F.split_part(F.split_part(a, F.lit(":"), F.lit(1)), F.lit("."), F.lit(k)).cast("long"), 2) for k in range(1, 5)))
    port = lambda a: hexed(F.split_part(a, F.lit(":"), F.lit(2)).cast("long"), 4)
    tcp = F.col("transport").isin("gRPC", "ZMQ", "TCP")
    src, dst, body = F.col("src"), F.col("dst"), F.hex("payload_text")
    size = F.octet_length("payload_text") + F.when(tcp, 40).otherwise(28)
    network = F.concat(F.lit("4500"), hexed(size.cast("long"), 4), F.lit("0000000040"), F.when(tcp, F.lit("06")).otherwise(F.lit("11")), F.lit("0000"), ip(src), ip(dst))
    segment = F.concat(port(src), port(dst), hexed((F.col("id") * 100).cast("long"), 8), F.lit("00000000"), F.lit("50"), hexed(F.col("k").cast("long") % 32, 2), F.lit("FFFF00000000"))
    datagram = F.concat(port(src), port(dst), hexed((F.octet_length("payload_text") + 8).cast("long"), 4), F.lit("0000"))
    frame = F.concat(F.lit("0200000000010200000000020800"), network, F.when(tcp, segment).otherwise(datagram), body)
    path = shared_dir(spark)  # a table, as packets come
    m.select(F.lit(1).alias("linktype"), F.expr("ts_ns div 1000").alias("ts_us"), F.unhex(frame).alias("data"), "id", *kept).write.parquet(path)
    return spark.read.parquet(path)


#: ``sp``: spans of the messages with a trace: parents are the row at half its place in the trace.
SP = """sn AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY ts_ns, id) AS n FROM m WHERE trace_id IS NOT NULL),
sp AS (SELECT a.trace_id, a.span_id, b.span_id AS parent_span_id, coalesce(a.grpc_method, 'unnamed') AS name, CASE a.direction WHEN 'outbound' THEN 3 WHEN 'inbound' THEN 2 ELSE 1 END AS kind,
  a.ts_ns AS start_ns, a.ts_ns + a.k * 1000000 AS end_ns, concat('svc', CAST(a.user_id % 4 AS STRING)) AS service,
  CASE WHEN a.grpc_status IS NULL THEN 0 WHEN a.grpc_status = '0' THEN 1 ELSE 2 END AS status_code, a.id AS id
  FROM sn a LEFT JOIN sn b ON a.trace_id = b.trace_id AND b.n = {HALF} AND b.n < a.n)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans derived from the messages (see SP)."""
    m = scalars(spark, sf_dir)
    text = SP.format(HALF="a.n div 2").replace("FROM m WHERE", "FROM {m} WHERE")
    return spark.sql(f"WITH {text} SELECT * FROM sp", m=m)


SP_DUCK = SP.format(HALF="a.n // 2")
