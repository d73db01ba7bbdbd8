"""Protocol detection over (payload, protocol, src_port, dst_port) by columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.plans.registry import DETECTORS, Detector, register_detector

FIRST_BYTES = 256
#: Well-known ports (fixed values), and the HTTP/2 connection preface.
TCP_PORTS = {50051: "gRPC", 80: "HTTP/2", 8080: "HTTP/2", 443: "HTTP/2", 8443: "HTTP/2", 5555: "ZMTP", 5556: "ZMTP"}
PREFACE = b"PRI * HTTP/2.0\r\n\r\nSM\r\n\r\n"
LEAST = 0.5


def initial_bytes() -> Column:
    return F.substring("payload", 1, FIRST_BYTES)


def _byte(at: int) -> Column:
    """Byte at a 0-based place, null past the end."""
    part = F.substring("payload", at + 1, 1)
    return F.when(F.octet_length(part) == 1, F.conv(F.hex(part), 16, 10).cast("int"))


def _starts(data: bytes) -> Column:
    return F.startswith("payload", F.lit(data))


def _port_protocol(port: Column) -> Column:
    from itertools import chain

    tcp = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in TCP_PORTS.items()))[port]
    return F.when(F.col("protocol") == "tcp", tcp).when((F.col("protocol") == "udp") & port.between(7400, 7500), "RTPS")


def detect_port() -> Column:
    """Protocol by the destination's port, then the source's."""
    return F.coalesce(_port_protocol(F.col("dst_port")), _port_protocol(F.col("src_port")))


def over(transport: str) -> Column:
    return F.coalesce(F.col("protocol") == transport, F.lit(False))


def is_preface() -> Column:
    return _starts(PREFACE)


def is_zmtp() -> Column:
    return (_byte(0) == 0xFF) & (_byte(9) == 0x7F)


def is_rtps() -> Column:
    return _starts(b"RTPS")


def is_h2_frame() -> Column:
    """A nine-byte frame header of a known type; the three bytes of its length can't exceed what is allowed."""
    return (F.octet_length("payload") >= 9) & (_byte(3) <= 9)


def detect_magic() -> Column:
    """Protocol by an opening that is bound to its transport: preface and ZMTP greeting over TCP, RTPS over UDP."""
    return F.when(over("tcp") & is_preface(), "gRPC").when(over("tcp") & is_zmtp(), "ZMTP").when(over("udp") & is_rtps(), "RTPS")


def detect_h2_frame() -> Column:
    return over("tcp") & is_h2_frame()


def detect_common() -> Column:
    """HTTP/1 and TLS over TCP."""
    return F.when(over("tcp") & is_http1(), "HTTP/1").when(over("tcp") & is_tls(), "TLS")


def is_http1() -> Column:
    words = (b"GET ", b"POST ", b"PUT ", b"DELETE ", b"HEAD ", b"OPTIONS ", b"PATCH ", b"CONNECT ", b"TRACE ", b"HTTP/1.")
    out = F.lit(False)
    for w in words:
        out = out | _starts(w)
    return out


def is_tls() -> Column:
    """A handshake record of a known version."""
    return (_byte(0) == 0x16) & (_byte(1) == 0x03) & (_byte(2) <= 4)


def _port_rule(protocol: str):
    return lambda: detect_port() == protocol


_text = lambda at: _byte(at).cast("string")
register_detector(Detector("preface", is_preface, "gRPC", 0.95, lambda: F.lit("h2"), "tcp"))
register_detector(Detector("zmtp", is_zmtp, "ZMTP", 0.95, lambda: F.concat(F.lit("3."), F.coalesce(_text(10), F.lit("x"))), "tcp"))
register_detector(Detector("rtps", is_rtps, "RTPS", 0.99, lambda: F.concat(_text(4), F.lit("."), _text(5)), "udp"))
register_detector(Detector("h2-frame", is_h2_frame, "HTTP/2", 0.6, lambda: F.lit("h2"), "tcp"))
register_detector(Detector("http1", is_http1, "HTTP/1", 0.85, transport="tcp"))
register_detector(Detector("tls", is_tls, "TLS", 0.85, transport="tcp"))
for _name in ("gRPC", "HTTP/2", "ZMTP", "RTPS"):
    register_detector(Detector(f"port-{_name}", _port_rule(_name), _name, 0.5))


def detect_best(df: DataFrame) -> DataFrame:
    """df with detected, confidence, version: the surest detector, the first registered among equals; UNKNOWN below one half.

    df holds datagrams, or the heads of streams (packets.stream_heads) for one verdict a stream. Only the first FIRST_BYTES of the payload are looked at.
    """
    looked = df.withColumns({"_payload": F.col("payload"), "payload": initial_bytes()})
    none = F.lit(None).cast("string")
    rules = [
        F.when(d.condition() & (over(d.transport) if d.transport else F.lit(True)), F.struct(F.lit(float(d.confidence)).alias("confidence"), F.lit(-k).alias("order"), F.lit(d.protocol).alias("protocol"), (d.version() if d.version else none).alias("version")))
        for k, d in enumerate(DETECTORS.values())
    ]
    best = F.array_max(F.filter(F.array(*rules), lambda r: r.isNotNull() & (r["confidence"] >= LEAST)))
    out = looked.withColumn("_best", best).withColumns({
        "detected": F.coalesce(F.col("_best.protocol"), F.lit("UNKNOWN")), "confidence": F.coalesce(F.col("_best.confidence"), F.lit(0.0)), "version": F.col("_best.version"),
        "payload": F.col("_payload"),
    })
    return out.drop("_best", "_payload")


def detect_override(df: DataFrame, overrides: DataFrame) -> DataFrame:
    """detect_best, with a user's choices for streams (src_ip, src_port, dst_ip, dst_port, protocol, forced) first."""
    keys = ["src_ip", "src_port", "dst_ip", "dst_port", "protocol"]
    found = detect_best(df).join(overrides.dropDuplicates(keys), keys, "left")
    return found.withColumns({
        "confidence": F.when(F.col("forced").isNotNull(), 1.0).otherwise(F.col("confidence")), "detected": F.coalesce("forced", "detected"),
    }).drop("forced")


def detect_ordered() -> Column:
    """The first that holds, whatever the transport: ZMTP, RTPS, preface, frame with a zero reserved bit, ports; null if none."""
    ports = F.col("dst_port").isin(50051, 443, 8443, 9090) | F.col("src_port").isin(50051, 443, 8443, 9090)
    frame = is_h2_frame() & (_byte(5).bitwiseAND(F.lit(0x80)) == 0)
    some = F.octet_length("payload") > 0
    return F.when(some & is_zmtp(), "zmtp").when(some & is_rtps(), "rtps").when(some & (is_preface() | frame), "grpc").when(ports, "grpc")
