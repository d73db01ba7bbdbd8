"""Field resolution and scalar functions as column builders; names come from the messages schema."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Order of the transports, used to break ties, and the names that are read as each (fixed values).
TRANSPORTS = ("gRPC", "ZMQ", "DDS-RTPS", "TCP", "UDP", "JSON-Fixture")
ALIASES = {
    "grpc": "gRPC", "zmq": "ZMQ", "dds-rtps": "DDS-RTPS", "ddsrtps": "DDS-RTPS", "raw-tcp": "TCP", "rawtcp": "TCP", "tcp": "TCP",
    "raw-udp": "UDP", "rawudp": "UDP", "udp": "UDP", "json-fixture": "JSON-Fixture", "jsonfixture": "JSON-Fixture",
}
WIRE_NAMES = {"gRPC": "grpc", "ZMQ": "zmq", "DDS-RTPS": "dds-rtps", "TCP": "raw-tcp", "UDP": "raw-udp", "JSON-Fixture": "json-fixture"}
#: gRPC status names, and the HTTP status each one maps to where it isn't 500 (fixed values).
GRPC_STATUS = (
    "OK", "CANCELLED", "UNKNOWN", "INVALID_ARGUMENT", "DEADLINE_EXCEEDED", "NOT_FOUND", "ALREADY_EXISTS", "PERMISSION_DENIED", "RESOURCE_EXHAUSTED",
    "FAILED_PRECONDITION", "ABORTED", "OUT_OF_RANGE", "UNIMPLEMENTED", "INTERNAL", "UNAVAILABLE", "DATA_LOSS", "UNAUTHENTICATED",
)
GRPC_HTTP = {0: 200, 1: 499, 3: 400, 4: 504, 5: 404, 7: 403, 12: 501, 13: 500, 14: 503, 16: 401}
#: Codes with a name: TCP flags, TLS alerts and HTTP statuses of their registries (fixed values).
TCP_FLAGS = {1: "FIN", 2: "SYN", 4: "RST", 8: "PSH", 16: "ACK"}
TLS_ALERTS = {
    0: "close_notify", 10: "unexpected_message", 20: "bad_record_mac", 21: "decryption_failed", 22: "record_overflow", 30: "decompression_failure", 40: "handshake_failure",
    41: "no_certificate", 42: "bad_certificate", 43: "unsupported_certificate", 44: "certificate_revoked", 45: "certificate_expired", 46: "certificate_unknown",
    47: "illegal_parameter", 48: "unknown_ca", 49: "access_denied", 50: "decode_error", 51: "decrypt_error", 60: "export_restriction", 70: "protocol_version",
    71: "insufficient_security", 80: "internal_error", 86: "inappropriate_fallback", 90: "user_canceled", 100: "no_renegotiation", 109: "missing_extension",
    110: "unsupported_extension", 111: "certificate_unobtainable", 112: "unrecognized_name", 113: "bad_certificate_status_response", 114: "bad_certificate_hash_value",
    115: "unknown_psk_identity", 116: "certificate_required", 120: "no_application_protocol",
}
HTTP_STATUS = {
    200: "OK", 400: "Bad Request", 401: "Unauthorized", 403: "Forbidden", 404: "Not Found", 408: "Request Timeout", 429: "Too Many Requests",
    499: "Cancelled", 500: "Internal Server Error", 501: "Not Implemented", 502: "Bad Gateway", 503: "Service Unavailable", 504: "Gateway Timeout",
}
#: What a code means for whoever reads the capture, in our own words.
EXPLANATIONS = {
    "grpc": {
        1: "the caller gave the call up", 2: "the server failed without a status of its own", 3: "the request can never be right as it stands",
        4: "no answer came in the time the caller allowed", 5: "what was asked for isn't there", 6: "what was to be made is there already",
        7: "the caller is known but may not do this", 8: "a quota, memory or another supply is used up", 9: "the system isn't in the state the call needs",
        10: "another call got in the way; try the whole step again", 11: "the request reaches past the end", 12: "the server has no such method",
        13: "the server broke; see its log", 14: "the server can't be reached or is too busy; try again", 15: "data is lost or damaged beyond repair", 16: "the caller didn't show who it is",
    },
    "tcp": {
        1: "this side has sent all it has", 2: "a connection is asked for", 4: "the connection is broken off: no listener, a crash or a firewall",
        8: "hand the data on at once", 16: "data up to here has come",
    },
    "tls": {
        0: "the sender closes in good order", 10: "a message came that doesn't belong here", 20: "a record doesn't match its checksum", 21: "a record couldn't be decrypted",
        22: "a record is too long", 30: "a record couldn't be unpacked", 40: "the sides share no cipher or settings", 41: "no certificate was sent", 42: "the certificate is damaged",
        43: "the certificate is of a kind that isn't handled", 44: "the certificate was withdrawn by its issuer", 45: "the certificate is out of date", 46: "the certificate has some other fault",
        47: "a value of the handshake is out of bounds", 48: "the issuer of the certificate isn't trusted", 49: "the certificate is good, but access is refused", 50: "a message can't be read",
        51: "a signature or key check failed", 60: "the key breaks an export rule", 70: "the version of the protocol isn't spoken here", 71: "the ciphers on offer are too weak",
        80: "the sender failed for reasons of its own", 86: "a retry with an older version was caught", 90: "someone stopped the handshake", 100: "a second handshake is refused",
        109: "an extension that has to be there isn't", 110: "an extension came that wasn't asked for", 111: "the certificate couldn't be fetched", 112: "no host of that name lives here",
        113: "the proof of the certificate's status is bad", 114: "the hash of the certificate is another one", 115: "the shared key's name isn't known", 116: "a client certificate is wanted",
        120: "the sides share no protocol above TLS",
    },
    "http": {
        200: "all went well", 400: "the request isn't well formed", 401: "the client has to show who it is", 403: "the client may not have this", 404: "nothing is found under this address",
        408: "the client was too slow with its request", 429: "the client asks too often", 499: "the client went away before the answer", 500: "the server broke",
        501: "the server can't do this", 502: "the server behind the gateway gave a bad answer", 503: "the server is too busy or down", 504: "the server behind the gateway gave no answer in time",
    },
}
CLIENT_PORTS = (80, 443, 50051, 5555, 8080, 8443, 9090)


def lookup(values: dict, key: Column) -> Column:
    """A literal map's value for key, null if it has none."""
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in values.items()))[key]


def meta(key: str) -> Column:
    return F.try_element_at("metadata", F.lit(key))


def transport_display(name: Column) -> Column:
    """Any alias, in any case, as the displayed transport; null if unknown."""
    return lookup(ALIASES, F.lower(name))


def canonical_transport(name: str) -> str:
    return ALIASES.get(name.lower(), name)


def transport_order(transport: Column) -> Column:
    return lookup({t: i for i, t in enumerate(TRANSPORTS)}, transport)


def addr_ip(addr: Column) -> Column:
    """Address of ``ip:port`` or ``[ip6]:port``, null if it can't be read."""
    ip = F.regexp_extract(addr, r"^(?:\[([0-9A-Fa-f:.]+)\]|((?:[0-9]{1,3}\.){3}[0-9]{1,3})):[0-9]{1,5}$", 1)
    four = F.regexp_extract(addr, r"^((?:[0-9]{1,3}\.){3}[0-9]{1,3}):[0-9]{1,5}$", 1)
    octets = F.forall(F.split(four, r"\."), lambda x: F.coalesce(x.try_cast("int") <= 255, F.lit(False)))
    return F.when(_port(addr).isNotNull(), F.coalesce(F.nullif(ip, F.lit("")), F.when(octets, F.nullif(four, F.lit("")))))


def _port(addr: Column) -> Column:
    port = F.regexp_extract(addr, r":([0-9]{1,5})$", 1).try_cast("int")
    return F.when(port <= 65535, port)


def addr_port(addr: Column) -> Column:
    return F.when(addr_ip(addr).isNotNull(), _port(addr))


def protocol_port(protocol: str, side: str) -> Column:
    """Port of src or dst if the transport's name contains the protocol (tcp or udp)."""
    return F.when(F.contains(F.lower("transport"), F.lit(protocol)), addr_port(F.col(side)))


def payload_size() -> Column:
    return F.octet_length("payload").cast("long")


def iso_timestamp(ts_ns: Column) -> Column:
    """RFC 3339 in UTC with milliseconds, cut (not rounded), whatever the session's time zone."""
    ms = F.call_function("div", ts_ns, F.lit(1_000_000))
    seconds = F.timestamp_add("SECOND", F.call_function("div", ms, F.lit(1000)), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.concat(F.date_format(seconds, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"), F.lit("Z"))


def method_label(summary: Column | None = None) -> Column:
    names = [meta("grpc.method"), meta("zmq.topic"), meta("dds.topic_name")]
    return F.coalesce(*names, *([summary] if summary is not None else []))


def message_error_flags() -> tuple[Column, Column]:
    """(has errors, has warnings)."""
    bad = F.exists(
        F.map_entries("metadata"),
        lambda e: (F.contains(e["key"], F.lit("status")) & ~e["value"].isin("0", "OK")) | F.contains(e["key"], F.lit("error")),
    )
    return F.coalesce(bad, F.lit(False)), F.coalesce(F.size("warnings") > 0, F.lit(False))


def dds_domain_id(port: Column) -> Column:
    return F.when(port >= 7400, F.floor((port - 7400) / 250).cast("int"))


def rtps_time_to_ns(seconds: Column, fraction: Column) -> Column:
    return seconds.cast("long") * 1_000_000_000 + F.shiftright(fraction.cast("long") * 1_000_000_000, 32)


def infer_direction(src_port: Column) -> Column:
    return F.when(src_port.isin(*CLIENT_PORTS) | src_port.between(7400, 7500), "outbound").otherwise("inbound")


def grpc_status_name(code: Column) -> Column:
    return lookup({str(i): n for i, n in enumerate(GRPC_STATUS)}, code)


def grpc_to_http(code: Column) -> tuple[Column, Column]:
    """HTTP status and text of a gRPC status; none counts as 0, and codes without an HTTP form show their number."""
    status = F.when(code.isNull(), F.lit(200)).otherwise(F.coalesce(lookup({str(k): v for k, v in GRPC_HTTP.items()}, code), F.lit(500)))
    titled = {str(k): GRPC_STATUS[k].replace("_", " ").title() for k in (2, 13, *GRPC_HTTP) if k}
    text = F.when(F.coalesce(code, F.lit("0")) == "0", "OK").otherwise(F.coalesce(lookup(titled, code), F.concat(F.lit("gRPC status "), code)))
    return status, text


def codes(spark):
    """(domain, code, name, explanation): the dimension that explains status codes; code 0 of gRPC needs no explanation."""
    named = {"grpc": dict(enumerate(GRPC_STATUS)), "tcp": TCP_FLAGS, "tls": TLS_ALERTS, "http": HTTP_STATUS}
    return spark.createDataFrame([(d, c, n, EXPLANATIONS[d].get(c)) for d, t in named.items() for c, n in t.items()], "domain string, code int, name string, explanation string")


def explain_code(df, domain: str, code: str):
    """df with code_name and explanation: name and meaning of a code, null if there are none. The dimension has under 100 rows."""
    known = codes(df.sparkSession).filter(F.col("domain") == domain)
    named = known.select(F.col("code").cast("string").alias("_code"), F.lower(F.translate("name", "_", " ")).alias("code_name"), "explanation")
    return df.join(F.broadcast(named), F.col(code).cast("string") == F.col("_code"), "left").drop("_code")


def zigzag(n: Column) -> Column:
    return F.shiftrightunsigned(n, 1).bitwiseXOR(-(n.bitwiseAND(F.lit(1))))


def event_summary() -> Column:
    """One text per message, a line for each fact that it has."""
    line = lambda label, value: F.when(value.isNotNull(), F.concat(F.lit(label), value))
    own = lambda transport, *parts: [F.when(F.col("transport") == transport, p) for p in parts]
    text = F.col("payload").cast("string")
    decoded = F.col("payload_type") == "decoded"
    return F.concat_ws(
        "\n",
        F.concat(F.lit("[Event "), F.col("id").cast("string"), F.lit("]")),
        F.concat(F.lit("Transport: "), F.col("transport")), F.concat(F.lit("Direction: "), F.col("direction")),
        F.when(F.col("src").isNotNull(), F.concat(F.lit("From: "), F.col("src"), F.lit(" → To: "), F.col("dst"))),
        *own("gRPC", line("gRPC method: ", meta("grpc.method")), line("HTTP/2 stream ID: ", meta("h2.stream_id")), line("gRPC status: ", meta("grpc.status")), line("gRPC message: ", meta("grpc.message"))),
        *own("ZMQ", line("ZMQ topic: ", meta("zmq.topic")), line("ZMQ socket: ", meta("zmq.socket_type"))),
        *own("DDS-RTPS", line("DDS domain: ", meta("dds.domain_id")), line("DDS topic: ", meta("dds.topic_name"))),
        F.when(decoded, line("Schema: ", F.col("schema_name"))),
        F.when(decoded, F.when(F.length("fields") <= 500, line("Decoded fields: ", F.col("fields"))).otherwise(F.concat(line("Decoded fields (truncated): ", F.left("fields", F.lit(500))), F.lit("...")))),
        F.when(~decoded, F.concat(F.lit("Payload size: "), F.octet_length("payload").cast("string"), F.lit(" bytes"))),
        F.when(~decoded & F.is_valid_utf8(text), line("Payload (UTF-8): ", F.left(text, F.lit(200)))),
        F.when(F.size("warnings") > 0, F.concat(F.lit("[!] Warnings: "), F.array_join("warnings", "; "))),
    )


_ENVELOPE = {
    "id": lambda: F.col("id").cast("string"), "timestamp": lambda: F.col("ts_ns").cast("string"), "transport": lambda: F.col("transport"),
    "direction": lambda: F.col("direction"), "source.adapter": lambda: F.col("adapter"), "adapter": lambda: F.col("adapter"), "source.origin": lambda: F.col("origin"),
    "origin": lambda: F.col("origin"), "source.src": lambda: F.col("src"), "src": lambda: F.col("src"), "source.dst": lambda: F.col("dst"), "dst": lambda: F.col("dst"),
    "sequence": lambda: F.col("sequence").cast("string"), "frame.len": lambda: payload_size().cast("string"),
}


def resolve_field(name: str) -> Column:
    """A dotted name's value as text: envelope, then protocol fields, then metadata; null if absent.

    frame.len is the payload's size. Port fields of other transports fall through to metadata.
    """
    if name in _ENVELOPE:
        return _ENVELOPE[name]()
    for protocol in ("tcp", "udp"):
        if name in (f"{protocol}.port", f"{protocol}.srcport"):
            return F.coalesce(protocol_port(protocol, "src").cast("string"), meta(name))
        if name == f"{protocol}.dstport":
            return F.coalesce(protocol_port(protocol, "dst").cast("string"), meta(name))
    if name in ("ip.src", "ip.addr"):
        return F.coalesce(addr_ip(F.col("src")), meta(name))
    if name == "ip.dst":
        return F.coalesce(addr_ip(F.col("dst")), meta(name))
    return meta(name)
