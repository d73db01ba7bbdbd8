"""Filters as columns of two-valued logic: a leaf whose field is absent is false, for every operator.

Leaves are ``Leaf`` columns. As conjuncts they stay plain comparisons, which drop nulls themselves and
reach the scan; under ``either`` or ``negate`` they are made false where null.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import fields

EPSILON = 2.220446049250313e-16
_OPS: dict[str, Callable] = {"==": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}


def _two(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _number(op: str, value: Column, literal: float) -> Column:
    number = value.try_cast("double")
    if op in ("==", "!="):
        same = F.abs(number - F.lit(float(literal))) < EPSILON
        return same if op == "==" else ~same
    return _OPS[op](number, F.lit(float(literal)))


def compare(value: Column, op: str, literal: object) -> Column:
    """Text, number or truth value against a resolved text."""
    if isinstance(literal, bool):
        truth = F.when(value == "true", F.lit(True)).when(value == "false", F.lit(False))
        return _OPS[op](truth, F.lit(literal)) if op in ("==", "!=") else F.lit(False)
    if isinstance(literal, (int, float)):
        return _number(op, value, literal)
    return _OPS[op](value, F.lit(literal))


def cmp(name: str, op: str, literal: object) -> Column:
    """A field against a literal; ports and ip.addr hold if either side does, transports take aliases."""
    if name in ("tcp.port", "udp.port"):
        return port_either(name.split(".")[0], op, literal)
    if name == "ip.addr":
        return ip_either(op, literal)
    if name == "transport" and isinstance(literal, str):
        literal = fields.canonical_transport(literal)
    return compare(fields.resolve_field(name), op, literal)


def port_either(protocol: str, op: str, literal: object) -> Column:
    """Numbers only. Rows of other transports are looked up in metadata."""
    if isinstance(literal, (str, bool)):
        return F.lit(False)
    sides = [_two(_number(op, fields.protocol_port(protocol, s).cast("string"), literal)) for s in ("src", "dst")]
    other = F.coalesce(fields.protocol_port(protocol, "src"), fields.protocol_port(protocol, "dst")).isNull()
    return sides[0] | sides[1] | _two(other & _number(op, fields.meta(f"{protocol}.port"), literal))


def ip_either(op: str, literal: object) -> Column:
    if not isinstance(literal, str):
        return F.lit(False)
    sides = [_two(_OPS[op](fields.addr_ip(F.col(s)), F.lit(literal))) for s in ("src", "dst")]
    return sides[0] | sides[1]


def contains_ci(name: str, literal: str) -> Column:
    return F.contains(F.lower(fields.resolve_field(name)), F.lit(literal.lower()))


def matches(name: str, pattern: str) -> Column:
    """Regular expression search; a pattern that doesn't compile matches nothing."""
    try:
        re.compile(pattern)
    except re.error:
        return F.lit(False)
    return fields.resolve_field(name).rlike(pattern)


def in_set(name: str, values: Iterable[object]) -> Column:
    values = list(values)
    if values and all(isinstance(v, str) for v in values) and name not in ("ip.addr", "transport"):
        return fields.resolve_field(name).isin(*values)
    return either(*(cmp(name, "==", v) for v in values))


def exists_field(name: str) -> Column:
    """warnings: any; network fields and sequence: set; otherwise a metadata key, even an empty one."""
    if name == "warnings":
        return F.size("warnings") > 0
    if name in ("source.network", "network"):
        return F.col("src").isNotNull()
    if name == "sequence":
        return F.col("sequence").isNotNull()
    return F.map_contains_key("metadata", name)


def slice_exists(name: str, start: int, end: int) -> Column:
    return F.octet_length(fields.resolve_field(name)) >= end


def fn_exists(function: str, *names: str) -> Column:
    return exists_field(names[0]) if function in ("len", "lower", "upper") and len(names) == 1 else F.lit(False)


def fn_compare(function: str, name: str, op: str, literal: object) -> Column:
    """len, lower or upper of a field against a literal."""
    value = fields.resolve_field(name)
    return compare({"len": F.octet_length(value).cast("string"), "lower": F.lower(value), "upper": F.upper(value)}[function], op, literal)


def slice_compare(name: str, start: int, end: int, op: str, literal: str) -> Column:
    """Characters start to end of a field that has as many, against a text."""
    value = fields.resolve_field(name)
    return F.when(F.octet_length(value) >= end, _OPS[op](F.substring(value, start + 1, end - start), F.lit(literal)))


def both(*terms: Column) -> Column:
    out = F.lit(True)
    for t in terms:
        out = out & t
    return out


def either(*terms: Column) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | _two(t)
    return out


def negate(term: Column) -> Column:
    return ~_two(term)


def keep(df: DataFrame, *terms: Column) -> DataFrame:
    """Rows for which all terms hold; all rows without terms."""
    for t in terms:
        df = df.filter(t)
    return df


def filter_transport(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col("transport") == fields.canonical_transport(name))


def filter_trace(df: DataFrame, trace_id: str) -> DataFrame:
    return df.filter(fields.meta("otel.trace_id") == trace_id)


def filter_span(df: DataFrame, span_id: str) -> DataFrame:
    return df.filter(fields.meta("otel.span_id") == span_id)


def filter_simple_export(name: str, op: str, literal: str) -> Column:
    """The export's filter: absent fields pass !=."""
    same = F.coalesce(fields.resolve_field(name) == literal, F.lit(False))
    return same if op == "==" else ~same


def payload_text() -> Column:
    return F.col("payload").cast("string")


#: Named filters. Their ports, sizes and openings are fixed values: saved filters refer to them by what they select.
TEMPLATES: dict[str, Callable[[], Column]] = {
    "dns": lambda: either(port_either("udp", "==", 53), port_either("tcp", "==", 53)),
    "tls_handshakes": lambda: both(port_either("tcp", "==", 443), F.hex(F.substring("payload", 1, 2)) == "1603"),
    "https": lambda: either(port_either("tcp", "==", 443), port_either("tcp", "==", 8443)),
    "grpc": lambda: cmp("transport", "==", "grpc"),
    "zeromq": lambda: cmp("transport", "==", "zmq"),
    "http_requests": lambda: both(either(port_either("tcp", "==", 80), port_either("tcp", "==", 8080)), payload_text().rlike("^(GET|POST|PUT|DELETE)")),
    "large_frames": lambda: cmp("frame.len", ">", 1500),
    "small_frames": lambda: cmp("frame.len", "<", 64),
    "cleartext": lambda: either(*(port_either("tcp", "==", p) for p in (80, 21, 23, 25)), port_either("udp", "==", 69)),
    "localhost": lambda: either(cmp("ip.src", "==", "127.0.0.1"), cmp("ip.dst", "==", "127.0.0.1")),
}


def filter_like_event(df: DataFrame, event_id: int, what: str) -> DataFrame:
    """Messages with the same src, dst, transport or both addresses (either way) as one message."""
    one = df.filter(F.col("id") == event_id).limit(1)
    if what == "conversation":
        pair = lambda a, b: F.array_sort(F.array(a, b))
        return df.join(F.broadcast(one.select(pair("src", "dst").alias("_pair"))), pair("src", "dst") == F.col("_pair"), "left_semi")
    return df.join(F.broadcast(one.select(F.col(what).alias("_same"))), F.col(what) == F.col("_same"), "left_semi")


def filter_time_bucket(df: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    return df.filter((F.col("ts_ns") >= start_ns) & (F.col("ts_ns") < end_ns))


def first_in_bucket(df: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    return filter_time_bucket(df, start_ns, end_ns).agg(F.min_by("id", F.struct("ts_ns", "id")).alias("id"), F.min("ts_ns").alias("ts_ns"))


def anomaly() -> Column:
    return (F.col("transport") == "gRPC") & (fields.meta("grpc.status") != "0")


def protocol_error() -> Column:
    return either(fields.meta("grpc.status") != "0", fields.meta("http.status").try_cast("int") >= 400)


def search_text(text: str) -> Column:
    summary = F.coalesce(fields.meta("grpc.method"), F.concat(F.lit("Topic: "), F.coalesce(fields.meta("zmq.topic"), fields.meta("dds.topic_name"))), F.col("schema_name"))
    parts = F.concat_ws(" ", F.col("id").cast("string"), "transport", "direction", "adapter", "origin", "src", "dst", summary, F.to_json("metadata"))
    return F.contains(F.lower(parts), F.lit(text.lower()))


def payload_search(df: DataFrame, pattern: bytes) -> DataFrame:
    """Rows whose payload holds the bytes, with offsets of all matches."""
    n = len(pattern)
    if not n:
        return df.withColumn("offsets", F.array().cast("array<int>")).limit(0)
    places = F.sequence(F.lit(0), F.octet_length("payload") - n)
    found = F.filter(places, lambda i: F.substring(F.col("payload"), i + 1, F.lit(n)) == F.lit(pattern))
    return df.filter(F.contains("payload", F.lit(pattern))).withColumn("offsets", found)


def search_bytes(text: str) -> bytes:
    """Pairs of hexadecimal digits as bytes, any other text as UTF-8."""
    packed = text.replace(" ", "")
    return bytes.fromhex(packed) if re.fullmatch(r"(?:[0-9A-Fa-f]{2})+", packed) else text.encode()
