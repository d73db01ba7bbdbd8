"""Hand-built cases and brute-force twins of the operators that SQL says little about."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelake.functions import fields, predicates, tracectx, wire
from tracelake.functions.wire import wire_fields
from tracelake.operators import aggregates, correlate, diff, packets
from tracelake.plans.registry import exporter

SCHEMA = (
    "id long, ts_ns long, adapter string, origin string, src string, dst string, transport string, direction string, payload_type string, payload binary, fields string, "
    "schema_name string, metadata map<string,string>, sequence long, warnings array<string>"
)


def message(id=1, ts=0, src="10.0.0.1:40000", dst="10.0.0.2:443", transport="TCP", direction="outbound", payload=b"abc", metadata=None, sequence=None, warnings=()):
    return (id, ts, "a", "o", src, dst, transport, direction, "raw", payload, None, None, metadata or {}, sequence, list(warnings))


@pytest.fixture()
def one(spark):
    return lambda *rows: spark.createDataFrame(list(rows), SCHEMA)


def holds(df, condition):
    return [r.id for r in df.filter(condition).orderBy("id").collect()]


def test_absent_fields_fail_every_comparison(one):
    df = one(message(1, metadata={"grpc.status": "0"}), message(2))
    assert holds(df, predicates.cmp("grpc.status", "!=", "1")) == [1]
    assert holds(df, predicates.negate(predicates.cmp("grpc.status", "!=", "1"))) == [2]
    assert holds(df, predicates.filter_simple_export("grpc.status", "!=", "0")) == [2]
    assert holds(df, predicates.cmp("grpc.status", "==", 0.0)) == [1]
    assert holds(df, predicates.matches("grpc.status", "[")) == []


def test_ports_and_addresses(one):
    df = one(message(1), message(2, transport="gRPC"), message(3, src="[::1]:80", dst="[::1]:99999"), message(4, src=None, dst=None), message(5, src="300.1.1.1:5", dst="x"))
    assert holds(df, predicates.port_either("tcp", "==", 443)) == [1]
    assert holds(df, predicates.ip_either("==", "10.0.0.2")) == [1, 2]
    got = df.orderBy("id").select(fields.addr_ip(F.col("src")).alias("ip"), fields.addr_port(F.col("dst")).alias("port")).collect()
    assert [(r.ip, r.port) for r in got] == [("10.0.0.1", 443), ("10.0.0.1", 443), ("::1", None), (None, None), (None, None)]
    assert holds(df, predicates.cmp("transport", "==", "raw-tcp")) == [1, 3, 4, 5]


def test_bytes_are_searched(one):
    df = one(message(1, payload=b"aXaXa"), message(2, payload=b""), message(3, payload=None))
    rows = predicates.payload_search(df, b"aXa").collect()
    assert [(r.id, r.offsets) for r in rows] == [(1, [0, 2])]
    assert predicates.search_bytes("61 58") == b"aX" and predicates.search_bytes("zz") == b"zz"


def test_trace_headers(spark):
    t, s = "4bf92f3577b34da6a3ce929d0e0e4736", "00f067aa0ba902b7"
    cases = [
        ({"traceparent": f"00-{t}-{s}-01", "tracestate": "k=v"}, (t, s, True)), ({"traceparent": f"01-{t}-{s}-01"}, None), ({"traceparent": f"00-{'0' * 32}-{s}-01"}, None),
        ({"b3": f"{t[:16]}-{s}-d"}, ("0" * 16 + t[:16], s, True)), ({"b3": s}, None), ({"X-B3-TraceId": t.upper(), "x-b3-spanid": s}, (t, s, False)),
        ({"uber-trace-id": f"{t}:{s}:0:3"}, (t, s, True)), ({"uber-trace-id": f"{t}:{s}:0:256"}, None), ({"uber-trace-id": f"{t}:{s}:0"}, None), ({}, None),
    ]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "id int, h map<string,string>")
    got = [r.c and (r.c.trace_id, r.c.span_id, r.c.sampled) for r in df.withColumn("c", tracectx.extract_trace_context(F.col("h"))).orderBy("id").collect()]
    assert got == [w for _, w in cases]


def wire_twin(data):
    out, at = [], 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            if at >= len(data):
                raise ValueError
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    try:
        while at < len(data):
            key = varint()
            number, wire = key >> 3, key & 7
            if not number:
                return None
            if wire == 0:
                out.append((number, 0, varint()))
            elif wire == 2:
                n = varint()
                if at + n > len(data):
                    return None
                out.append((number, 2, n))
                at += n
            elif wire in (1, 5):
                n = 8 if wire == 1 else 4
                if at + n > len(data):
                    return None
                out.append((number, wire, int.from_bytes(data[at : at + n], "little", signed=n == 8)))
                at += n
            else:
                return None
    except ValueError:
        return None
    return out


def test_wire_fields_twin(spark):
    rng = random.Random(1)
    data = [b"", bytes.fromhex("0801120 4 6e6f6e651a03646f65".replace(" ", "")), b"\x0a\x00", b"\x0d\x01\x02\x03\x04", b"\x09" + bytes(7)]
    data += [bytes(rng.choice([8, 18, 13, 1, 2, 3, 200, 0]) for _ in range(rng.randrange(1, 9))) for _ in range(200)]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "id int, p binary")
    got = {r.id: r.f and [(x.number, x.wire, x.value if x.value is not None else x.size) for x in r.f] for r in df.withColumn("f", wire_fields("p")).collect()}
    for i, d in enumerate(data):
        assert got[i] == wire_twin(d), d.hex()


def test_wire_fields_over_windows(monkeypatch):
    """Payloads longer than the window, nulls, cut payloads and long varints, read from a slice of a batch."""
    rng = random.Random(5)
    varint = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    def field() -> bytes:
        kind = rng.choice([0, 1, 2, 5])
        noise = rng.randbytes({1: 8, 5: 4}.get(kind, rng.choice([0, 1, 5, 90, 300])))
        body = varint(rng.choice([0, 300, 1 << 40, (1 << 63) - 1])) if kind == 0 else varint(len(noise)) + noise if kind == 2 else noise
        return varint(rng.choice([1, 3, 200, 1 << 20]) << 3 | kind) + body

    data = [None if k % 20 == 0 else b"".join(field() for _ in range(rng.randrange(30))) for k in range(300)]
    data += [d[: rng.randrange(len(d) + 1)] for d in data if d] + [rng.randbytes(rng.randrange(1, 14)) for _ in range(500)]
    rng.shuffle(data)
    for window in (7, 64, 1000, 1 << 20):
        monkeypatch.setattr(wire, "WINDOW", window)
        got = wire.read_fields(pa.array(data, pa.binary()).slice(3)).to_pylist()
        for d, fields in zip(data[3:], got, strict=True):
            plain = fields and [(x["number"], x["wire"], x["value"] if x["value"] is not None else x["size"]) for x in fields]
            assert plain == (None if d is None else wire_twin(d))


def pairs_twin(ways):
    """The pairing loop: an outbound takes the next inbound; a tail of outbounds opens one pair each."""
    out, k, n, i = {}, 0, len(ways), 0
    while i < n:
        if ways[i] == "outbound":
            j = i + 1
            while j < n and ways[j] != "inbound":
                j += 1
            out[i] = k
            if j < n:
                if j == i + 1:
                    out[j] = k
                else:
                    out[j] = k
                i = j + 1
            else:
                i += 1
            k += 1
        else:
            i += 1
    return out


def test_request_reply_twin(one):
    rng = random.Random(2)
    ways = [rng.choice(["inbound", "outbound"]) for _ in range(60)] + ["outbound"] * 3
    df = one(*(message(i, i, transport="ZMQ", direction=w, metadata={"zmq.socket_type": "REQ"}) for i, w in enumerate(ways)))
    got = {r.id: r.pair_index for r in correlate.pair_req_rep(df).collect() if r.pair_index is not None}
    assert got == pairs_twin(ways)


def test_overlapping_segments(spark):
    rows = [("f", 0, 0, 0, 1, b"aaaa"), ("f", 0, 0, 2, 2, b"bbbb"), ("f", 0, 0, 2, 3, b"cccc"), ("f", 0, 0, 10, 4, b"dd"), ("f", 0, 0, 3, 5, b"x")]
    df = spark.createDataFrame(rows, "flow string, dir int, epoch int, rel long, arrival long, payload binary")
    got = [(r.run, r.start, bytes(r.data)) for r in packets.tcp_reassemble(df).orderBy("start").collect()]
    assert got == [(0, 0, b"aaaabb"), (1, 10, b"dd")]
    assert [(r.missing_start, r.missing_end) for r in packets.tcp_missing_ranges(df).collect()] == [(6, 10)]


def test_event_diff_twin(one):
    rng = random.Random(3)
    rows = lambda: [message(i, rng.randrange(0, 3_000_000_000), metadata={"grpc.method": rng.choice("ab")} if rng.random() < 0.7 else {}) for i in range(60)]
    a, b = rows(), rows()
    free, want = {r[0]: r for r in b}, []
    for r in a:
        m = r[12].get("grpc.method")
        near = [(abs(x[1] - r[1]), k) for k, x in free.items() if abs(x[1] - r[1]) <= diff.WINDOW_NS and (not m or not x[12] or x[12]["grpc.method"] == m)]
        want.append((r[0], free.pop(min(near)[1])[0] if near else None))
    got = diff.diff_events(one(*a), one(*b)).filter("left_id is not null").collect()
    assert sorted((r.left_id, r.right_id) for r in got) == sorted(want)


@pytest.mark.parametrize("values", [[], [5], [1, 1, 2, 9], list(range(100))])
def test_nearest_rank(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v long")
    row = aggregates.nearest_rank(df, "v", {"p50": 0.5, "p99": 0.99}).first()
    rank = lambda p: sorted(values)[int(p * (len(values) - 1) + 0.5)] if values else 0
    assert (row.p50, row.p99) == (rank(0.5), rank(0.99))


def test_unknown_exporter():
    import tracelake.plans.queries  # noqa: F401

    with pytest.raises(KeyError):
        exporter("nope")
    assert exporter("har").extension == ".har"
