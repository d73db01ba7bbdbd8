"""Operators that were cut for scale, against plain Python: numbers in channels, levels of traces, fragments, decoders, packets."""

import random
import struct
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tracelake.operators import aggregates, packets, traces
from tracelake.plans import registry
from tracelake.streaming import jobs


def test_numbers_in_a_hot_channel(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(50), "a" if rng.random() < 0.9 else None, rng.choice(["x", "y", None])) for i in range(500)]
    got = aggregates.channel_sequence(spark.createDataFrame(rows, "id long, ts_ns long, adapter string, origin string")).collect()
    own = defaultdict(list)
    for i, ts, a, o in sorted(rows, key=lambda r: (r[1], r[0])):
        own[a, o].append(i)
    assert {r.id: r.channel_seq for r in got} == {i: n for ids in own.values() for n, i in enumerate(ids)}


def test_deep_traces_and_cycles(spark):
    deep = [("t", f"s{k}", f"s{k - 1}" if k else None, k) for k in range(150)]
    odd = [("u", "a", "b", 1), ("u", "b", "a", 2), ("u", "c", None, 3), ("u", "d", "c", 4), ("v", "x", "gone", 5)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(deep + odd)], "trace_id string, span_id string, parent_span_id string, start_ns long, id long")
    got = {(r.trace_id, r.span_id): (r.level, r.ordinal) for r in traces.trace_levels(df).collect()}
    want = {("t", f"s{k}"): (k, k) for k in range(150)} | {("u", "c"): (0, 0), ("u", "d"): (1, 1), ("v", "x"): (0, 0)}
    assert got == want


def test_listing_of_random_traces(spark):
    """A loop over a stack lists the same; one trace and one parent hold most spans, starts are equal often, some parents are gone."""
    rng = random.Random(3)
    rows, below = [], defaultdict(list)
    for i in range(1200):
        trace = "big" if i % 3 else f"t{rng.randrange(80)}"
        mine = [r[1] for r in rows if r[0] == trace]
        parent = None if not mine or rng.random() < 0.05 else "gone" if rng.random() < 0.03 else mine[0] if rng.random() < 0.5 else rng.choice(mine)
        rows.append((trace, f"s{rng.randrange(1 << 40):x}", parent, rng.randrange(9), i))
    known = {r[:2] for r in rows}
    for trace, span, parent, start, _ in rows:
        below[trace, parent if (trace, parent) in known else None].append((start, span))
    want = {}
    for trace in {r[0] for r in rows}:
        stack = [(0, *c) for c in sorted(below[trace, None], reverse=True)]
        for n in range(len(rows)):
            if not stack:
                break
            level, _, span = stack.pop()
            want[trace, span] = (level, n)
            stack += [(level + 1, *c) for c in sorted(below[trace, span], reverse=True)]
    odd = [(None, "a", None, 1, -1), ("t0", None, None, 1, -2)]
    df = spark.createDataFrame(rows + odd, "trace_id string, span_id string, parent_span_id string, start_ns long, id long")
    assert {(r.trace_id, r.span_id): (r.level, r.ordinal) for r in traces.trace_levels(df).collect()} == want
    assert traces.trace_levels(df.limit(0)).collect() == []


def test_fragment_ids_are_used_again(spark):
    part = lambda ts, at, more, data: ("a", "b", 7, 17, ts, at, more, data, None)
    rows = [part(0, 0, True, b"12345678"), part(10, 8, False, b"ab"), part(9_000_000, 8, False, b"zz"), part(9_000_001, 0, True, b"87654321"), part(9_000_002, 8, False, b"zzz")]
    df = spark.createDataFrame(rows, "src_ip string, dst_ip string, ip_id long, ip_protocol int, ts_us long, frag_offset int, more_fragments boolean, payload binary, error string")
    assert sorted(bytes(r.payload) for r in packets.ip_defragment(df).collect()) == [b"12345678ab", b"87654321zz"]  # whole before zzz comes


def test_decoders_get_parts_in_order(spark):
    body = b"".join(struct.pack(">I", len(x)) + x for x in (b"one", b"", b"three"))
    rows = [(1, k, body[k : k + 2]) for k in range(0, len(body), 2)] + [(2, 0, b"\0\0\0\x09ab")]
    streams = spark.createDataFrame(rows, "flow long, part long, data binary").repartition(3)
    registry.register_decoder("prefixed", registry.length_prefixed, "flow long, n int, size int, complete boolean")
    try:
        got = sorted(tuple(r) for r in registry.decode(streams, "prefixed").collect())
    finally:
        registry.DECODERS.pop("prefixed")
    assert got == [(1, 0, 3, True), (1, 1, 0, True), (1, 2, 5, True), (2, 0, 6, False)]


def ethernet(body, kind=0x0800, tags=()):
    return bytes(12) + b"".join(struct.pack(">HH", 0x8100, t) for t in tags) + struct.pack(">H", kind) + body


def ip4(body, protocol=6, ip_id=5, frag=0):
    return struct.pack(">BBHHHBBH4B4B", 0x45, 0, 20 + len(body), ip_id, frag, 64, protocol, 0, 10, 0, 0, 1, 10, 0, 0, 2) + body


def test_packets_of_all_kinds(spark):
    tcp = struct.pack(">HHIIBBHHH", 40000, 443, 7, 9, 0x50, 0x12, 0, 0, 0) + b"data"
    udp = struct.pack(">HHHH", 53, 5353, 12, 0) + b"dns!"
    six = struct.pack(">IHBB", 0x60000000, len(udp), 17, 1) + bytes(15) + b"\x01" + bytes(15) + b"\x02" + udp
    rows = [
        (0, 1, ethernet(ip4(tcp)) + b"pad"), (1, 1, ethernet(ip4(udp, 17), tags=(5, 6))), (2, 101, six), (3, 1, ethernet(b"", 0x0806)), (4, 1, ethernet(ip4(tcp))[:36]), (5, 99, b"x"), (6, 0, bytes(4) + ip4(udp, 17)),
        (7, 113, bytes(14) + b"\x08\x00" + ip4(tcp, frag=0x2000)), (8, 1, b""), (9, 1, ethernet(ip4(tcp), 0x1234)), (10, 276, b"\x86\xdd" + bytes(18) + six), (11, 1, None), (12, 1, ethernet(ip4(tcp))[:46]),
    ]
    df = spark.createDataFrame([(i, link, data) for i, link, data in rows], "id long, linktype int, data binary").withColumn("ts_us", F.col("id"))
    got = {r.id: r for r in packets.packet_headers(df).collect()}
    show = lambda r: (r.protocol, r.src_ip, r.src_port, r.dst_port, bytes(r.payload) if r.payload is not None else None, r.error)
    assert show(got[0]) == ("tcp", "10.0.0.1", 40000, 443, b"data", None) and (got[0].seq, got[0].ack, got[0].flags, got[0].vlan_id, got[0].ip_id) == (7, 9, 0x12, None, 5)
    assert show(got[1]) == ("udp", "10.0.0.1", 53, 5353, b"dns!", None) and got[1].vlan_id == 5 and got[1].seq is None
    assert show(got[2]) == ("udp", "0000:0000:0000:0000:0000:0000:0000:0001", 53, 5353, b"dns!", None) and got[10].dst_ip.endswith("0002") and show(got[10]) == show(got[2])
    assert [got[k].error for k in (3, 4, 5, 8, 9, 11)] == ["arp", "cut packet", "unknown link type", "no ip header", "unknown protocol type", "no ip header"]
    assert show(got[6]) == ("udp", "10.0.0.1", 53, 5353, b"dns!", None)
    assert got[7].protocol == "other" and got[7].more_fragments and bytes(got[7].payload) == tcp and got[7].flow is None
    assert got[12].error is None and got[12].src_port == 40000 and got[12].payload is None
    assert packets.packet_headers(df.limit(0)).count() == 0


def test_recent_keeps_two_folders(spark, tmp_path):
    for k in range(5):
        spark.range(10 * k, 10 * k + 10).select("id", F.col("id").alias("ts_ns")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = jobs.stream_recent(jobs.stream_load(spark, str(tmp_path / "in"), "id long, ts_ns long"), str(tmp_path / "out"), 7).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["0", "1"]
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out" / "0")).collect()) == list(range(43, 50))


@pytest.mark.parametrize("by", [None, ["g"]])
def test_ranks_with_far_outliers(spark, by):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), v) for v in [*(rng.randrange(1000) for _ in range(400)), 10**15, -(10**15)]]
    got = aggregates.nearest_rank(spark.createDataFrame(rows, "g string, v long"), "v", {"p": 0.5, "q": 0.95}, by).collect()
    for r in got:
        values = sorted(v for g, v in rows if not by or g == r.g)
        at = lambda p: values[int(p * (len(values) - 1) + 0.5)]  # noqa: E731, B023
        assert (r.p, r.q) == (at(0.5), at(0.95))


def test_templates_share_their_parts(spark, sf_dir):
    """Addresses are read in a projection, which evaluates common parts once, not in the generator, which doesn't."""
    from tracelake.plans import queries

    plan = queries.QUERIES["filter_templates"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    generators = [line for line in plan.splitlines() if "Generate" in line]
    assert generators and not any("regexp" in line for line in generators) and "regexp" in plan
