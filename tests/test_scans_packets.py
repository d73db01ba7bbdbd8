"""Scans over range-sorted parts, datagrams and header chains, connections of one address pair, against plain Python."""

import random
import struct
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.test_scale_forms import ethernet, ip4
from tracelake.operators import aggregates, correlate, detect, diff, packets, scan
from tracelake.streaming import jobs


@pytest.fixture()
def parts(spark):
    """Range sorts keep all their parts, however small."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_running_values(spark, parts):
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 8 + ["a", None, "b"]), t, rng.choice([None, 1, 5, -2])) for t in range(600)]
    df = scan.dealt(spark.createDataFrame(rows, "k string, t long, v long"), ["k"], ["t"])
    assert df.filter("k = 'hot'").select(scan.PART).distinct().count() > 3
    v = F.col("v")
    got = scan.running(df, ["k"], ["t"], sum=("sum", v), max=("max", v), last=("last", v), first=("first", v), later=("-sum", v), top=("-max", v), next=("-last", v), end=("-first", v)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    want = set()
    for own in by.values():
        for i, (k, t, x) in enumerate(own):
            before, after = ([r[2] for r in side if r[2] is not None] for side in (own[:i], own[i + 1 :]))
            ends = lambda side: (max(side), side[-1], side[0]) if side else (None,) * 3
            (m, last, first), (top, end, near) = ends(before), ends(after)
            want.add((k, t, x, sum(before), m, last, first, sum(after), top, near, end))
    assert {(r.k, r.t, r.v, r.sum, r.max, r.last, r.first, r.later, r.top, r.next, r.end) for r in got} == want
    assert len(got) == len(rows) and scan.running(df.limit(0), ["k"], ["t"], n=("sum", v)).count() == 0


FRAGMENTS = "src_ip string, dst_ip string, ip_id long, ip_protocol int, ts_us long, frag_offset int, more_fragments boolean, payload binary, error string"


def joined(spark, rows):
    df = spark.createDataFrame([("a", "b", i, 17, ts, at, more, data, None) for i, ts, at, more, data in rows], FRAGMENTS).repartition(3)
    return sorted((r.ip_id, r.started_us, r.ts_us, bytes(r.payload)) for r in packets.ip_defragment(df).collect())


def test_ids_come_back_within_seconds(spark):
    two = [(7, 0, 0, True, b"A" * 8), (7, 5, 8, False, b"A" * 8), (7, 1_000_000, 8, False, b"B" * 8), (7, 1_000_005, 0, True, b"B" * 8)]
    assert joined(spark, two) == [(7, 0, 5, b"A" * 16), (7, 1_000_000, 1_000_005, b"B" * 16)]
    late = [(7, 0, 0, True, b"A" * 8), (7, 5_000_000, 8, False, b"B" * 8), (7, 5_000_001, 0, True, b"C" * 8)]
    assert joined(spark, late) == [(7, 5_000_000, 5_000_001, b"C" * 8 + b"B" * 8)]
    odd = [(1, 0, 0, True, b"1234567"), (1, 1, 0, True, b"12345678"), (1, 2, 16, True, b"x" * 8), (1, 3, 8, False, b"end"), (2, 0, 65_528, True, b"y" * 16)]
    assert joined(spark, odd) == []  # not a multiple of eight; an end before what is there; over 64 KiB
    assert joined(spark, []) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_datagrams_equal_a_loop(spark, parts, seed):
    rng, rows, ts = random.Random(seed), [], 0
    for n in range(300):
        i, data = rng.choice([7] * 5 + [1, 2]), bytes(rng.randrange(256) for _ in range(rng.choice([9, 24, 40, 61])))
        cut = [(at, at + 8 < len(data), data[at : at + 8]) for at in range(0, len(data), 8)]
        rng.shuffle(cut)
        cut += rng.sample(cut, 1) if rng.random() < 0.2 else []
        if rng.random() < 0.15:
            cut.pop()
            ts += 6_000_000
        for at, more, piece in cut:
            ts += rng.randrange(1, 50_000)
            rows.append((i, ts, at, more, piece))
        ts += rng.choice([1000, 4_000_000, 5_500_000]) if n % 4 == 0 else 10
    want, open_ = [], {}
    for i, at_us, at, more, piece in rows:
        first, last, have, end = open_.get(i, (None, None, {}, None))
        if last is None or at_us - last >= 5_000_000:
            first, have, end = at_us, {}, None
        stop = at + len(piece)
        if not (end is not None and (stop > end or not more and stop != end) or not more and have and max(have) >= stop):
            have = {**have, **{at + k: b for k, b in enumerate(piece)}}
            end = end if more else stop
        open_[i] = (first, at_us, have, end)
        if end is not None and len(have) == end:
            want.append((i, first, at_us, bytes(have[k] for k in range(end))))
            del open_[i]
        elif not have:
            del open_[i]
    assert joined(spark, rows) == sorted(want) and len(want) > 150


def six(chain, body, protocol, frag=None):
    """An IPv6 packet with extension headers (kind, data) before body."""
    kinds, out = [k for k, _ in chain] + [protocol], b""
    for (kind, data), following in zip(chain, kinds[1:], strict=True):
        out += bytes([following]) + data
    return struct.pack(">IHBB", 0x60000000, len(out) + len(body), kinds[0], 1) + bytes(15) + b"\x01" + bytes(15) + b"\x02" + out + body


HOP, ROUTE, DEST, LONG = (0, b"\0" + bytes(6)), (43, b"\0" + bytes(6)), (60, b"\0" + bytes(6)), (60, b"\2" + bytes(22))
AUTH = (51, b"\4" + bytes(22))


def fragment(offset, more, ident):
    return (44, b"\0" + struct.pack(">HI", offset | more, ident))


def test_chains_of_extension_headers(spark):
    tcp = struct.pack(">HHIIBBHHH", 40000, 443, 7, 9, 0x50, 0x12, 0, 0, 0) + b"data"
    udp = struct.pack(">HHHH", 53, 5353, 12, 0) + b"dns!"
    chains = [[HOP], [HOP, ROUTE, DEST], [LONG, AUTH], [fragment(0, 0, 9)], [HOP, fragment(0, 0, 9), DEST], [DEST, HOP, ROUTE, LONG]]
    rows = [(k, 101, six(c, tcp, 6)) for k, c in enumerate(chains)] + [(10 + k, 101, six(c, udp, 17)) for k, c in enumerate(chains)]
    rows += [(20, 101, six([HOP, fragment(8, 1, 77)], tcp, 6)), (21, 101, six([HOP], tcp, 6)[:43]), (22, 101, six([LONG], b"", 59)), (23, 1, ethernet(ip4(b"\x06\x04" + bytes(22) + tcp, 51)))]
    rows += [(24, 101, six([(60, b"\xff" + bytes(6))], tcp, 6)), (25, 1, ethernet(six([HOP, HOP, HOP], udp, 17), 0x86DD))]
    got = {r.id: r for r in packets.packet_headers(spark.createDataFrame(rows, "id long, linktype int, data binary").withColumn("ts_us", F.col("id"))).collect()}
    for k in range(len(chains)):
        assert (got[k].protocol, got[k].src_port, got[k].dst_port, got[k].seq, bytes(got[k].payload), got[k].error) == ("tcp", 40000, 443, 7, b"data", None)
        assert (got[10 + k].protocol, got[10 + k].dst_port, bytes(got[10 + k].payload)) == ("udp", 5353, b"dns!") and got[k].flow is not None
    assert [got[k].ip_id for k in (0, 3, 4)] == [None, 9, 9]
    assert (got[20].protocol, got[20].frag_offset, got[20].more_fragments, got[20].ip_id, got[20].ip_protocol, bytes(got[20].payload), got[20].flow) == ("other", 8, True, 77, 6, tcp, None)
    assert got[21].error == got[24].error == "cut packet" and (got[22].protocol, got[22].error) == ("other", None)
    assert (got[23].protocol, got[23].src_port) == ("tcp", 40000) and got[25].dst_port == 5353


def test_joined_datagrams_are_parsed_again(spark):
    tcp = struct.pack(">HHIIBBHHH", 40000, 443, 7, 9, 0x50, 0x11, 0, 0, 0) + b"0123456789abcdef"
    udp = struct.pack(">HHHH", 53, 5353, 2008, 0) + b"d" * 2000
    cut = lambda body, n: [(at, at + n < len(body), body[at : at + n]) for at in range(0, len(body), n)]
    rows = [ethernet(ip4(piece, 6, 5, (at // 8) | (0x2000 if more else 0))) for at, more, piece in cut(tcp, 16)]
    rows += [ethernet(six([HOP, fragment(at, int(more), 99)], piece, 17), 0x86DD) for at, more, piece in reversed(cut(udp, 496))]
    rows += [ethernet(six([fragment(at, int(more), 98)], piece, 60), 0x86DD) for at, more, piece in cut(bytes([17, 0]) + bytes(6) + udp, 1000)]
    rows += [ethernet(ip4(udp, 17)), ethernet(ip4(b"x" * 8, 17, 6, 0x2000))]
    df = spark.createDataFrame([(1, k, data) for k, data in enumerate(rows)], "linktype int, ts_us long, data binary")
    whole = packets.whole_packets(packets.packet_headers(df))
    got = sorted((r.protocol, r.src_port, r.dst_port, bytes(r.payload), r.seq) for r in whole.collect())
    assert got == [("tcp", 40000, 443, b"0123456789abcdef", 7), *[("udp", 53, 5353, b"d" * 2000, None)] * 3]
    made = packets.datagrams_to_messages(whole).collect()
    assert sorted({r.src for r in made}) == ["0000:0000:0000:0000:0000:0000:0000:0001:53", "10.0.0.1:53"] and len(made) == 3
    segments = packets.tcp_segments(whole)
    sent = packets.streams_to_messages(packets.tcp_reassemble(segments), packets.stream_ends(segments)).collect()
    assert [(bytes(r.payload), r.metadata["tcp.complete"]) for r in sent] == [(b"0123456789abcdef", "true")]


def segment(ts, seq, data, flags=0x10, back=False):
    a, b = ((443, 40000), (40000, 443)) if back else ((40000, 443), (443, 40000))
    return (1, ts, ethernet(ip4(struct.pack(">HHIIBBHHH", *a[:1], *b[:1], seq, 0, 0x50, flags, 0, 0, 0) + data)))


def test_pairs_used_again_after_silence(spark, parts):
    s = 1_000_000
    rows = [segment(0, 100, b"AAAA"), segment(31 * s, 100, b"BBBB"), segment(31 * s + 5, 104, b"bb"), segment(61 * s, 104, b"cc"), segment(200 * s, 5000, b"", 0x02), segment(200 * s + 1, 5001, b"DD"), segment(200 * s + 2, 0, b"", 0x04), segment(201 * s, 9, b"E")]
    segments = packets.tcp_segments(packets.packet_headers(spark.createDataFrame(rows, "linktype int, ts_us long, data binary")))
    got = sorted((r.epoch, r.start, bytes(r.data)) for r in packets.tcp_reassemble(segments).collect())
    assert got == [(0, 0, b"AAAA"), (1, 0, b"BBBBbb"), (2, 0, b"DD"), (3, 0, b"E")]


def test_one_long_connection_is_spread(spark, parts):
    rng, n = random.Random(9), 3000
    sizes = [rng.randrange(1, 30) for _ in range(n)]
    starts = [sum(sizes[:k]) for k in range(n)]
    rows = []
    for k, (at, size) in enumerate(zip(starts, sizes, strict=True)):
        if k % 500 != 499:
            rows += [("f", 0, 0, at, k, bytes([k % 256]) * size)] + ([("f", 0, 0, at, n + k, b"again")] if k % 7 == 0 else [])
            if k % 11 == 0 and k:
                rows.append(("f", 0, 0, at - 1, k, bytes([(k - 1) % 256, k % 256]) if k % 500 else b"!"))
    rows += [("g", 1, 0, 5, 1, b"xy")]
    df = spark.createDataFrame(rows, "flow string, dir int, epoch long, rel long, arrival long, payload binary")
    assert packets.tcp_chunks(df).filter("flow = 'f'").select(scan.PART).distinct().count() > 3
    got = [r for r in packets.tcp_reassemble(df, run_bytes=1000).orderBy("start").collect() if r.flow == "f"]
    reach, once, runs = 0, {}, []
    for _, _, _, rel, arrival, data in sorted(rows[:-1], key=lambda r: (r[3], r[4], -len(r[5]))):
        once.setdefault(rel, data)
    for rel, data in sorted(once.items()):
        fresh = data[max(0, reach - rel) :]
        if fresh:
            at = max(rel, reach)
            if not runs or at > reach:
                runs.append([at, b""])
            runs[-1][1] += fresh
            reach = at + len(fresh)
    byrun = defaultdict(bytes)
    for r in got:
        byrun[r.run] += bytes(r.data)
        assert r.size == len(r.data) <= 1100
    assert [byrun[k] for k in sorted(byrun)] == [d for _, d in runs] and len(runs) > 5
    gaps = packets.tcp_missing_ranges(df).filter("flow = 'f'").orderBy("missing_start").collect()
    assert [r.missing_end for r in gaps] == [at for at, _ in runs if at]


def test_pairs_on_a_busy_connection(spark, parts):
    rng = random.Random(6)
    rows = [(k, k // 2, rng.choice(["a"] * 9 + ["b"]), "d", rng.choice(["outbound", "outbound", "inbound", "unknown"])) for k in range(800)] + [(900 + k, 1000 + k, "a", "d", "outbound") for k in range(3)]
    df = spark.createDataFrame(rows, "id long, ts_ns long, src string, dst string, direction string").withColumn("origin", F.lit("o"))
    got = {r.id: r.pair_index for r in correlate.pair_req_rep(df).collect()}
    want = dict.fromkeys(got)
    for src in "ab":
        own = [r for r in sorted(rows, key=lambda r: (r[1], r[0])) if r[2] == src and r[4] != "unknown"]
        last_in, number, before = max((i for i, r in enumerate(own) if r[4] == "inbound"), default=-1), -1, None
        for i, r in enumerate(own):
            if r[4] == "outbound" and (before != "outbound" or i > last_in):
                number += 1
                want[r[0]] = number
            elif r[4] == "inbound" and before == "outbound":
                want[r[0]] = number
            before = r[4]
    assert got == want and len(got) == len(rows)


def test_topics_of_a_busy_writer(spark, parts):
    rng = random.Random(8)
    rows = [(k, rng.choice(["w"] * 9 + ["x", None]), rng.randrange(2000)) for k in range(500)]
    told = [("w", 200 * k, f"t{k}") for k in range(1, 9)] + [("x", 5, "tx")]
    got = diff.dds_topic_asof(spark.createDataFrame(rows, "id long, writer string, ts_ns long"), spark.createDataFrame(told, "writer string, ts_ns long, topic string")).collect()
    topic = lambda w, t: max(((at, x) for a, at, x in told if a == w and at <= t), default=(0, None))[1]
    assert {r.id: r.topic for r in got} == {i: topic(w, t) for i, w, t in rows} and all((r.warning is None) == (r.topic is not None) for r in got)


def test_heads_of_streams(spark):
    row = lambda flow, rel, arrival, data, back=0: (flow, back, 0, rel, arrival, data, "a", 1, "b", 2, arrival)
    rows = [row("f", 4, 0, b"efgh"), row("f", 0, 3, b"abcd"), row("f", 2, 1, b"cdXX"), row("f", 0, 9, b"other"), row("f", 12, 2, b"far"), row("g", 1, 0, b"late"), row("h", 0, 0, bytes(300)), row("h", 300, 1, b"x"), row("f", 0, 5, b"back", 1), row("i", 0, 0, b"")]
    rows += [row("j", k, 100 - k, bytes([k])) for k in range(100)]
    df = spark.createDataFrame(rows, "flow string, dir int, epoch long, rel long, arrival long, payload binary, src_ip string, src_port int, dst_ip string, dst_port int, ts_us long").repartition(3)
    got = {(r.flow, r.dir): bytes(r.payload) for r in packets.stream_heads(df).collect()}
    assert got == {("f", 0): b"abcdXXgh", ("f", 1): b"back", ("g", 0): b"", ("h", 0): bytes(256), ("j", 0): bytes(range(100))}


def test_one_verdict_for_a_stream(spark):
    hello = b"\x16\x03\x01" + bytes(600)
    rows = [segment(k, 100 + at, hello[at : at + 2]) for k, at in enumerate([0, 8, 2, 6, 4])] + [segment(9, 500, b"\x16\x03\x01", back=True), segment(10, 400, b"\x16\x03\x01")]
    rows += [(1, 20, ethernet(ip4(struct.pack(">HHHH", 53, 9, 12, 0) + b"RTPS", 17))), (1, 21, b"x")]
    headers = packets.packet_headers(spark.createDataFrame(rows, "linktype int, ts_us long, data binary"))
    one = aggregates.pipeline_stats(headers).first().asDict()
    assert one == {"packets_read": 9, "packets_failed": 1, "fragments": 0, "tcp_streams": 2, "udp_datagrams": 1, "encrypted": 2, "decrypted": 0, "decoded": 1, "fallback": 2}
    heads = packets.stream_heads(packets.tcp_segments(headers))
    mine = spark.createDataFrame([("10.0.0.1", 40000, "10.0.0.2", 443, "tcp", "MINE")], "src_ip string, src_port int, dst_ip string, dst_port int, protocol string, forced string")
    assert sorted((r.dir, r.detected) for r in detect.detect_override(heads, mine).collect()) == [(0, "TLS"), (1, "MINE")]


def test_counters_survive_a_restart(spark, tmp_path):
    where = {k: str(tmp_path / k) for k in ("in", "log", "out")}
    body = struct.pack(">HHHH", 53, 9, 12, 0) + b"data"
    for k in range(4):
        rows = [(1, k, ethernet(ip4(body, 17))), (1, k, ethernet(ip4(body, 17, frag=0x2000))), (1, k, b"short")]
        spark.createDataFrame(rows, "linktype int, ts_us long, data binary").coalesce(1).write.mode("append").parquet(where["in"])
        stream = packets.packet_headers(jobs.stream_load(spark, where["in"], "linktype int, ts_us long, data binary"))
        jobs.stream_stats(stream, where["out"]).option("checkpointLocation", where["log"]).trigger(availableNow=True).start().awaitTermination()
    assert jobs.stats_totals(spark, where["out"]).first().asDict() == {"received": 12, "normalised": 8, "routed": 4, "fragments": 4, "errors": 4}
    # a batch that runs again writes over its own counts
    jobs.stream_stats(stream, where["out"]).option("checkpointLocation", str(tmp_path / "other")).trigger(availableNow=True).start().awaitTermination()
    assert jobs.stats_totals(spark, where["out"]).first().received == 12


def test_reassembly_is_cut_by_bytes_in_memory(spark, monkeypatch):
    """Payloads that compress well don't gather in few tasks: partitions follow the rows' own bytes, and no task has many of them."""
    monkeypatch.setattr(scan, "PART_BYTES", 20_000, raising=False)
    df = spark.range(4000).selectExpr("id div 4 as flow", "0 as dir", "0 as epoch", "(id % 4) * 100 as rel", "id as arrival", "encode(repeat('x', 100), 'UTF-8') as payload")
    parts = packets.tcp_reassemble(df)
    rows = parts.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()
    assert sum(r.n for r in rows) == 1000 and sum(r["size"] for r in rows) == 400_000
    assert scan.width(df, "payload") == 50 and max(r.n for r in rows) < 100
    assert scan.width(df.limit(0), "payload") == min(spark.sparkContext.defaultParallelism, scan.STRAIGHT)
