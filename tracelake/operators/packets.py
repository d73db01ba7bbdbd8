"""Packets to streams: header parsing, fragments, flows, TCP reassembly."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.operators import scan
from tracelake.plans.ship import map_arrow

IDLE_NS = 30_000_000_000
FRAGMENT_US = 5_000_000
WRAP = 1 << 32


class _Bytes:
    """The packets of a batch as one array; reads give values and whether the packet is long enough for them."""

    def __init__(self, column: pa.Array):
        raw = pc.fill_null(column, b"").cast(pa.large_binary())
        n, buffers = len(raw), raw.buffers()
        offsets = np.frombuffer(buffers[1], np.int64, n + 1, raw.offset * 8)
        data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
        self.start, self.size = offsets[:-1], np.diff(offsets)
        self.data = np.append(data, np.zeros(1, np.uint8))

    def read(self, at: np.ndarray, size: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unsigned big-endian integers of size bytes at 0-based places."""
        ok = known & (at >= 0) & (at + size <= self.size)
        first = np.where(ok, self.start + at, len(self.data) - size)
        value = np.zeros(len(at), np.int64)
        for k in range(size):
            value = value << 8 | self.data[first + k]
        return np.where(ok, value, 0), ok


_DIGITS = pa.array([str(k) for k in range(256)])
_GROUPS = pa.array([f"{k:04x}" for k in range(1 << 16)])
_HEADERS = (
    "vlan_id int, ip_protocol int, src_ip string, dst_ip string, ip_id long, frag_offset int, more_fragments boolean, protocol string, src_port int, dst_port int, "
    "seq long, ack long, flags int, payload binary, error string"
)


#: Extension headers that are walked: hop-by-hop, routing, authentication (its length counts words), destination options, mobility; and fragments.
_EXTENSIONS, _AUTHENTICATION, _FRAGMENT = (0, 43, 51, 60, 135), 51, 44


@dataclass
class _Chain:
    """What follows the extension headers of a batch's packets: place and protocol; fragment fields; whether the chain is cut off."""

    at: np.ndarray
    protocol: np.ndarray
    offset: np.ndarray
    more: np.ndarray
    id: np.ndarray
    has_id: np.ndarray
    cut: np.ndarray


def _walk(d: _Bytes, at: np.ndarray, protocol: np.ndarray, rows: np.ndarray, six: np.ndarray) -> _Chain:
    """Goes over the extension headers of all packets at once, one header a turn, until every packet has settled.

    Version 4 has authentication headers only. A fragment's data is not looked into; a fragment header of a whole datagram is passed.
    """
    n = len(at)
    out = _Chain(at.astype(np.int64), protocol.copy(), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, bool))
    going = rows.copy()
    while True:
        going &= np.isin(out.protocol, (*_EXTENSIONS, _FRAGMENT)) & (six | (out.protocol == _AUTHENTICATION))
        if not going.any():
            return out
        step = d.read(out.at, 2, going)
        kind, following, units = out.protocol, step[0] >> 8, step[0] & 255
        size = np.select([kind == _FRAGMENT, kind == _AUTHENTICATION], [8, (units + 2) * 4], (units + 1) * 8)
        out.cut |= going & (~step[1] | (out.at + size > d.size))
        going &= ~out.cut
        part = going & (kind == _FRAGMENT)
        place, ident = d.read(out.at + 2, 2, part), d.read(out.at + 4, 4, part)
        out.offset, out.more = np.where(part, place[0] & 0xFFF8, out.offset), np.where(part, (place[0] & 1) == 1, out.more)
        out.id, out.has_id = np.where(part, ident[0], out.id), out.has_id | part
        out.at, out.protocol = np.where(going, out.at + size, out.at), np.where(going, following, out.protocol)
        going &= ~(part & (out.more | (out.offset > 0)))


def _transport(d: _Bytes, l4: np.ndarray, end: np.ndarray, protocol: np.ndarray, good: np.ndarray, whole: np.ndarray, error: np.ndarray) -> list[pa.Array]:
    """protocol, src_port, dst_port, seq, ack, flags, payload and error of what begins at l4; ports are read from whole datagrams only."""
    column = lambda x, kind: pa.array(x[0], kind, mask=~x[1])
    tcp, udp = good & whole & (protocol == 6), good & whole & (protocol == 17)
    ported = tcp | udp
    words = d.read(l4 + 12, 1, tcp)
    start, start_ok = np.where(tcp, l4 + (words[0] >> 4) * 4, np.where(udp, l4 + 8, l4)), good & (words[1] | ~tcp)
    ports = d.read(l4, 2, ported), d.read(l4 + 2, 2, ported)
    error = np.where(ported & ~ports[1][1], "cut packet", error)
    data, low = d.data.tobytes(), d.start + np.minimum(start, d.size)
    high = np.maximum(d.start + end, low)
    payload = [data[x:y] if ok else None for x, y, ok in zip(low.tolist(), high.tolist(), start_ok.tolist(), strict=True)]
    seq, ack, flags = d.read(l4 + 4, 4, tcp), d.read(l4 + 8, 4, tcp), d.read(l4 + 13, 1, tcp)
    return [
        pa.array(np.select([tcp, udp], ["tcp", "udp"], "other"), pa.string(), mask=~good), column(ports[0], pa.int32()), column(ports[1], pa.int32()), column(seq, pa.int64()),
        column(ack, pa.int64()), column(flags, pa.int32()), pa.array(payload, pa.binary()), pa.array(error, pa.string(), mask=error == ""),
    ]


def _parse(raw: pa.Array, link_types: np.ndarray) -> list[pa.Array]:
    """The columns of _HEADERS for the packets of a batch."""
    d, link = _Bytes(raw), link_types
    n = len(link)
    every, fixed = np.ones(n, bool), lambda k: np.full(n, k, np.int64)
    is_in = lambda x, *values: np.isin(x[0], values) & x[1]
    column = lambda x, ok, kind: pa.array(x, kind, mask=~ok)
    tag = (link == 1) & is_in(d.read(fixed(12), 2, every), 0x8100, 0x88A8)
    twice = tag & is_in(d.read(fixed(16), 2, every), 0x8100, 0x88A8)
    vlan = d.read(fixed(14), 2, tag)
    at = np.select([link == 0, link == 1, link == 101, link == 113, link == 276], [4, np.where(twice, 22, np.where(tag, 18, 14)), 0, 16, 20], -1)
    known = at >= 0
    kind = d.read(np.select([link == 1, link == 113], [at - 2, 14], 0), 2, np.isin(link, (1, 113, 276)))
    first = d.read(at, 1, known)
    version = first[0] >> 4
    six = first[1] & (version == 6)
    head, head_ok = np.where(six, 40, (first[0] & 15) * 4), first[1]
    frag = d.read(at + 6, 2, known & ~six)
    length = d.read(np.where(six, at + 4, at + 2), 2, known)
    end = np.where(length[1], np.minimum(at + np.where(six, 40, 0) + length[0], d.size), d.size)
    error = np.select(
        [~known, is_in(kind, 0x0806), kind[1] & ~np.isin(kind[0], (0x0800, 0x86DD)), ~(first[1] & np.isin(version, (4, 6))), ~head_ok | (d.size < at + head)],
        ["unknown link type", "arp", "unknown protocol type", "no ip header", "cut packet"], "",
    )
    good = error == ""
    protocol = d.read(np.where(six, at + 6, at + 9), 1, known & head_ok)
    chain = _walk(d, at + head, protocol[0], good & protocol[1], six)
    protocol = chain.protocol, protocol[1]
    frag_known = frag[1] | six & ~chain.cut
    offset, more = np.where(six, chain.offset, (frag[0] & 0x1FFF) * 8), np.where(six, chain.more, (frag[0] & 0x2000) != 0)
    error = np.where(good & chain.cut, "cut packet", error)
    t = _transport(d, chain.at, end, protocol[0], error == "", frag_known & (offset == 0) & ~more, error)

    def address(place4: int, place6: int) -> pa.Array:
        four = [d.read(at + place4 + k, 1, known & ~six) for k in range(4)]
        short = pc.binary_join_element_wise(*(_DIGITS.take(pa.array(v)) for v, _ in four), ".")
        out = pc.if_else(pa.array(four[3][1]), short, None)
        if six.any():
            parts = [d.read(at + place6 + 2 * k, 2, six) for k in range(8)]
            out = pc.if_else(pa.array(parts[7][1]), pc.binary_join_element_wise(*(_GROUPS.take(pa.array(v)) for v, _ in parts), ":"), out)
        return out

    ip_id = d.read(at + 4, 2, known & ~six)
    return [
        column(vlan[0] & 0xFFF, vlan[1], pa.int32()), column(protocol[0], protocol[1], pa.int32()), address(12, 8), address(16, 24),
        column(np.where(chain.has_id, chain.id, ip_id[0]), ip_id[1] | chain.has_id, pa.int64()), column(offset, frag_known, pa.int32()), column(more, frag_known, pa.bool_()), *t,
    ]


def packet_headers(df: DataFrame) -> DataFrame:
    """df (linktype, ts_us, data, ...) with addresses, ports, TCP fields, fragment fields, payload and error.

    Chains of IPv6 extension headers are walked (of IPv4 the authentication header), and give id and offset of fragments.
    Link types 0 (loopback), 1 (Ethernet), 101 (raw), 113 and 276 (cooked); one VLAN tag or two, the first
    is kept. IPv6 addresses are eight groups of four digits. ARP, unknown types and cut packets get an error.
    Headers are read for a batch of packets at a time, in numpy: Catalyst has no byte access but by text.
    """
    schema = T.StructType([*df.schema.fields, *T._parse_datatype_string(_HEADERS).fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = pc.fill_null(batch.column("linktype").cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, *_parse(batch.column("data"), links)], names)

    return map_arrow(df, run, schema).withColumn("flow", flow_key())


def tcp_flags(df: DataFrame) -> DataFrame:
    """fin, syn, rst, psh, ack_flag from the flags byte."""
    bit = lambda b: F.col("flags").bitwiseAND(F.lit(b)) != 0
    return df.withColumns({"fin": bit(1), "syn": bit(2), "rst": bit(4), "psh": bit(8), "ack_flag": bit(16)})


_DATAGRAM = ("src_ip", "dst_ip", "ip_id", "ip_protocol")


@dataclass
class Datagram:
    """Fragments of one datagram as they come: its bytes so far and the gap-free ranges of them."""

    MOST = 65_535
    data: bytearray = field(default_factory=bytearray)
    ranges: list[tuple[int, int]] = field(default_factory=list)
    end: int | None = None
    started: int = 0
    last: int = 0

    def add(self, offset: int, more: bool, payload: bytes) -> bytes | None:
        """Takes a fragment; gives the whole datagram if it is the last that was missing.

        Later bytes replace earlier ones. A fragment is left out that ends past the datagram's end or MOST, names another
        end, or has others to follow and isn't a multiple of eight bytes long.
        """
        stop = offset + len(payload)
        wrong = stop > self.MOST or more and len(payload) % 8 or self.end is not None and (stop > self.end or not more and stop != self.end)
        if wrong or not more and self.ranges and self.ranges[-1][1] > stop:
            return None
        if not more:
            self.end = stop
        self.data.extend(bytes(max(0, stop - len(self.data))))
        self.data[offset:stop] = payload
        apart = [r for r in self.ranges if r[1] < offset or r[0] > stop]
        joined = [r for r in self.ranges if r[1] >= offset and r[0] <= stop]
        self.ranges = sorted([*apart, (min([offset, *(r[0] for r in joined)]), max([stop, *(r[1] for r in joined)]))])
        return bytes(self.data) if self.ranges == [(0, self.end)] else None


def _join_fragments(keys: list[str]):
    """One datagram is open at a time: it ends when it is whole, with its key, or after FRAGMENT_US without a fragment."""
    names = [*keys, "started_us", "ts_us", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_ = None, Datagram()
        for batch in batches:
            out = []
            for *own, ts, offset, more, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != key or ts - open_.last >= FRAGMENT_US or not open_.ranges:
                    key, open_ = own, Datagram(started=ts)
                open_.last = ts
                if (whole := open_.add(offset, more, payload)) is not None:
                    out.append((*own[:-1], open_.started, ts, whole))
                    open_ = Datagram()
            if out:
                kinds = [batch.schema.field(k).type for k in range(len(keys))] + [pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def ip_defragment(df: DataFrame, *by: str) -> DataFrame:
    """(src_ip, dst_ip, ip_id, ip_protocol, *by, started_us, ts_us, payload) of whole datagrams, from fragments among packet_headers' rows.

    by: columns that tell apart what was captured in different places; fragments that differ in them are not joined.

    Fragments of an id are taken in order of time (of offset at one time). A datagram is closed the moment it has no gaps, and the next
    fragment of the id begins another; one that is incomplete goes after FRAGMENT_US without a fragment. started_us
    and ts_us are the times of its first fragment and of the one that made it whole. See Datagram for overlaps.

    An id's fragments are cut where they pause for FRAGMENT_US, and such runs are dealt to tasks; a task holds one
    open datagram, at most 64 KiB.
    """
    keys, order = [*_DATAGRAM, *by], ["ts_us", "frag_offset"]
    parts = df.filter("error is null and payload is not null and (frag_offset > 0 or more_fragments)").select(*keys, "ts_us", "frag_offset", "more_fragments", "payload")
    timed = scan.running(scan.dealt(parts, keys, order), keys, order, before=("last", F.col("ts_us")))
    paused = F.coalesce((F.col("ts_us") - F.col("before") >= FRAGMENT_US).cast("int"), F.lit(0))
    runs = scan.running(timed, keys, order, _earlier=("sum", paused)).withColumn("_run", F.col("_earlier") + paused)
    own = [*keys, "_run"]
    ready = runs.repartition(*own).sortWithinPartitions(*own, *order, "more_fragments", "payload").select(*own, *order, "more_fragments", "payload")
    kinds = {f.name: f.dataType.simpleString() for f in parts.schema}
    return map_arrow(ready, _join_fragments(keys), ", ".join(f"{c} {kinds[c]}" for c in keys) + ", started_us long, ts_us long, payload binary")


def datagram_headers(datagrams: DataFrame) -> DataFrame:
    """ip_defragment's rows as packet_headers' ones: ports, TCP fields and payload are read from the joined bytes."""
    schema = T.StructType([*datagrams.drop("payload", "ip_protocol").schema.fields, *T._parse_datatype_string("ip_protocol int, frag_offset int, more_fragments boolean, " + _HEADERS[_HEADERS.index("protocol string") :]).fields])
    kept = [f.name for f in datagrams.drop("payload", "ip_protocol").schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d = len(batch), _Bytes(batch.column("payload"))
            protocol = pc.fill_null(batch.column("ip_protocol").cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
            six = pc.match_substring(pc.fill_null(batch.column("src_ip"), ""), ":").to_numpy(zero_copy_only=False)
            chain = _walk(d, np.zeros(n, np.int64), protocol, np.ones(n, bool), six)
            t = _transport(d, chain.at, d.size, chain.protocol, ~chain.cut, np.ones(n, bool), np.where(chain.cut, "cut packet", ""))
            made = [pa.array(chain.protocol, pa.int32()), pa.array(np.zeros(n), pa.int32()), pa.array(np.zeros(n, bool)), *t]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], schema.names)

    return map_arrow(datagrams, run, schema).withColumn("flow", flow_key())


def whole_packets(headers: DataFrame, *by: str) -> DataFrame:
    """packet_headers' rows with fragments replaced by the datagrams that they make up; by: see ip_defragment."""
    fragment = F.col("error").isNull() & ((F.col("frag_offset") > 0) | F.col("more_fragments"))
    joined = datagram_headers(ip_defragment(headers, *by)).drop("started_us")
    return headers.filter(~F.coalesce(fragment, F.lit(False))).unionByName(joined, allowMissingColumns=True)


def flow_key() -> Column:
    """Both ends, the smaller text first, and the protocol; null for rows that are neither TCP nor UDP."""
    a, b = (F.concat_ws(":", f"{side}_ip", F.col(f"{side}_port").cast("string")) for side in ("src", "dst"))
    return F.when(F.col("protocol").isin("tcp", "udp"), F.concat_ws("|", F.least(a, b), F.greatest(a, b), "protocol"))


def partition_by_flow(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Flows whole in a partition, arrival order inside."""
    keyed = df.repartition(partitions, "flow") if partitions else df.repartition("flow")
    return keyed.sortWithinPartitions("flow", "ts_us")


def tcp_orient(df: DataFrame) -> DataFrame:
    """dir: 0 from the lower port's side (the client's), 1 from the other; of equal ports the first sender is the server.

    First senders are an aggregate over flows of equal ports, which a long connection doesn't hold up.
    """
    sender = F.concat("src_ip", F.lit(":"), F.col("src_port").cast("string"))
    first = df.filter("src_port = dst_port").groupBy("flow").agg(F.min_by(sender, F.struct("ts_us", sender)).alias("_first"))
    way = F.when(F.col("src_port") < F.col("dst_port"), 0).when(F.col("src_port") > F.col("dst_port"), 1).when(sender == F.col("_first"), 1).otherwise(0)
    return df.join(first, "flow", "left").select(*df.columns, way.alias("dir"))


def tcp_epochs(df: DataFrame) -> DataFrame:
    """epoch: connections of the flow before this row's: one ends with a reset, or when both sides have been silent for over 30 s."""
    by, order = ["flow"], ["ts_us", "dir", "seq"]
    seen = scan.running(scan.dealt(df, by, order), by, order, _resets=("sum", F.col("rst").cast("int")), _before=("last", F.col("ts_us")))
    idle = F.coalesce((F.col("ts_us") - F.col("_before") > IDLE_NS // 1000).cast("int"), F.lit(0))
    silent = scan.running(seen, by, order, _pauses=("sum", idle))
    return silent.select(*df.columns, (F.col("_resets") + F.col("_pauses") + idle).alias("epoch"))


def tcp_relative_seq(df: DataFrame) -> DataFrame:
    """rel: offset from the first sequence number seen (one more if it is a SYN), modulo 2**32."""
    at, order = F.col("seq") + F.col("syn").cast("int"), ["ts_us", "seq", "syn"]
    first = scan.running(scan.dealt(df, list(_KEYS), order), list(_KEYS), order, _isn=("first", at))
    return first.select(*df.columns, F.pmod(at - F.coalesce("_isn", at), F.lit(WRAP)).alias("rel"))


_KEYS = ("flow", "dir", "epoch")


def tcp_chunks(df: DataFrame, into: int | None = None) -> DataFrame:
    """(flow, dir, epoch, rel, payload, gap) of each direction: one chunk of equal offsets (the first to arrive, then the longest), overlaps cut from the later.

    gap: bytes missing before the chunk. Rows keep the number of their part (see scan). into: partitions of the work, else by df's size.
    """
    size, into = F.octet_length("payload"), into or scan.width(df, "payload")
    dealt = df.filter(size > 0).repartition(into, "flow", "rel")  # before the aggregate, which would sort all rows of a task that reads
    once = dealt.groupBy(*_KEYS, "rel").agg(F.min_by("payload", F.struct("arrival", -size, F.col("payload"))).alias("payload"))
    chunks = scan.running(scan.dealt(once, list(_KEYS), ["rel"], into), list(_KEYS), ["rel"], into, _reach=("max", F.col("rel") + size))
    over = F.greatest(F.coalesce(F.col("_reach") - F.col("rel"), F.lit(0)), F.lit(0)).cast("int")
    cut = chunks.withColumn("payload", F.substring("payload", over + 1, size)).withColumn("rel", F.col("rel") + over)
    return cut.filter(size > 0).withColumn("gap", F.col("rel") - F.coalesce("_reach", F.lit(0))).drop("_reach")


def stream_heads(segments: DataFrame, size: int = 256) -> DataFrame:
    """(flow, dir, epoch, src_ip, src_port, dst_ip, dst_port, protocol, ts_us, payload): the first contiguous bytes of every direction with data.

    segments: tcp_segments' rows, in any order of arrival. Only chunks that begin before size count, one for each offset
    (the first to arrive, then the longest) and no more than size bytes of it, so a stream's buffer is bounded. A direction whose
    first byte is missing has an empty head.
    """
    end = ("src_ip", "src_port", "dst_ip", "dst_port")
    data = segments.filter(F.octet_length("payload") > 0)
    near = data.filter(F.col("rel") < size).withColumn("payload", F.substring("payload", 1, size))
    once = near.groupBy(*_KEYS, "rel").agg(F.min_by("payload", F.struct("arrival", -F.octet_length("payload"), F.col("payload"))).alias("payload"))
    grown = lambda have, p: F.when(p["rel"] <= F.octet_length(have), F.concat(have, F.substring(p["payload"], F.octet_length(have) - p["rel"].cast("int") + 1, F.lit(size)))).otherwise(have)
    head = F.aggregate(F.sort_array(F.collect_list(F.struct("rel", "payload"))), F.lit(b""), grown)
    heads = once.groupBy(*_KEYS).agg(F.substring(head, 1, size).alias("payload"))
    streams = data.groupBy(*_KEYS).agg(*(F.min(c).alias(c) for c in end), F.min("ts_us").alias("ts_us"))
    return streams.join(heads, list(_KEYS), "left").select(*_KEYS, *end, F.lit("tcp").alias("protocol"), "ts_us", F.coalesce("payload", F.lit(b"")).alias("payload"))


def tcp_missing_ranges(df: DataFrame) -> DataFrame:
    """(flow, dir, epoch, missing_start, missing_end): bytes between chunks, and before the first from offset 0."""
    return tcp_chunks(df).filter("gap > 0").select(*_KEYS, (F.col("rel") - F.col("gap")).alias("missing_start"), F.col("rel").alias("missing_end"))


def tcp_reassemble(df: DataFrame, with_bytes: bool = True, run_bytes: int = 1 << 20) -> DataFrame:
    """Contiguous runs of bytes: (flow, dir, epoch, run, part, start, size[, data]).

    A run is cut in parts of about run_bytes, so no value grows with a connection. part counts from 0.
    """
    into = scan.width(df, "payload")
    chunks, opens = tcp_chunks(df, into), F.col("gap") > 0
    isles = scan.running(chunks, list(_KEYS), ["rel"], into, _runs=("sum", opens.cast("int")), _start=("last", F.when(opens, F.col("rel"))))
    islands = isles.withColumn("run", F.col("_runs") + opens.cast("int"))
    parts = islands.withColumn("part", F.floor((F.col("rel") - F.when(opens, F.col("rel")).otherwise(F.coalesce("_start", F.lit(0)))) / run_bytes))
    listed = F.sort_array(F.collect_list(F.struct("rel", "payload")))
    sums = [F.min("rel").alias("start"), F.sum(F.octet_length("payload")).alias("size")]
    if not with_bytes:
        return parts.groupBy(*_KEYS, "run", "part").agg(*sums)
    grouped = parts.repartition(into, *_KEYS, "run", "part").groupBy(*_KEYS, "run", "part").agg(*sums, listed.alias("_l"))
    return grouped.withColumn("data", F.unhex(F.array_join(F.transform("_l", lambda x: F.hex(x["payload"])), ""))).drop("_l")


def tcp_idle(df: DataFrame, now_us: int) -> DataFrame:
    """Flows whose directions have all been silent for over 30 s."""
    last = df.groupBy("flow").agg(F.max("ts_us").alias("last_us"))
    return last.filter(F.lit(now_us) - F.col("last_us") > IDLE_NS // 1000)


def tcp_segments(headers: DataFrame) -> DataFrame:
    """packet_headers' TCP rows with direction, epoch, relative offset and arrival; resets end an epoch and carry no data."""
    tcp = tcp_flags(headers.filter("protocol = 'tcp' and error is null"))
    return tcp_relative_seq(tcp_epochs(tcp_orient(tcp)).filter("not rst")).withColumn("arrival", F.col("ts_us"))


def stream_ends(segments: DataFrame) -> DataFrame:
    """Per direction of tcp_segments' rows: sender, receiver, first time, and whether it was closed by a FIN."""
    end = lambda side: F.concat(f"{side}_ip", F.lit(":"), F.col(f"{side}_port").cast("string"))
    return segments.groupBy(*_KEYS).agg(F.min(end("src")).alias("src"), F.min(end("dst")).alias("dst"), F.min("ts_us").alias("ts_us"), F.bool_or("fin").alias("closed"))


def _raw_message(transport: str, direction: Column, payload: Column, metadata: Column, warnings: Column, origin: str) -> list[Column]:
    return [
        (F.col("ts_us") * 1000).alias("ts_ns"), F.lit("pcap").alias("adapter"), F.lit(origin).alias("origin"), F.col("src"), F.col("dst"), F.lit(transport).alias("transport"),
        direction.alias("direction"), F.lit("raw").alias("payload_type"), payload.alias("payload"), metadata.alias("metadata"), warnings.alias("warnings"),
    ]


def streams_to_messages(streams: DataFrame, ends: DataFrame, origin: str = "capture") -> DataFrame:
    """Parts of reassembled streams as raw messages (flow, epoch, run, part and the message's columns).

    ends: stream_ends of the same segments. A direction without FIN is incomplete and carries a warning.
    """
    rows = streams.join(ends, list(_KEYS))
    side, closed = F.when(F.col("dir") == 0, "outbound").otherwise("inbound"), F.col("closed")
    none = F.array().cast("array<string>")
    made = _raw_message("TCP", side, F.col("data"), F.create_map(F.lit("tcp.complete"), closed.cast("string")), F.when(closed, none).otherwise(F.array(F.lit("TCP stream incomplete"))), origin)
    return rows.select("flow", "epoch", "run", "part", *made)


def datagrams_to_messages(headers: DataFrame, origin: str = "capture") -> DataFrame:
    """UDP packets as raw messages, one each, of unknown direction."""
    end = lambda side: F.concat(f"{side}_ip", F.lit(":"), F.col(f"{side}_port").cast("string")).alias(side)
    rows = headers.filter("protocol = 'udp' and error is null").select("flow", "ts_us", "payload", end("src"), end("dst"))
    return rows.select("flow", *_raw_message("UDP", F.lit("unknown"), F.col("payload"), F.create_map().cast("map<string,string>"), F.array().cast("array<string>"), origin))


def normalize_errors(headers: DataFrame) -> DataFrame:
    return headers.filter("error is not null").groupBy("error").agg(F.count("*").alias("packets"))
