"""Sorts, limits, samples, counts, buckets, percentiles and profiles over messages and conversations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import fields, predicates
from tracelake.functions.wire import wire_fields
from tracelake.operators import detect, packets
from tracelake.plans.shared import staged

MS = 1_000_000
_SORTS = {"id": "id", "time": "ts_ns", "source": "src", "dest": "dst", "protocol": "transport", "direction": "direction"}


def sort_messages(df: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """By a column, ids ascending among equals in either order; an absent address sorts as empty."""
    key = F.coalesce(_SORTS[by], F.lit("")) if by in ("source", "dest") else fields.transport_order(F.col("transport")) if by == "protocol" else F.col(_SORTS[by])
    return df.orderBy(key.desc() if descending else key.asc(), F.col("id").asc())


def top_protocols(df: DataFrame, n: int = 5) -> DataFrame:
    return protocol_counts(df).orderBy(F.desc("events"), fields.transport_order(F.col("transport"))).limit(n)


def recent_n(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.desc("ts_ns"), F.desc("id")).limit(n)


def recent_counts(df: DataFrame, n: int) -> DataFrame:
    return df.agg(F.count("*").alias("pushed"), F.greatest(F.count("*") - n, F.lit(0)).alias("evicted"))


def capture_limit(df: DataFrame, events: int | None = None, seconds: float | None = None) -> DataFrame:
    """The first events in order of time, or those of the first seconds."""
    if seconds is not None:
        start = df.agg(F.min("ts_ns").alias("_start"))
        df = df.join(F.broadcast(start), F.col("ts_ns") < F.col("_start") + int(seconds * 1e9)).drop("_start")
    return df.orderBy("ts_ns", "id").limit(events) if events is not None else df


def capture_sample(df: DataFrame, most: int = 100) -> DataFrame:
    """All rows if they are few, else the first and the last half of ``most``."""
    first, last = df.orderBy("ts_ns", "id").limit(most // 2), df.orderBy(F.desc("ts_ns"), F.desc("id")).limit(most // 2)
    few = df.orderBy("ts_ns", "id").limit(most + 1)
    size = few.agg(F.count("*").alias("_n"))
    all_rows = few.join(F.broadcast(size.filter(F.col("_n") <= most)), F.lit(True)).drop("_n")
    ends = first.unionByName(last).join(F.broadcast(size.filter(F.col("_n") > most)), F.lit(True)).drop("_n")
    return all_rows.unionByName(ends)


def event_context(df: DataFrame, target: int, n: int) -> DataFrame:
    """The n rows before and after one row of the same origin by id, itself left out; two top-n reads, no global rank."""
    at = F.broadcast(df.filter(F.col("id") == target).select(F.col("origin").alias("_origin")).limit(1))
    own = df.join(at, F.col("origin") == F.col("_origin"), "left_semi")
    return own.filter(F.col("id") < target).orderBy(F.desc("id")).limit(n).unionByName(own.filter(F.col("id") > target).orderBy("id").limit(n))


def protocol_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("transport").agg(F.count("*").alias("events"))


def time_range(df: DataFrame) -> DataFrame:
    return df.agg(F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))


def _bucket(n: int) -> Column:
    width = F.call_function("div", F.col("_last") - F.col("_first"), F.lit(n))
    return F.when(width > 0, F.least(F.call_function("div", F.col("ts_ns") - F.col("_first"), F.nullif(width, F.lit(0))), F.lit(n - 1))).otherwise(F.lit(0)).cast("int")


def bucketed(df: DataFrame, n: int, over: DataFrame | None = None) -> DataFrame:
    """df with bucket: one of n equal parts of the whole range of ``over``; a range of 0 is bucket 0."""
    ends = (df if over is None else over).agg(F.min("ts_ns").alias("_first"), F.max("ts_ns").alias("_last"))
    return df.join(F.broadcast(ends)).withColumn("bucket", _bucket(n)).drop("_first", "_last")


def time_buckets(df: DataFrame, n: int) -> DataFrame:
    """Counts of n buckets, empty ones with 0."""
    counts = bucketed(df.select("ts_ns"), n).groupBy("bucket").agg(F.count("*").alias("events"))
    every = df.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket"))
    return every.join(F.broadcast(counts), "bucket", "left").select("bucket", F.coalesce("events", F.lit(0)).alias("events"))


def protocol_timeline(df: DataFrame, n: int) -> DataFrame:
    return bucketed(df.select("ts_ns", "transport"), n).groupBy("transport", "bucket").agg(F.count("*").alias("events"))


def latency_heatmap(conversations: DataFrame, n: int) -> DataFrame:
    """Buckets of start by band of the time to the first response: 0 to 10, 50, 100 ms, and more."""
    timed = conversations.filter("ttfr_ns is not null").select(F.col("start_ns").alias("ts_ns"), "ttfr_ns")
    ms = F.col("ttfr_ns") / MS
    band = F.when(ms <= 10, 0).when(ms <= 50, 1).when(ms <= 100, 2).otherwise(3)
    return bucketed(timed, n).groupBy("bucket", band.alias("band")).agg(F.count("*").alias("conversations"))


def capture_metrics(df: DataFrame, condition: Column) -> DataFrame:
    """Totals, filtered share, warnings and rates over the whole range."""
    hit = F.coalesce(condition, F.lit(False))
    seconds = (F.max("ts_ns") - F.min("ts_ns")) / 1e9
    share = lambda part: F.coalesce(100.0 * part / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0))
    rate = lambda part: F.coalesce(part / F.nullif(seconds, F.lit(0.0)), F.lit(0.0))
    size, warned = F.coalesce(F.sum(fields.payload_size()), F.lit(0)), F.count_if(F.size("warnings") > 0)
    return df.agg(
        F.count("*").alias("events"), F.count_if(hit).alias("filtered"), share(F.count_if(hit)).alias("filtered_percent"), size.alias("bytes"), warned.alias("warned"),
        share(warned).alias("warning_percent"), rate(F.count("*")).alias("events_per_second"), rate(size).alias("bytes_per_second"),
    )


def channel_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.concat_ws("/", F.lit("events"), "adapter", "origin").alias("channel")).agg(F.count("*").alias("events"))


def session_summary(df: DataFrame) -> DataFrame:
    """Per channel, and for the session (channel null): count, first and last time."""
    named = df.select(F.concat_ws("/", F.lit("events"), "adapter", "origin").alias("channel"), "ts_ns")
    return named.rollup("channel").agg(F.count("*").alias("events"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))


def channel_sequence(df: DataFrame) -> DataFrame:
    """0-based number of each message in its channel.

    Messages are range-sorted by channel and time; a number is the count of the channel's rows in earlier
    parts and the place in the own one, so a channel with most of the messages is spread over many tasks.
    """
    channel = ["adapter", "origin"]
    parts = staged(df.select("*").repartitionByRange(*channel, "ts_ns", "id").withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy(*channel, "_part").agg(F.count("*").alias("_n"))  # one row for a part and channel in it
    earlier = Window.partitionBy(*channel).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*(F.col(c).alias(f"_{c}") for c in channel), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy(*channel, "_part").orderBy("ts_ns", "id")) - 1
    same = (F.col("_part") == F.col("_p")) & F.col("adapter").eqNullSafe(F.col("_adapter")) & F.col("origin").eqNullSafe(F.col("_origin"))
    return parts.withColumn("_place", place).join(starts, same).withColumn("channel_seq", (F.col("_start") + F.col("_place")).cast("int")).select(*df.columns, "channel_seq")


def conversation_stats(conversations: DataFrame) -> DataFrame:
    """Counts in all, by protocol, by state and by kind, in one pass."""
    sets = conversations.groupingSets([[], ["protocol"], ["state"], ["kind"]], "protocol", "state", "kind")
    return sets.agg(F.count("*").alias("conversations"))


def nearest_rank(df: DataFrame, value: str, percents: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Elements at round(p * (n - 1)), half away from zero, of the sorted values; 0 without rows.

    Values are counted first and ranks are running sums of counts, so repeated values cost one row. The sums
    run over parts first, then inside each; parts are cut at approximate quantiles of the group's
    different values, so that neither far outliers nor a large group fill one part.
    """
    by = by or []
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    cuts = counts.groupBy(*by).agg(F.percentile_approx(value, [k / CUTS for k in range(1, CUTS)], 1000).alias("_cuts"))
    cut = counts.join(cuts, by) if by else counts.join(F.broadcast(cuts))
    parts = cut.withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    sums = parts.groupBy(*by, "_part").agg(F.sum("_n").alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    starts = sums.select(*by, "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"), F.sum("_sum").over(whole).alias("_total"))
    inside = Window.partitionBy(*by, "_part").orderBy(value)
    ranked = parts.withColumn("_in", F.sum("_n").over(inside)).join(starts, [*by, "_part"])
    upto = F.col("_start") + F.col("_in")
    picks = [F.max(F.when((want := F.round(F.lit(p) * (F.col("_total") - 1)) + 1).between(upto - F.col("_n") + 1, upto), F.col(value))).alias(name) for name, p in percents.items()]
    out = ranked.groupBy(*by).agg(*picks)
    return out.na.fill(0, list(percents)) if not by else out


#: Parts of the values of a group, for running sums.
CUTS = 64
PERCENTS = {"p50_ns": 0.50, "p95_ns": 0.95, "p99_ns": 0.99}


def aggregate_metrics(conversations: DataFrame) -> DataFrame:
    """One row: conversations, error share, bytes, rate, and duration percentiles. The conversations are computed once."""
    conversations = staged(conversations.select("state", "start_ns", "end_ns", "duration_ns", "total_bytes"))
    seconds = (F.max("end_ns") - F.min("start_ns")) / 1e9
    n = F.count("*")
    sums = conversations.agg(
        n.alias("conversations"), F.coalesce(F.count_if(F.col("state") == "error") / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("error_rate"),
        F.coalesce(F.sum("total_bytes"), F.lit(0)).alias("total_bytes"), F.coalesce(n / F.nullif(seconds, F.lit(0.0)), F.lit(0.0)).alias("per_second"),
    )
    return sums.join(F.broadcast(nearest_rank(conversations, "duration_ns", PERCENTS)))


def capture_context(df: DataFrame, n: int = 100, samples: int = 5) -> DataFrame:
    """(key, values): sorted distinct metadata keys of the first n messages with their first sorted values; key null: their transports."""
    first = df.orderBy("ts_ns", "id").limit(n)
    pairs = first.select(F.explode(F.concat(F.map_entries("metadata"), F.array(F.struct(F.lit(None).cast("string").alias("key"), F.col("transport").alias("value"))))).alias("e"))
    listed = F.array_sort(F.collect_set("e.value"))
    return pairs.groupBy("e.key").agg(F.when(F.col("key").isNull(), listed).otherwise(F.slice(listed, 1, samples)).alias("values"))


def anomaly_summary(df: DataFrame) -> DataFrame:
    errors = F.count_if(predicates.protocol_error())
    return df.agg(
        F.count("*").alias("events"), F.count_distinct("transport").alias("transports"), errors.alias("errors"),
        F.coalesce(100.0 * errors / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("error_percent"),
    )


def capture_rates(stats: DataFrame) -> DataFrame:
    """From (received, bytes, drops_kernel, drops_channel, seconds) rows: totals, drop rate, packets and bits a second."""
    drops = F.sum("drops_kernel") + F.sum("drops_channel")
    rate = lambda part: F.coalesce(part / F.nullif(F.sum("seconds"), F.lit(0.0)), F.lit(0.0))
    return stats.agg(
        F.sum("received").alias("received"), drops.alias("drops"), F.coalesce(drops / F.nullif(F.sum("received") + drops, F.lit(0)), F.lit(0.0)).alias("drop_rate"),
        rate(F.sum("received")).alias("pps"), rate(8 * F.sum("bytes")).alias("bps"),
    )


#: Protocols that streams and datagrams have decoders for.
DECODED = ("gRPC", "ZMTP", "RTPS")


def pipeline_stats(headers: DataFrame) -> DataFrame:
    """Counts over parsed packets (operators.packets.packet_headers), their whole datagrams and their TCP streams; one row.

    A stream is a direction of a connection with data. Its first bytes decide once: it is encrypted if they begin a TLS handshake, decoded if they name
    a protocol with a decoder, else it falls back to raw messages; datagrams are decoded or not one by one. decrypted is 0, as no keys are taken.
    """
    whole = packets.whole_packets(headers)
    heads = detect.detect_best(packets.stream_heads(packets.tcp_segments(whole))).select("detected", "protocol")
    datagrams = detect.detect_best(whole.filter("protocol = 'udp' and error is null")).select("detected", "protocol")
    tcp, decoded = F.col("protocol") == "tcp", F.col("detected").isin(*DECODED)
    named = heads.unionByName(datagrams).agg(
        F.count_if(tcp).alias("tcp_streams"), F.count_if(~tcp).alias("udp_datagrams"), F.count_if(tcp & (F.col("detected") == "TLS")).alias("encrypted"), F.lit(0).cast("long").alias("decrypted"),
        F.count_if(decoded).alias("decoded"), F.count_if(~decoded).alias("fallback"),
    )
    counted = headers.agg(F.count("*").alias("packets_read"), F.count_if(F.col("error").isNotNull()).alias("packets_failed"), F.count_if((F.col("frag_offset") > 0) | F.col("more_fragments")).alias("fragments"))
    return counted.join(F.broadcast(named))  # one row each


def sequence_gaps(df: DataFrame, by: list[str], sequence: str = "sequence") -> DataFrame:
    """Per group: first, last and missing numbers of the distinct sequence."""
    gap = F.greatest(F.max(sequence) - F.min(sequence) + 1 - F.count_distinct(sequence), F.lit(0))
    return df.filter(F.col(sequence).isNotNull()).groupBy(*by).agg(F.min(sequence).alias("first_seq"), F.max(sequence).alias("last_seq"), gap.alias("gaps"))


def sequence_range(df: DataFrame, by: list[str], sequence: str = "sequence") -> DataFrame:
    out = sequence_gaps(df, by, sequence)
    return out.select(*by, F.concat_ws("..", F.col("first_seq").cast("string"), F.col("last_seq").cast("string")).alias("sequence_range"), F.when(F.col("gaps") > 0, F.col("gaps")).alias("gap_count"))


def payload_field_profile(df: DataFrame, by: list[str], payload: str = "payload") -> DataFrame:
    """Per group and field number: wire types, share of payloads with it, least and greatest value or size."""
    read = df.select(*by, wire_fields(payload).alias("_f")).filter("_f is not null")
    totals = read.groupBy(*by).agg(F.count("*").alias("_payloads"))
    each = read.withColumn("_row", F.monotonically_increasing_id()).select(*by, "_row", F.explode("_f").alias("f"))
    per = each.groupBy(*by, "_row", F.col("f.number").alias("number")).agg(F.collect_set("f.wire").alias("w"), F.min(F.coalesce("f.value", "f.size")).alias("low"), F.max(F.coalesce("f.value", "f.size")).alias("high"))
    out = per.groupBy(*by, "number").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("w")))).alias("wire_types"), F.count("*").alias("_have"), F.min("low").alias("low"), F.max("high").alias("high"))
    return out.join(totals, by).select(*by, "number", "wire_types", (F.col("_have") / F.col("_payloads")).alias("presence"), "low", "high")


def report_summary(df: DataFrame) -> DataFrame:
    """Per transport, and in all (transport null): events, times, events with warnings."""
    return df.rollup("transport").agg(F.count("*").alias("events"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"), F.count_if(F.size("warnings") > 0).alias("warned"))


def union_messages(*sources: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), sources)
