"""Structured Streaming forms: filters, recent rows, idle flows, reassembly, routing, counters, timeline."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.operators import packets, scan
from tracelake.plans.shared import staged

IDLE = "30 seconds"


def stream_filter(stream: DataFrame, condition: Column) -> DataFrame:
    return stream.filter(condition)


def stream_recent(stream: DataFrame, folder: str, n: int):
    """A writer that keeps the newest n rows in two alternating folders, ``folder/0`` and ``folder/1``.

    Every micro-batch reads the table of the one before (at most n rows) and writes its own over the one before that,
    so a repeated batch overwrites its own result and the disk holds two tables. Batch k is in folder k % 2.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("_batch", F.lit(number))
        if number:
            new = new.unionByName(spark.read.parquet(f"{folder}/{(number - 1) % 2}"))
        new.orderBy(F.desc("ts_ns"), F.desc("id")).limit(n).write.mode("overwrite").parquet(f"{folder}/{number % 2}")

    return stream.writeStream.foreachBatch(step)


def stream_idle(stream: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """(flow, first, last, packets, last_out, last_in) of flows, closed once 30 s pass without a packet either way.

    stream has flow, ts and direction (outbound or inbound); the last two are the last times of each direction.
    """
    w = stream.withWatermark("ts", delay)
    last = lambda way: F.max(F.when(F.col("direction") == way, F.col("ts")))
    return w.groupBy("flow", F.session_window("ts", IDLE)).agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("packets"), last("outbound").alias("last_out"), last("inbound").alias("last_in")
    )


def stream_timeline(stream: DataFrame, width: str, delay: str) -> DataFrame:
    """Counts per transport and tumbling window; rows later than the delay are dropped."""
    return stream.withWatermark("ts", delay).groupBy("transport", F.window("ts", width)).agg(F.count("*").alias("events"))


def stream_route(stream: DataFrame) -> DataFrame:
    """Parsed packets of whole datagrams, shuffled by flow; fragments are counted by stream_stats and dropped here."""
    parsed = packets.packet_headers(stream)
    return parsed.filter("flow is not null and error is null").repartition("flow")


COUNTERS = ("received", "normalised", "routed", "fragments", "errors")


def stream_stats(parsed: DataFrame, folder: str):
    """A writer that counts every micro-batch of parsed packets into folder: received, normalised, routed, fragments, errors.

    A batch has a folder of its own, which a repeated batch writes over, so totals (stats_totals) count every packet once, whatever
    restarts lie between; nothing is kept by the driver.
    """
    conditions = (F.lit(True), F.col("error").isNull(), F.col("flow").isNotNull() & F.col("error").isNull(), (F.col("frag_offset") > 0) | F.col("more_fragments"), F.col("error").isNotNull())
    counted = [F.count_if(c).alias(n) for n, c in zip(COUNTERS, conditions, strict=True)]

    def step(batch: DataFrame, number: int) -> None:
        batch.agg(*counted).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return parsed.writeStream.foreachBatch(step)


def stats_totals(spark, folder: str) -> DataFrame:
    """One row with the sums of all batches that stream_stats has counted into folder."""
    table = spark.read.schema(", ".join(f"{c} long" for c in (*COUNTERS, "batch"))).parquet(folder)
    return table.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS))


def stream_load(spark, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files read some files at a time; progress is the query's lastProgress."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


REASSEMBLED = T.StructType([
    T.StructField("flow", T.StringType()), T.StructField("dir", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("data", T.BinaryType()),
    T.StructField("gap_before", T.BooleanType()),
])
IDLE_MS = 30_000
_SIDE = ["flow", "dir"]
_HELD = "flow string, dir int, rel long, payload binary, next long, last_ms long"


@dataclass(frozen=True)
class Reassembly:
    """Emits the contiguous bytes of a flow's direction as they become so; the rest after 30 idle seconds or a reset.

    State: a table of each direction's next offset and last time (rel null) and of the segments that wait. Every micro-batch
    joins the table of the one before and writes its own over the one before that, so a repeated batch overwrites its own results. Its work is
    a few shuffles whatever the number of flows, and running values spread one busy direction over all tasks.
    """

    stream: DataFrame
    delay: str
    schema: T.StructType = REASSEMBLED

    def writer(self, out: str, table: str):
        """A writer of rows of schema into out, a folder for each batch, with its state in table."""
        return self.stream.writeStream.foreachBatch(lambda batch, number: self._step(batch, number, out, table))

    def _step(self, batch: DataFrame, number: int, out: str, table: str) -> None:
        spark = batch.sparkSession
        before, after = f"{table}/{(number + 1) % 2}", f"{table}/{number % 2}"
        held = spark.read.schema(_HELD).parquet(f"{before}/held") if number else spark.createDataFrame([], _HELD)
        mark = spark.read.parquet(f"{before}/mark").first()[0] if number else None
        passed = batch.agg(F.unix_millis(F.max("ts") - F.expr(f"INTERVAL {self.delay}"))).first()[0]
        marks = [x for x in (mark, passed) if x is not None]
        new = batch.select(*_SIDE, F.col("rel").cast("long").alias("rel"), "payload", F.unix_millis("ts").alias("last_ms"), F.coalesce("rst", F.lit(False)).alias("rst"))
        if mark is not None:
            new = new.filter(F.coalesce(F.col("last_ms") > mark, F.lit(True)))
        rows = _placed(held.withColumn("rst", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)), allowMissingColumns=True), max(marks, default=None))
        rows.filter(F.col("out")).select(*_SIDE, "start", "data", F.col("gap").alias("gap_before")).write.mode("overwrite").parquet(f"{out}/batch={number}")
        reached = F.max(F.when(F.col("rel").isNull() | F.col("open"), F.col("reach")))
        heads = rows.groupBy(*_SIDE).agg(F.bool_or("rst").alias("rst"), F.bool_or("idle").alias("idle"), reached.alias("next"), F.max("last_ms").alias("last_ms")).filter("not idle")
        heads = heads.select(*_SIDE, F.when(F.col("rst"), 0).otherwise(F.col("next")).cast("long").alias("next"), "last_ms")
        waiting = rows.filter("rel is not null and not out").select(*_SIDE, "rel", "payload")
        waiting.unionByName(heads, allowMissingColumns=True).write.mode("overwrite").parquet(f"{after}/held")
        spark.createDataFrame([(max(marks, default=None),)], "mark long").write.mode("overwrite").parquet(f"{after}/mark")


def _placed(rows: DataFrame, mark: int | None) -> DataFrame:
    """Held and new rows as one row for each direction (rel null) and one for each segment with fresh bytes: start, data, gap, and whether it comes out.

    Of equal offsets the held bytes stand, then those that came first; a longer segment adds what lies beyond them. An overlap is cut from the later.
    """
    sides = rows.groupBy(*_SIDE).agg(F.coalesce(F.max("next"), F.lit(0)).alias("next"), F.max("last_ms").alias("last_ms"), F.bool_or("rst").alias("rst"))
    idle = F.coalesce("last_ms", F.lit(0)) + IDLE_MS <= mark if mark is not None else F.lit(False)
    size, beyond = F.octet_length("payload"), 1 << 30
    grown = lambda have, p: F.when(F.octet_length(p["payload"]) > F.octet_length(have), F.concat(have, F.substring(p["payload"], F.octet_length(have) + 1, F.lit(beyond)))).otherwise(have)
    listed = F.sort_array(F.collect_list(F.struct(F.coalesce("_new", F.lit(False)), "last_ms", "payload")))
    segments = rows.filter(size > 0).groupBy(*_SIDE, "rel").agg(F.aggregate(listed, F.lit(b""), grown).alias("payload"))
    parts = scan.dealt(sides.withColumn("idle", idle).unionByName(segments, allowMissingColumns=True), _SIDE, ["rel"])
    head = F.col("rel").isNull()
    parts = parts.withColumn("reach", F.when(head, F.col("next")).otherwise(F.col("rel") + size))
    seen = scan.running(parts, _SIDE, ["rel"], _reach=("max", F.col("reach")), _all=("first", F.when(head, F.col("rst") | F.col("idle"))))
    over = F.least(F.greatest(F.col("_reach") - F.col("rel"), F.lit(0)), size).cast("int")
    fresh = seen.withColumns({"start": F.col("rel") + over, "data": F.substring("payload", over + 1, size), "gap": F.coalesce(F.col("rel") > F.col("_reach"), F.lit(False))})
    numbered = scan.running(fresh.filter(head | (F.octet_length("data") > 0)), _SIDE, ["rel"], _holes=("sum", F.col("gap").cast("int")))
    opened = ~F.col("gap") & (F.col("_holes") == 0)
    return staged(numbered.withColumn("open", opened).withColumn("out", ~head & (F.col("open") | F.col("_all"))).drop("_reach", "_all", "_holes", scan.PART))


def stream_reassemble(stream: DataFrame, delay: str = "10 seconds") -> Reassembly:
    """Reassembly across micro-batches of (flow, dir, rel, payload, rst, ts); rows later than the delay are dropped."""
    return Reassembly(stream, delay)
