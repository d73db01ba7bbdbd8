"""Streams run to the end of their input, against the batch forms over the same rows."""

import pytest
from pyspark.sql import functions as F

from tracelake.operators import packets
from tracelake.plans import queries, views
from tracelake.streaming import jobs

SEGMENTS = "flow string, dir int, rel long, payload binary, rst boolean, ts_us long"


@pytest.fixture()
def streamed(spark):
    """The bytes of (flow, rel, payload, rst, second) rows: {(flow, start of a run): bytes}."""

    def run(*rows):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        df = spark.createDataFrame([(f, 0, rel, data, rst, (86400 + s) * 1_000_000) for f, rel, data, rst, s in rows], SEGMENTS).withColumn("ts", F.timestamp_micros("ts_us"))
        out = queries._drained(df, jobs.stream_reassemble, flow=F.lit("closing"), dir=F.lit(0), rel=F.lit(0), rst=F.lit(False)).orderBy("flow", "start").collect()
        runs, at = {}, None
        for r in out:
            at = (r.flow, r.start) if r.gap_before or at is None or at[0] != r.flow else at
            runs[at] = runs.get(at, b"") + bytes(r.data)
        return runs

    return run


def test_large_gap_is_filled_late(streamed):
    part = 1 << 19
    late = [("f", (1 + k) * part, bytes([65 + k]) * part, False, k) for k in range(4)]
    assert streamed(*late, ("f", 0, b"." * part, False, 8)) == {("f", 0): b"." * part + b"".join(r[2] for r in late)}


def test_timer_and_reset_emit_held_segments(streamed):
    got = streamed(("idle", 5, b"late", False, 0), ("rst", 7, b"held", True, 1), ("long", 3, b"ab", False, 1), ("long", 3, b"abcd", False, 2))
    assert got == {("idle", 5): b"late", ("rst", 7): b"held", ("long", 3): b"abcd"}


def test_all_runs_come_out(spark, sf_dir):
    got = {(r.flow, r.run, r.start, r.size) for r in queries.QUERIES["stream_reassemble_runs"](spark, sf_dir).collect()}
    batch = packets.tcp_reassemble(views.segments(spark, sf_dir)).collect()
    assert got == {(str(r.flow), r.run, r.start, r.size) for r in batch} and any(r.run for r in batch)


def test_idle_counts_every_message(spark, sf_dir):
    got = {(r.flow, r.sessions, r.packets) for r in queries.QUERIES["stream_idle"](spark, sf_dir).collect()}
    batch = jobs.stream_idle(queries._timed(views.messages(spark, sf_dir))).groupBy("flow").agg(F.count("*").alias("sessions"), F.sum("packets").alias("packets"))
    assert got == {(r.flow, r.sessions, r.packets) for r in batch.collect()}
    assert sum(n for _, _, n in got) == views.messages(spark, sf_dir).count()


def test_many_flows_go_on_from_tables(spark, tmp_path):
    """A micro-batch is one join of tables, no calls for each flow: batches go on from each other, a repeated one writes the same, late rows go."""
    form = jobs.stream_reassemble(None)

    def step(number, *rows):
        df = spark.createDataFrame([(f, 0, rel, data, False, (86400 + s) * 1_000_000) for f, rel, data, s in rows], SEGMENTS).withColumn("ts", F.timestamp_micros("ts_us"))
        form._step(df, number, f"{tmp_path}/out", f"{tmp_path}/table")
        made = spark.read.parquet(f"{tmp_path}/out/batch={number}").collect()
        return {(r.flow, r.start, bytes(r.data), r.gap_before) for r in made}

    many = [(f"n{k}", 0, b"z", 0) for k in range(2000)]
    assert step(0, ("f", 0, b"ab", 0), ("f", 5, b"fg", 0), *many) == {("f", 0, b"ab", False)} | {(f, 0, b"z", False) for f, *_ in many}
    for _ in range(2):
        assert step(1, ("f", 1, b"bcde", 1)) == {("f", 2, b"cde", False), ("f", 5, b"fg", False)}
    assert step(2, ("g", 3, b"x", 100)) == set()
    assert step(3, ("g", 0, b"late", 50), ("h", 0, b"y", 200)) == {("g", 3, b"x", True), ("h", 0, b"y", False)}
