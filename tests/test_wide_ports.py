"""Messages of many users: ports above 65535, and ports of a frame that fall on known ones, against the SQL."""

import duckdb
import pytest

from tracelake.plans import queries

NAMED = ["addr_ip", "port_either", "tcp_ports", "resolve_field", "packet_headers", "flow_key", "partition_by_flow", "tcp_orient", "stream_route", "detect_port", "detect_best_packets", "detect_best", "detect_override", "pipeline_stats"]


@pytest.fixture(scope="module")
def wide(sf_dir, tmp_path_factory):
    """The events of the smallest tables for four groups of users, with their first ids at 0, 30000, 48880 and 78400."""
    path = tmp_path_factory.mktemp("wide")
    copies = "(VALUES (0, 0), (1, 30000), (2, 48880), (3, 78400)) t(c, u)"
    duckdb.sql(f"COPY (SELECT * REPLACE (event_id + 1000 * c AS event_id, user_id + u AS user_id) FROM '{sf_dir}/events.parquet', {copies}) TO '{path}/events.parquet' (FORMAT parquet)")
    return str(path)


@pytest.mark.parametrize("name", NAMED)
def test_ports_beyond_the_field(spark, wide, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{wide}/events.parquet'")
    df = queries.QUERIES[name](spark, wide)
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({queries.SQL[name]}) q").fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


@pytest.fixture(scope="module")
def crowded(sf_dir, tmp_path_factory):
    """Four groups of users at the same times. Users 16 and 600266 are between the same hosts, and their ports 40016 and 640266 begin with the same four hex digits."""
    path = tmp_path_factory.mktemp("crowded")
    copies = "(VALUES (0, 2), (1, 600252), (2, 48880), (3, 78400)) t(c, u)"
    duckdb.sql(f"COPY (SELECT * REPLACE (event_id + 1000 * c AS event_id, user_id + u AS user_id) FROM '{sf_dir}/events.parquet', {copies}) TO '{path}/events.parquet' (FORMAT parquet)")
    return str(path)


@pytest.mark.parametrize("name", ["streams_to_messages", "tcp_idle"])
def test_flows_of_the_messages_ends(spark, crowded, name):
    test_ports_beyond_the_field(spark, crowded, name)


def test_datagrams_of_one_moment(spark, sf_dir, tmp_path):
    """Users with the same addresses send at the same times; every datagram comes out of its fragments."""
    duckdb.sql(f"COPY (SELECT * REPLACE (event_id + 64000 * c AS event_id, user_id + 1750 * c AS user_id) FROM '{sf_dir}/events.parquet', range(3) t(c)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    df = queries.QUERIES["pipeline_stats"](spark, str(tmp_path))
    assert [tuple(r) for r in df.collect()] == con.sql(f"SELECT {', '.join(df.columns)} FROM ({queries.SQL['pipeline_stats']}) q").fetchall()
