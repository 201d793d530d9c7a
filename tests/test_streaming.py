"""Streams over a small event table, drained at once."""

import datetime

import pytest

from corvane.streaming import streams


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    import pyarrow as pa
    import pyarrow.parquet as pq

    start = datetime.datetime(2024, 1, 1)
    kinds = ["error"] * 10 + ["click"] + ["click"] * 2
    seconds = [*range(10), 20, 75, 76]
    rows = {"event_id": list(range(13)), "ts": [start + datetime.timedelta(seconds=s) for s in seconds], "user_id": [1] * 13, "event_type": kinds, "value": [1.0] * 13, "props": ["{}"] * 13}
    place = tmp_path_factory.mktemp("events")
    pq.write_table(pa.table(rows).cast(pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()), ("event_type", pa.string()), ("value", pa.float64()), ("props", pa.string())])), f"{place}/events.parquet")
    return str(place)


def test_breaker_opens_and_lets_one_through(spark, folder):
    got = {r["event_id"]: r["state"] for r in streams.drained(streams.breaker(streams.event_stream(spark, folder)), "t").collect()}
    assert [got[n] for n in range(13)] == ["closed"] * 10 + ["open", "half_open", "closed"]


def test_marks_count_once(spark, folder):
    got = streams.drained(streams.marked_once(streams.event_stream(spark, folder)).select("user_id", "event_type"), "t").collect()
    assert sorted(map(tuple, got)) == [(1, "click"), (1, "error")]


def test_sessions_close_behind_the_watermark(spark, folder):
    got = streams.drained(streams.debounced(streams.event_stream(spark, folder), "5 seconds", "1 second"), "t").collect()
    assert sorted(r["n"] for r in got) == [1, 10]
