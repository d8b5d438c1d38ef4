"""Streams with state, run in several batches, against brute force."""

from __future__ import annotations

import datetime as dt

import pytest

from arborframe.streaming import events as E
from arborframe.streaming import state

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"
START = dt.datetime(2024, 1, 1)


def _event(i, hours, user, value=1.0, kind="view"):
    return (i, START + dt.timedelta(hours=hours) if hours is not None else None, user, kind, value)


@pytest.fixture
def feed(spark, tmp_path):
    """Writes a batch of events and returns the stream of their folder."""

    def put(rows, folder="in"):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{folder}")
        return spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/{folder}")

    return put


def test_totals_go_on_over_batches_and_runs(feed, tmp_path):
    hot = [_event(i, i, 1, 0.1) for i in range(300)]
    batches = [[*hot, _event(900, 1, None, None)], [_event(901, 2, 2, -1.5), _event(902, 3, None, 2.0)], [_event(903, None, 1, None)]]
    for rows in batches:
        got = state.totals(feed(rows), "user_id", f"{tmp_path}/out", ttl=3_600_000)
    assert {r["user_id"]: (r["n"], float(r["total"])) for r in got.collect()} == {1: (301, 30.0), None: (2, 2.0), 2: (1, -1.5)}


def test_totals_are_forgotten(feed, tmp_path):
    """With a millisecond to live, the second batch finds nothing of the first; a key that stays away keeps what it showed."""
    state.totals(feed([_event(1, 0, 1, 5.0), _event(2, 0, 2, 7.0)]), "user_id", f"{tmp_path}/out", ttl=1, parts=1)
    got = state.totals(feed([_event(3, 1, 1, 2.0)]), "user_id", f"{tmp_path}/out", ttl=1, parts=1)
    assert {r["user_id"]: (r["n"], float(r["total"])) for r in got.collect()} == {1: (1, 2.0), 2: (1, 7.0)}


def test_totals_of_many_keys_share_states(feed, tmp_path, monkeypatch):
    """Keys that share a bucket are counted on their own over batches, the null key too."""
    monkeypatch.setattr(state, "BUCKETS", 2)
    for k in range(2):
        got = state.totals(feed([_event(1000 * k + i, i % 24, i % 50 or None, 0.5) for i in range(200)]), "user_id", f"{tmp_path}/out", ttl=3_600_000)
    assert {r["user_id"]: (r["n"], float(r["total"])) for r in got.collect()} == {i or None: (8, 4.0) for i in range(50)}


def test_join_over_batches(feed, tmp_path):
    """Pairs meet across batches on either side, at both ends of the span; null keys and times meet nothing."""
    first = [[_event(1, 0, 1), _event(2, 5, 1), _event(3, 1, None), _event(4, None, 1)], [_event(5, 20, 1), _event(6, 20, 2)]]
    then = [[_event(11, 0, 1), _event(12, 1, None), _event(13, 20, 2)], [_event(14, 10, 1), _event(15, 19, 2), _event(16, 10.01, 1), _event(16, 10.01, 1)]]
    for a, b in zip(first, then):
        got = state.followed(feed(a, "a"), feed(b, "b"), "user_id", "10 hours", "3 days", f"{tmp_path}/out")
    want = sorted(
        (x[0], y[0]) for x in sum(first, []) for y in sum(then, [])
        if x[2] == y[2] is not None and x[1] and y[1] and x[1] <= y[1] <= x[1] + dt.timedelta(hours=10)
    )
    assert sorted((r["first_id"], r["then_id"]) for r in got.collect()) == want and (1, 14) in want and (6, 13) in want


def test_join_drops_what_is_too_late(feed, tmp_path):
    """Once the watermark has passed, a row of long ago meets nothing, though its partner was there."""
    state.followed(feed([_event(1, 0, 1)], "a"), feed([_event(2, 1, 1)], "b"), "user_id", "2 hours", "1 hour", f"{tmp_path}/out")
    state.followed(feed([_event(3, 100, 2)], "a"), feed([_event(4, 100, 2)], "b"), "user_id", "2 hours", "1 hour", f"{tmp_path}/out")
    got = state.followed(feed([_event(5, 0.5, 1)], "a"), feed([_event(6, 101, 2)], "b"), "user_id", "2 hours", "1 hour", f"{tmp_path}/out")
    assert sorted((r["first_id"], r["then_id"]) for r in got.collect()) == [(1, 2), (3, 4), (3, 6)]


def test_late_rows_are_kept_aside(feed, tmp_path):
    batches = [[_event(1, 48, 1), _event(2, 0, 1), _event(3, None, 1)], [_event(4, 23.9, 1), _event(5, 24, 1), _event(6, None, 1)], [_event(7, 100, 1), _event(8, 10, 1)]]
    for rows in batches:
        got = state.with_late(feed(rows), "1 day", f"{tmp_path}/out")
    assert {r["event_id"]: (r["batch"], r["late"]) for r in got.collect()} == {
        1: (0, False), 2: (0, False), 3: (0, False), 4: (1, True), 5: (1, False), 6: (1, False), 7: (2, False), 8: (2, True)
    }
    again = state.with_late(feed([]), "1 day", f"{tmp_path}/out")  # nothing new
    assert again.count() == 8


def test_first_seen_in_several_batches(feed, tmp_path):
    """The first of each key comes out, repeats within the delay do not, whichever batch they are in."""
    out = []
    for rows in ([_event(1, 0, 1), _event(2, 0.01, 1), _event(3, 0, 2)], [_event(4, 0.02, 1), _event(5, 0.05, 3)], [_event(6, 0.06, 2), _event(7, 0.1, 4)]):
        firsts = E.first_seen(feed(rows), "user_id")
        query = firsts.writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True)
        query.foreachBatch(lambda batch, k: out.extend(r["user_id"] for r in batch.select("user_id").collect())).start().awaitTermination()
    assert sorted(out) == [1, 2, 3, 4]
