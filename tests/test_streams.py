"""Versioned tables, and streams that keep state: in any order of batches, after restarts, and with timers."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventlake.plans.versions import Conflict, VersionedTable
from eventlake.streaming import jobs, push

START = datetime(2024, 1, 1)


def test_upsert_is_atomic(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "k string, v long", "k", 4)
    rows = lambda *x: spark.createDataFrame(x, "k string, v long")
    got = lambda: {r.k: r.v for r in t.read().collect()}
    assert got() == {} and t.upsert(rows(("a", 1), ("b", 2), ("c", 3))) == 1
    assert t.upsert(rows(("b", 5), ("d", 4))) == 2 and got() == {"a": 1, "b": 5, "c": 3, "d": 4}
    # a crash between writing aside and the commit
    lost = t.prepare(rows(("a", 9)))
    assert got() == {"a": 1, "b": 5, "c": 3, "d": 4}
    # two writers of one version: the second fails and leaves the first's
    one, two = t.prepare(rows(("a", 10))), t.prepare(rows(("a", 11)))
    t.commit(*one)
    with pytest.raises(Conflict):
        t.commit(*two)
    with pytest.raises(Conflict):
        t.commit(*lost)
    assert got()["a"] == 10 and t.current()[0] == 3
    assert t.vacuum(1) > 0 and got() == {"a": 10, "b": 5, "c": 3, "d": 4}
    # an untouched bucket keeps its folder
    before = t.current()[1]
    t.upsert(rows(("a", 12)))
    assert sum(before[b] != f for b, f in t.current()[1].items()) == 1


def landed(spark, top, files, schema, **options):
    """A stream of files that land one after the other, one a batch."""
    os.makedirs(top, exist_ok=True)
    for i, rows in files:
        path = f"{top}/{i}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        for f in os.listdir(path):
            os.utime(f"{path}/{f}", (1e9 + i, 1e9 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(top)


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1)])
def test_late_reports_merge_in_any_order(spark, tmp_path, order):
    r = random.Random(3)
    rows = [(r.choice(["e1", "e2", "e3", None]), START + timedelta(hours=r.randrange(100)), r.randrange(9), f"t{r.randrange(99)}", r.random() < 0.9) for _ in range(60)]
    schema = "event string, ts timestamp, importance long, title string, fine boolean"
    parts = [rows[:20], rows[20:40], rows[40:] + rows[:5]]
    stream = landed(spark, str(tmp_path / "in"), [(i, parts[k]) for i, k in enumerate(order)], schema)
    t = VersionedTable(spark, str(tmp_path / "t"), jobs.EVENT, "event", 4)
    jobs.ingest_reports(stream, t, F.col("fine"), str(tmp_path / "c"))
    want = {}
    for e, ts, n, title, fine in rows:
        if e and fine:
            want.setdefault(e, []).append((ts, title, n))
    assert {x.event: (x.first_seen, x.last_seen, x.importance, x.title) for x in t.read().collect()} == {e: (min(x)[0], max(x)[0], max(y[2] for y in x), min(x)[1]) for e, x in want.items()}
    assert t.current()[0] == 3


def clicks(times):
    return [(i, 1, "view", START + timedelta(seconds=s)) for i, s in times]


def test_click_state_survives_restarts_and_is_forgotten(spark, tmp_path):
    schema, day = "event_id long, user_id long, event_type string, ts timestamp", 86400
    files = [(0, clicks([(1, 0), (2, 1)])), (1, clicks([(3, 2), (4, 5)])), (2, [(9, 2, "view", START + timedelta(days=4))]), (3, [(10, 2, "view", START + timedelta(days=5))]), (4, clicks([(5, 6)]))]

    def run(upto):
        top = str(tmp_path / "in")
        new = [f for f in files[:upto] if not os.path.exists(f"{top}/{f[0]}")]
        stream = landed(spark, top, new, schema).withWatermark("ts", "10 days")
        with jobs.rocks(spark):
            jobs.click_dedup(stream, 3000, "1 day").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return {x.event_id for x in spark.read.parquet(str(tmp_path / "out")).collect()}

    assert run(1) == {1}
    # another run goes on from the state: 2 s after the last kept one
    assert run(2) == {1, 4}
    # 1 s after the last kept one, while the watermark hasn't passed the time to live
    assert run(5) == {1, 4, 9, 10}


def test_click_state_is_gone_after_its_time_to_live(spark, tmp_path):
    schema = "event_id long, user_id long, event_type string, ts timestamp"
    # the gap is longer than the time to live, so that only forgetting lets the last click through
    files = [(0, clicks([(1, 0)])), (1, [(9, 2, "view", START + timedelta(days=3))]), (2, [(10, 2, "view", START + timedelta(days=30))]), (3, [(12, 1, "view", START + timedelta(days=29, hours=12))])]
    stream = landed(spark, str(tmp_path / "in"), files, schema).withWatermark("ts", "1 day")
    with jobs.rocks(spark):
        jobs.click_dedup(stream, 40 * 86_400_000, "1 day").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert {x.event_id for x in spark.read.parquet(str(tmp_path / "out")).collect()} >= {1, 9, 12}


def test_push_stream_as_polls(spark, tmp_path):
    r = random.Random(5)
    schema = "event_id string, polled timestamp, baseline boolean, importance int, recommended boolean, discovered timestamp, outcome string"
    events = {f"e{i}": START + timedelta(hours=r.randrange(-60, 90)) for i in range(60)}
    polls, state, now = [], None, None
    for k in range(6):
        now = START + timedelta(hours=12 * k)
        rows = [(e, now, k == 0, r.randrange(90), r.random() < 0.5, at, None) for e, at in events.items() if at <= now and r.random() < 0.8]
        polls.append((k, rows))
        feed = spark.createDataFrame([(x[0], x[3], x[4], x[5]) for x in rows], "event_id string, importance int, recommended boolean, discovered timestamp")
        at = F.lit(now)
        state = push.baseline(feed, at) if k == 0 else push.advance(state, feed, at)
        state = spark.createDataFrame(state.collect(), push.STATE)
    want = {x.event_id: x.status for x in state.collect()}
    stream = landed(spark, str(tmp_path / "in"), [*polls, (6, [("clock", now + timedelta(hours=1), False, 0, False, None, None)]), (7, [("clock", now + timedelta(days=9), False, 0, False, None, None)]), (8, [("clock", now + timedelta(days=10), False, 0, False, None, None)])], schema).withWatermark("polled", "0 seconds")
    with jobs.rocks(spark):
        push.push_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    rows = [x for x in spark.read.parquet(str(tmp_path / "out")).orderBy("at").collect() if x.event_id != "clock"]
    by_poll, last = {}, {}
    for x in rows:
        last[x.event_id] = x.status
        if x.at <= now:
            by_poll[x.event_id] = x.status
    pending = {e for e, s in want.items() if s == "pending"}
    # what grew too old while it was pending is expired at once here, not only seen at the next poll
    too_old = {e for e, s in by_poll.items() if s == "expired" and want[e] != s and events[e] + timedelta(hours=48) < now}
    assert len(too_old) < 10
    assert {e: s for e, s in by_poll.items() if e not in too_old} == {e: s for e, s in want.items() if e not in too_old}
    pending -= too_old
    # nobody polls any more, and what was pending has expired
    assert pending and all(last[e] == "expired" for e in pending)
