"""Task states as a stream: the same as the batch query for any order of events, and expiry by event time."""

import random
from datetime import datetime, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st

from folioframe.operators import tasks
from folioframe.streaming import arrivals, lifecycle

EVENT = "task_id string, status string, ts timestamp"
BEGIN = datetime(2024, 3, 1)


def at(minutes):
    return BEGIN + timedelta(minutes=minutes)


events = st.lists(st.tuples(st.integers(0, 5), st.sampled_from(["uploaded", "processing", "completed", "failed"])), min_size=1, max_size=9)


@settings(max_examples=200, deadline=None)
@given(events, st.randoms())
def test_order_and_repeats_do_not_matter(log, shuffle):
    whole = lifecycle.merged(None, log)
    again = log * 2
    shuffle.shuffle(again)
    cut = shuffle.randrange(len(again))
    state = lifecycle.merged(None, again[:cut]) if cut else None
    assert lifecycle.merged(state, again[cut:]) == whole
    ends = sorted(e for e in log if e[1] in tasks.END_STATES)
    assert whole[:2] == (ends[0] if ends else (None, None)) and whole[2] == max(t for t, _ in log)


def stream_of(spark, folder, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(f"{folder}/in/{k:03d}")
    return arrivals.arriving(spark, f"{folder}/in/*", EVENT, 1)


def test_a_replayed_log_gives_the_states_of_the_batch(spark, tmp_path):
    """Events late within the hour, twice, in any order, in many batches, and rows with nulls."""
    draw = random.Random(4)
    log = [(f"t{draw.randrange(40)}", draw.choice(["uploaded", "processing", "processing", "completed", "failed"]), at(draw.randrange(600))) for _ in range(300)]
    log.sort(key=lambda e: e[2] + timedelta(minutes=draw.randrange(50)))
    log += draw.sample(log[-40:], 20)
    nulls = [(None, "completed", at(3)), ("t1", None, at(4)), ("t2", "failed", None)]
    stream = stream_of(spark, tmp_path, [log[k : k + 60] for k in range(0, len(log), 60)] + [nulls])
    changes = lifecycle.replayed(stream, f"{tmp_path}/out", f"{tmp_path}/cp", "2 hours")
    want = {tuple(r) for r in tasks.latest_states(spark.createDataFrame(log, EVENT)).select("task_id", "status", "ts").collect()}
    assert {tuple(r) for r in lifecycle.current(changes).collect()} == want
    rows = changes.collect()
    assert len({(r.task_id, r.version) for r in rows}) == len(rows) and max(r.version for r in rows) > 1


def test_tasks_expire_days_after_their_last_event(spark, tmp_path):
    day = 24 * 60
    batches = [
        [("old", "uploaded", at(0)), ("kept", "uploaded", at(0))],
        [("kept", "processing", at(5 * day)), ("old", "completed", at(10))],
        [("new", "uploaded", at(8 * day + 30))],  # the old task's days are over, the kept one's last event is three days ago
        [("old", "uploaded", at(9 * day))],  # it comes back as a new task
    ]
    changes = lifecycle.replayed(stream_of(spark, tmp_path, batches), f"{tmp_path}/out", f"{tmp_path}/cp", "10 minutes")
    old = [(r.status, r.version) for r in changes.filter("task_id = 'old'").orderBy("batch", "version").collect()]
    assert old == [("uploaded", 1), ("completed", 2), ("expired", 3), ("uploaded", 4)]
    assert {(r.task_id, r.status) for r in lifecycle.current(changes).collect()} == {("old", "uploaded"), ("kept", "processing"), ("new", "uploaded")}


def test_a_restart_goes_on_where_the_stream_stopped(spark, tmp_path):
    stream = stream_of(spark, tmp_path, [[("a", "uploaded", at(0))]])
    lifecycle.replayed(stream, f"{tmp_path}/out", f"{tmp_path}/cp")
    spark.createDataFrame([("a", "completed", at(5)), ("a", "processing", at(3))], EVENT).coalesce(1).write.parquet(f"{tmp_path}/in/900")
    changes = lifecycle.replayed(arrivals.arriving(spark, f"{tmp_path}/in/*", EVENT, 1), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert [(r.status, r.version) for r in changes.filter("status <> 'expired'").orderBy("version").collect()] == [("uploaded", 1), ("completed", 2)]


def test_batch_states_do_not_depend_on_order(spark):
    rows = [("a", "processing", at(1)), ("a", "uploaded", at(1)), ("b", "failed", at(2)), ("b", "completed", at(2)), ("b", "completed", at(1)), ("c", "x", at(0))]
    for r in (rows, rows[::-1]):
        assert {(x.task_id, x.status) for x in tasks.latest_states(spark.createDataFrame(r, EVENT)).collect()} == {("a", "processing"), ("b", "completed"), ("c", "x")}
