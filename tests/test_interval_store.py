"""Stored intervals against pairing all events again, day by day."""

import random
from datetime import date, datetime, timedelta

import pytest

from fleetlens.functions import vocab as V
from fleetlens.functions.time import WindowSpec
from fleetlens.operators import intervals, joins
from fleetlens.sources.interval_store import IntervalStore
from fleetlens.sources.tables import write_model
from helpers import rows

EVENT = (
    "source_schema string, source_table string, source_ods_row_id bigint, source_event_part string, event_time timestamp, "
    "robot_code string, queue_id string, event_type string, event_status string"
)
QUEUE = "queue_id string, queue_start_time timestamp, event_time timestamp"
DAY0 = datetime(2026, 7, 20)
DAYS = 9


def moment(rng, low=0.0, high=float(DAYS)):
    return DAY0 + timedelta(minutes=int(rng.uniform(low, high) * 1440))


def fleet(seed, n=60):
    """Executions over several days, unclosed ones, repeated and early parts, and queue records with and without a start."""
    rng = random.Random(seed)
    events, queue = [], []
    source = (V.EVENT_SOURCE_SCHEMA, V.EXECUTION_SOURCE_TABLE)

    def add(row_id, part, at, robot, queue_id):
        events.append((*source, row_id, part, at, robot, queue_id, None, None))

    for i in range(n):
        robot, queue_id = rng.choice("ABC"), f"q{rng.randrange(n // 2)}" if rng.random() < 0.9 else None
        start = moment(rng)
        add(i, "START", start, robot, queue_id)
        kind = rng.random()
        if kind < 0.75:
            add(i, "END", start + timedelta(minutes=rng.choice([0, 5, 300, 1440, 4000])), rng.choice("ABC"), queue_id)
        if kind < 0.1:  # a second END, days later
            add(i, "END", start + timedelta(minutes=7000), robot, queue_id)
        if 0.1 < kind < 0.2:  # a second START by another robot
            add(i, "START", start + timedelta(minutes=rng.choice([3, 3000])), rng.choice("ABC"), queue_id)
        if 0.2 < kind < 0.3:  # an END before the START
            add(i, "END", start - timedelta(minutes=90), robot, queue_id)
    add(9001, "END", moment(rng), "A", "q1")
    events.append(("other", "table", 1, "START", moment(rng), "A", "q1", None, None))
    for i in range(n // 2):
        at = moment(rng)
        queue.append((f"q{i}", at, at + timedelta(minutes=rng.choice([0, 2, 2000]))))
        if rng.random() < 0.3:
            queue.append((f"q{i}", at + timedelta(minutes=700), at + timedelta(minutes=701)))
    queue += [(None, moment(rng), moment(rng)), ("q1", None, moment(rng)), ("q2", moment(rng), None)]
    return events, queue


WINDOWS = [
    WindowSpec(DAY0 + timedelta(days=low), DAY0 + timedelta(days=low) + timedelta(hours=hours))
    for low, hours in ((2.3, 6), (4.99, 1), (0, 24 * DAYS), (5, 96))
]


def same(store, events, queue, until, robots=None):
    executions = intervals.execution_events(events)
    for window in WINDOWS:
        if window.end > until:
            continue
        for found, expected in (
            (store.executing(window, robots), joins.pair_events(executions, window=window)),
            (
                store.waiting(window, robots),
                intervals.queue_to_first_start(queue, executions.filter("source_event_part = 'START'"), window).distinct(),
            ),
        ):
            # An interval without any length inside the window is left to the caller's filter.
            wanted = [r for r in map(lambda r: r.asDict(), expected.select(*found.columns).collect()) if r["start_time"] <= r["end_time"]]
            if robots:
                wanted = [r for r in wanted if r["robot_code"] in robots]
            key = lambda r: sorted((k, str(v)) for k, v in r.items())
            assert sorted(rows(found), key=key) == sorted(wanted, key=key), window


def frames(spark, events, queue):
    return spark.createDataFrame(events, EVENT), spark.createDataFrame(queue, QUEUE)


@pytest.mark.parametrize("seed, steps", [(1, (0, 1, 2, 4, DAYS - 1)), (2, (DAYS - 1,))])
def test_days_in_steps_match_all_events(spark, tmp_path, seed, steps):
    events, queue = frames(spark, *fleet(seed))
    store = IntervalStore(spark, str(tmp_path / "store"))
    for step in steps:
        upto = DAY0.date() + timedelta(days=step)
        # What has not arrived yet cannot be read.
        here = datetime.combine(upto + timedelta(days=1), datetime.min.time())
        store.advance(events.filter(joins.F.col("event_time") < here), queue.filter((joins.F.col("event_time") < here) | joins.F.col("event_time").isNull()), upto)
    assert store.through() == DAY0.date() + timedelta(days=DAYS - 1)
    last = DAY0.date() + timedelta(days=40)
    store.advance(events, queue, last)
    same(store, events, queue, DAY0 + timedelta(days=60))
    same(store, events, queue, DAY0 + timedelta(days=60), ["A", "C"])


def test_late_rows_and_repeated_steps(spark, tmp_path):
    all_events, all_queue = fleet(4)
    rng = random.Random(4)
    late_events = {i for i in range(len(all_events)) if rng.random() < 0.3}
    late_queue = {i for i in range(len(all_queue)) if rng.random() < 0.3}
    early = frames(
        spark, [e for i, e in enumerate(all_events) if i not in late_events], [q for i, q in enumerate(all_queue) if i not in late_queue]
    )
    events, queue = frames(spark, all_events, all_queue)
    store = IntervalStore(spark, str(tmp_path / "store"))
    last = DAY0.date() + timedelta(days=30)
    store.advance(*early, DAY0.date() + timedelta(days=4))
    store.advance(*early, last)
    store.advance(events, queue, last, since=date(2000, 1, 1))
    same(store, events, queue, DAY0 + timedelta(days=60))
    store.advance(events, queue, last, since=DAY0.date() + timedelta(days=4))
    same(store, events, queue, DAY0 + timedelta(days=60), ["B"])


def test_days_are_processed_once_unless_asked(spark, tmp_path):
    events, queue = frames(spark, *fleet(5, 10))
    store = IntervalStore(spark, str(tmp_path / "store"))
    assert store.through() is None
    assert store.executing(WINDOWS[0]).count() == store.waiting(WINDOWS[0]).count() == 0
    store.advance(events, queue, DAY0.date() + timedelta(days=20))
    with pytest.raises(ValueError):
        store.advance(events, queue, DAY0.date() + timedelta(days=20))
    with pytest.raises(ValueError):
        store.advance(events, queue, DAY0.date() + timedelta(days=2), since=DAY0.date())


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_window_reads_its_days_and_robots(spark, tmp_path):
    events, queue = frames(spark, *fleet(6))
    write_model(events, str(tmp_path / "model"), "operation_event", "robot_code")
    write_model(queue, str(tmp_path / "model"), "queue_fact", "queue_id")
    stored_events, stored_queue = (spark.read.parquet(str(tmp_path / "model" / name)) for name in ("operation_event", "queue_fact"))
    store = IntervalStore(spark, str(tmp_path / "store"))
    store.advance(stored_events, stored_queue, DAY0.date() + timedelta(days=30))
    window = WINDOWS[0]
    battery = spark.createDataFrame([], "robot_code string, sample_time timestamp, charging_status string")
    robots = spark.createDataFrame([("A", "1", True), ("B", "2", True)], "robot_code string, robot_id string, is_enabled boolean")
    trend = intervals.state_trend_from_events(robots, stored_events, battery, stored_queue, window, 15, ["A", "B"], store=store)
    scans = [line for line in plan(trend).split("\n") if "FileScan" in line]
    assert len(scans) == 3 and all("day" in line.split("PartitionFilters")[1].split("]")[0] for line in scans)
    assert all("robot_code" in line.split("PushedFilters")[1] for line in scans)
    files = {f.split("day=")[1][:10] for f in store._read("executing", "start_time timestamp").filter("day = date'2026-07-22'").inputFiles()}
    assert "2026-07-22" in files
    direct = intervals.state_trend_from_events(robots, events, battery, queue, window, 15, ["A", "B"])
    key = lambda r: (r["robot_code"], r["stat_hour"])
    found = sorted(rows(trend), key=key)
    assert found == sorted(rows(direct), key=key) and {r["robot_code"] for r in found} == {"A", "B"}
