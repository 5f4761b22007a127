import random
from datetime import datetime, timedelta

import pytest

from fleetlens.functions.time import WindowSpec
from fleetlens.operators import intervals, joins
from helpers import at, one, rows

INTERVAL = "robot_code string, start_time timestamp, end_time timestamp"
WINDOW = WindowSpec(datetime(2026, 7, 28, 8, 2, 30), datetime(2026, 7, 28, 9, 47, 10))


def random_intervals(seed, robots=("A", "B"), n=40):
    rng = random.Random(seed)
    found = []
    for _ in range(n):
        start = at(8 * 60) + timedelta(seconds=rng.randrange(0, 7200, 30))
        found.append((rng.choice(robots), start, start + timedelta(seconds=rng.choice([0, 30, 60, 300, 900]))))
    return found


def merge_brute(data):
    merged = []
    for robot in sorted({r for r, _, _ in data}):
        current = None
        for start, end in sorted((s, e) for r, s, e in data if r == robot):
            if current and start <= current[1]:
                current[1] = max(current[1], end)
            else:
                current = [start, end]
                merged.append((robot, current))
    return sorted((r, s, e) for r, (s, e) in merged)


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("chunk", [120, 1800, 10**9])
def test_merge_matches_brute_force(spark, seed, chunk):
    data = random_intervals(seed)
    df = spark.createDataFrame(data + data[:5], INTERVAL)
    found = rows(intervals.merge_intervals(df, ["robot_code"], chunk_seconds=chunk))
    assert sorted((r["robot_code"], r["start_time"], r["end_time"]) for r in found) == merge_brute(data)


def test_merge_touching_nested_and_repeated(spark):
    data = [("A", at(0), at(10)), ("A", at(10), at(20)), ("A", at(2), at(3)), ("A", at(0), at(10)), ("A", at(21), at(22))]
    found = rows(intervals.merge_intervals(spark.createDataFrame(data, INTERVAL), ["robot_code"]))
    assert sorted((r["start_time"], r["end_time"]) for r in found) == [(at(0), at(20)), (at(21), at(22))]


def islands_brute(samples, gap):
    found = []
    for robot in sorted({r for r, _, _ in samples}):
        mine = sorted((t, c) for r, t, c in samples if r == robot)
        runs = []
        for t, c in mine:
            if runs and (t - runs[-1][1]).total_seconds() <= gap and runs[-1][2] == c:
                runs[-1][1] = t
            else:
                runs.append([t, t, c])
        for i, (start, last, c) in enumerate(runs):
            follower = runs[i + 1][0] if i + 1 < len(runs) else None
            end = follower if follower and (follower - last).total_seconds() <= gap else last
            found.append((robot, start, end, c))
    return sorted(found)


@pytest.mark.parametrize("seed", [5, 6])
@pytest.mark.parametrize("chunk", [300, 3600, 10**9])
def test_islands_match_brute_force(spark, seed, chunk):
    rng = random.Random(seed)
    samples = sorted({("AB"[rng.randrange(2)], at(0) + timedelta(seconds=rng.randrange(0, 9000, 60))) for _ in range(90)})
    samples = [(r, t, rng.random() < 0.5) for r, t in samples]
    df = spark.createDataFrame(samples, "robot_code string, t timestamp, c boolean")
    found = rows(intervals.state_islands(df, ["robot_code"], "t", "c", 300, chunk))
    assert sorted((r["robot_code"], r["start_time"], r["end_time"], r["c"]) for r in found) == islands_brute(samples, 300)


def test_time_weighted_share_gap_limits_and_ties(spark):
    def sec(n):
        return at(0) + timedelta(seconds=n)
    samples = [("A", sec(0), 70, 1), ("A", sec(300), 50, 2), ("A", sec(601), 90, 3), ("A", sec(601), 10, 4),
               ("A", sec(700), 90, 5), ("B", sec(0), 90, 1)]
    df = spark.createDataFrame(samples, "k string, t timestamp, level int, id int")
    for chunk in (100, 86400):
        found = one(intervals.time_weighted_share(df, ["k"], "t", "level", window_s=1000, tiebreak="id", chunk_seconds=chunk))
        # 300 s is observed, 301 s is not; of the tied samples the later one (10) holds for 99 s.
        assert (found["k"], found["sample_count"], found["observed_seconds"], found["above_60_seconds"]) == ("A", 5, 399, 300)
        assert float(found["above_60_time_share_percent"]) == 75.19 and float(found["window_coverage_percent"]) == 39.9


def test_pair_events(spark):
    def event(row, part, minute):
        return ("ODS", "TA_AMR", row, part, at(minute), "A")
    df = spark.createDataFrame(
        [event(1, "START", 0), event(1, "END", 5), event(2, "START", 9), event(2, "END", 3), event(3, "START", 4),
         event(4, "START", 7), event(4, "END", 7)],
        "source_schema string, source_table string, source_ods_row_id long, source_event_part string, "
        "event_time timestamp, robot_code string",
    )
    assert sorted(r["source_ods_row_id"] for r in rows(joins.pair_events(df))) == [1, 4]
    clipped = one(joins.pair_events(df, window=WindowSpec(at(1), at(4))))
    assert (clipped["start_time"], clipped["end_time"]) == (at(1), at(4))


def test_queue_to_first_start(spark):
    queue = spark.createDataFrame([("q", at(0)), ("q", at(6)), ("z", at(0)), (None, at(0))],
                                  "queue_id string, queue_start_time timestamp")
    starts = spark.createDataFrame([("q", "A", at(5)), ("q", "A", at(9)), ("q", "B", at(2)), ("q", "A", at(-1))],
                                   "queue_id string, robot_code string, event_time timestamp")
    found = rows(intervals.queue_to_first_start(queue, starts))
    assert sorted((r["robot_code"], r["start_time"], r["end_time"]) for r in found) == [
        ("A", at(0), at(5)), ("A", at(6), at(9)), ("B", at(0), at(2))]


def states_brute(robots, window, minutes, sets):
    """Second by second, straight from the definitions."""
    step, found = timedelta(seconds=1), {}
    for robot in robots:
        t = window.start
        while t < window.end:
            bucket = t.replace(minute=t.minute - t.minute % minutes, second=0)
            state = "data_unavailable"
            for kind, name in (("executing", "executing"), ("charging", "charging"), ("waiting", "waiting"),
                               ("observed", "no_task")):
                if any(r == robot and s <= t < e for r, s, e in sets[kind]):
                    state = name
                    break
            key = (robot, bucket)
            found.setdefault(key, dict.fromkeys(intervals.STATES, 0))[state] += 1
            t += step
    return found


@pytest.mark.parametrize("minutes", [5, 15])
def test_sweep_matches_definition(spark, minutes):
    robots = ["A", "B", "SILENT"]
    sets = {kind: random_intervals(seed, n=12) for seed, kind in enumerate(intervals.KINDS, 10)}
    sets["observed"] += [("OUT_OF_SCOPE", at(480), at(600))]
    frames = {kind: spark.createDataFrame(data, INTERVAL) for kind, data in sets.items()}
    robot_df = spark.createDataFrame([(r,) for r in robots], "robot_code string")
    segments = intervals.atomic_segments(robot_df, WINDOW, minutes, frames)
    found = {
        (r["robot_code"], r["bucket_start"]): {name: r[f"{name}_seconds"] for name in intervals.STATES}
        for r in rows(intervals.attribute_states(segments))
    }
    assert found == states_brute(robots, WINDOW, minutes, sets)


def test_states_fill_every_bucket_whatever_the_partitioning(spark):
    sets = {kind: random_intervals(seed) for seed, kind in enumerate(intervals.KINDS, 20)}
    robot_df = spark.createDataFrame([("A",), ("B",)], "robot_code string")
    results = []
    for parts in (1, 7):
        frames = {
            kind: spark.createDataFrame(random.Random(parts).sample(data, len(data)), INTERVAL).repartition(parts)
            for kind, data in sets.items()
        }
        found = rows(intervals.attribute_states(intervals.atomic_segments(robot_df, WINDOW, 15, frames)))
        results.append(sorted(map(str, found)))
        for row in found:
            length = min(row["bucket_start"] + timedelta(minutes=15), WINDOW.end) - max(row["bucket_start"], WINDOW.start)
            assert sum(row[name] for name in intervals.STATE_COLUMNS) == length.total_seconds()
    assert results[0] == results[1]
