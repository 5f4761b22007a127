"""Facts in buckets of one queue record are joined and grouped without a shuffle."""

from datetime import datetime, timedelta

import pytest

from fleetlens.functions.time import WindowSpec
from fleetlens.operators import work
from fleetlens.sources import tables as model
from helpers import rows

START = datetime(2026, 7, 1)
RUN = "id bigint, amr_id int, queue_id bigint, job_id int, subjob_id int, start_time timestamp, end_time timestamp, status string"
RAW = "ods_row_id bigint, queue_id bigint, start_time timestamp, end_time timestamp, status string"


@pytest.fixture(scope="module")
def facts(spark):
    runs, raw, queue = [], [], []
    for i in range(600):
        at = START + timedelta(minutes=37 * i)
        queue_id = 7 if i % 3 == 0 else None if i % 50 == 1 else i
        runs.append((i, i % 4, queue_id, 1, 1, at, at + timedelta(minutes=9), "success"))
        raw.append((i, queue_id, at, at + timedelta(minutes=9) if i % 5 else None, "success" if i % 2 else "failed"))
        queue.append((i, at - timedelta(minutes=i % 11 - 2) if i % 20 else None))
    return (
        spark.createDataFrame(runs, RUN), spark.createDataFrame(raw, RAW), spark.createDataFrame(queue, "id bigint, enqueued_at timestamp"),
        spark.createDataFrame([(i, f"R{i}", "AMR") for i in range(4)], "master_robot_id int, robot_code string, robot_type string"),
    )


@pytest.fixture
def stored(spark, facts, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS bucketed")
    names = ("task_run", "task_run_raw", "queue_source")
    for name, df in zip(names, facts):
        model.write_buckets(df, str(tmp_path), name, 8, "bucketed")
    yield model.load_catalog(spark, "bucketed", names)
    for name in names:
        spark.sql(f"DROP TABLE bucketed.{name}")


@pytest.fixture
def no_broadcast(spark):
    settings = {"spark.fleetlens.lookup.broadcastBytes": "400", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name in settings:
        spark.conf.unset(name)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles_below_join(text: str) -> int:
    """Exchanges under the sort-merge join of the facts."""
    lines = text.split("\n")
    at = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line and "queue_id" in line)
    depth = len(lines[at]) - len(lines[at].lstrip(" :+-*("))
    below = []
    for line in lines[at + 1 :]:
        if len(line) - len(line.lstrip(" :+-*(")) <= depth:
            break
        below.append(line)
    return sum("Exchange hash" in line for line in below)


def test_queue_wait_joins_buckets(facts, stored, no_broadcast):
    runs, _, queue, robots = facts
    assert model.co_located(stored, "task_run", "queue_source")
    found = work.queue_wait(stored["task_run"], stored["queue_source"], robots, co_located=True)
    assert shuffles_below_join(plan(found)) == 0
    assert shuffles_below_join(plan(work.queue_wait(runs, queue, robots))) == 2
    assert rows(found) == rows(work.queue_wait(runs, queue, robots))


def test_runs_of_a_queue_are_grouped_in_their_bucket(facts, stored):
    window = WindowSpec(START + timedelta(days=2), START + timedelta(days=9))
    found = work.execution_per_queue(stored["task_run_raw"], window)
    assert "Exchange" not in plan(found) and "day" in plan(found).split("PartitionFilters")[1].split("]")[0]
    key = lambda r: r["queue_id"]
    assert sorted(rows(found), key=key) == sorted(rows(work.execution_per_queue(facts[1], window)), key=key)


def test_other_layouts_are_not_co_located(spark, facts, stored, tmp_path):
    assert stored.buckets("task_run") == ("queue_id", 8)
    assert not model.co_located({}, "task_run", "queue_source")
    model.write_buckets(facts[2], str(tmp_path / "other"), "queue_source", 4, "bucketed")
    assert not model.co_located(model.load_catalog(spark, "bucketed", ("task_run", "queue_source")), "task_run", "queue_source")
