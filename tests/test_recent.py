"""Newest readings are found from the newest day folders backwards."""

from datetime import date, datetime, timedelta

import pytest

from fleetlens.operators import joins, recent, scope
from fleetlens.plans import dashboard
from fleetlens.sources import profile
from fleetlens.sources.tables import write_model
from helpers import one, rows

F = joins.F
DAY0 = datetime(2026, 7, 1, 13)
SCHEMA = "robot_code string, amr_id int, stat_hour timestamp, pc_timestamp timestamp, event_time timestamp, start_time timestamp, batt_level int"


def readings(last):
    """A reading an hour for each robot up to its last day."""
    out = []
    for code, amr_id, days in last:
        for i in range(days):
            at = DAY0 + timedelta(days=i, hours=amr_id)
            out.append((code, amr_id, at, at, at, at, 50))
    return out


@pytest.fixture
def stored(spark, tmp_path):
    data = readings([("A", 1, 20), ("B", 2, 12), ("gone", 9, 30)]) + [("A", 1, None, None, None, None, None)]
    df = spark.createDataFrame(data, SCHEMA)
    for name in ("battery_hourly", "wifi_history", "queue_fact"):
        write_model(df, str(tmp_path), name, "robot_code")
    return lambda name: spark.read.parquet(f"{tmp_path}/{name}")


def filters(df) -> str:
    return " ".join(line.split("PartitionFilters")[1].split("]")[0] for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "PartitionFilters" in line)


def test_days_of_a_table(spark, stored):
    days = recent.stored_days(stored("battery_hourly"))
    assert days == [date(2026, 7, 30) - timedelta(days=i) for i in range(30)]
    assert recent.stored_days(spark.createDataFrame([(date(2026, 7, 1),)], "day date")) == []
    assert recent.stored_days(spark.range(1)) == []


def test_newest_day_is_enough_without_a_scope(stored):
    part = recent.newest_part(stored("wifi_history"), "pc_timestamp")
    assert {r["day"] for r in part.select("day").distinct().collect()} == {date(2026, 7, 30)}
    assert "2026-07-30" in filters(part.select("pc_timestamp"))


@pytest.mark.parametrize("codes, newest", [(["A"], 20), (["B"], 12), (["A", "B"], 20), (["gone"], 30), (["none"], None)])
def test_anchor_of_a_scope_behind_the_newest_day(spark, stored, codes, newest):
    bridge = spark.createDataFrame([(c,) for c in codes], "robot_reference string")
    facts = stored("battery_hourly")
    part = recent.newest_part(facts, "stat_hour", lambda p: scope.in_scope(p, bridge))
    assert one(scope.anchor(part, "stat_hour", bridge)) == one(scope.anchor(facts, "stat_hour", bridge))
    left = part.select("day").distinct().count()
    # Days are tried in steps of 1, 2, 4 and so on.
    assert left == 0 if newest is None else left <= 2 * (31 - newest) and part.count() < facts.count()


def test_tables_by_other_layouts_are_left_alone(spark):
    df = spark.createDataFrame(readings([("A", 1, 3)]), SCHEMA)
    assert recent.newest_part(df, "stat_hour") is df


def test_profiles_read_their_days(spark, stored):
    samples = stored("wifi_history")
    plain = spark.createDataFrame(samples.drop("day").collect(), samples.drop("day").schema)
    conditions = {"high": F.col("batt_level") > 40}
    found = profile.coverage_profile(samples, conditions, "pc_timestamp", 3)
    assert rows(found) == rows(profile.coverage_profile(plain, conditions, "pc_timestamp", 3))
    assert one(found)["row_count"] == 4
    robots = spark.createDataFrame([(1, "A"), (9, "gone")], "master_robot_id int, robot_code string")
    assert rows(profile.sample_share(samples, robots)) == rows(profile.sample_share(plain, robots))
    assert "day" in filters(profile.sample_share(samples, robots))


def test_dashboard_anchors_do_not_depend_on_the_layout(spark, tmp_path):
    master = spark.createDataFrame(
        [(1, "A", "Y", None, None, None, None, None, None), (2, "B", "Y", None, None, None, None, None, None)],
        "id int, name string, is_active string, serial_number string, status string, factory_id int, max_battery int, min_battery int, updated_at timestamp",
    )
    data = readings([("A", 1, 9), ("2", 2, 14), ("9", 9, 21)])
    facts = spark.createDataFrame(data, SCHEMA)
    daily = facts.select("robot_code", F.to_date("stat_hour").alias("stat_date"), F.lit(None).cast("string").alias("job_type_code"),
                         F.lit(None).cast("string").alias("robot_mode_id"), F.lit(None).cast("string").alias("robot_mode_detail"))
    names = ("battery_hourly", "status_hourly", "job_history", "wifi_history", "task_run", "battery_history")
    for name in names:
        write_model(facts, str(tmp_path), name)
    robots = scope.robot_scope(master, "ALL")
    bridge = scope.reference_bridge(robots)
    plain = {**{name: facts for name in names}, "job_daily": daily, "queue_daily": daily}
    by_day = {**plain, **{name: spark.read.parquet(f"{tmp_path}/{name}") for name in names}}
    found = dashboard._anchors(by_day, bridge, robots)
    assert found == dashboard._anchors(plain, bridge, robots)
    assert found["battery"] == DAY0 + timedelta(days=13, hours=2) and found["running_wifi"] == DAY0 + timedelta(days=20, hours=9)
