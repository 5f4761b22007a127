"""Profile of one robot: hourly battery, status and signal, daily jobs, task breakdown."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import is_active_flag
from ..functions.time import clamp_days, clamp_hours, in_trailing, lit_ts
from ..operators import joins, rssi, scope, work
from ..operators.recent import newest_part

Report = dict[str, DataFrame]
SIGNAL_HOURS = 24  # samples are read for so long unless asked otherwise


class RobotError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def parse_robot_id(value: object) -> int:
    text = str(value).strip()
    if not text.isdigit() or str(int(text)) != text or int(text) < 1:
        raise RobotError("INVALID_ROBOT_ID", "the robot id must be a positive integer")
    return int(text)


def robot_profile(
    tables, robot_id: object, as_of: datetime, hours: object = None, days: object = None,
    signal_hours: int | None = SIGNAL_HOURS,
) -> Report:
    """Named results of one active robot.

    Rollup rows are matched by the robot's numeric id only.  Windows end at
    the newest reading of the whole source, so robots compare over equal time.
    Signal samples cover the last ``signal_hours`` of them, all hours if None.
    """
    key = parse_robot_id(robot_id)
    hours, days = clamp_hours(hours), clamp_days(days)
    signal_hours = hours if signal_hours is None else min(hours, signal_hours)
    master = tables["robot_master"]
    robot = master.filter((F.col("id") == key) & is_active_flag("is_active")).select(
        F.col("id").alias("master_robot_id"), F.col("name").alias("robot_code"),
        F.col("serial_number").alias("robot_serial_number"), F.col("status").alias("master_status"), "factory_id",
        "max_battery", "min_battery", F.col("updated_at").alias("master_updated_at"),
    )
    if not robot.take(1):
        raise RobotError("ROBOT_NOT_FOUND", "no active robot has this id")
    active = scope.robot_scope(master).select(F.col("master_robot_id").alias("amr_id"))
    signals_of = newest_part(
        tables["wifi_source"], "pc_timestamp", lambda part: joins.lookup(part, active, ["amr_id"], "left_semi")
    )
    per_robot = signals_of.groupBy("amr_id").agg(F.max("pc_timestamp").alias("t"))
    anchors = joins.one_row(
        newest_part(tables["battery_hourly"], "stat_hour").agg(F.max("stat_hour").alias("battery_anchor_time")),
        newest_part(tables["status_hourly"], "stat_hour").agg(F.max("stat_hour").alias("status_anchor_time")),
        joins.lookup(per_robot, active, ["amr_id"], "left_semi").agg(F.max("t").alias("wifi_anchor_time")),
        newest_part(tables["job_daily"], "stat_date").agg(F.max("stat_date").alias("job_anchor_date")),
    )
    found = anchors.first().asDict()

    def recent(df: DataFrame, time: str, anchor: object, amount: int, unit: str, closed: str) -> DataFrame:
        if anchor is None:
            return df.filter(F.lit(False))
        return in_trailing(df, time, lit_ts(anchor) if isinstance(anchor, datetime) else F.lit(anchor), amount, unit, closed)

    def rows(name: str, time: str, anchor: str, amount: int, unit: str) -> DataFrame:
        mine = tables[name].filter(F.col("robot_code") == str(key))
        return recent(mine, time, found[anchor], amount, unit, "buckets")

    jobs = rows("job_daily", "stat_date", "job_anchor_date", days, "DAYS")
    signals = recent(
        tables["wifi_source"].filter(F.col("amr_id") == key), "pc_timestamp", found["wifi_anchor_time"], signal_hours,
        "HOURS", "right",
    )
    return {
        "robot": robot,
        "battery_trend": rows("battery_hourly", "stat_hour", "battery_anchor_time", hours, "HOURS").select(
            "stat_hour", "sample_count", "avg_battery_soc", "min_battery_soc", "max_battery_soc", "avg_battery_voltage",
            "avg_battery_current", "avg_battery_power", "charging_sample_count", "first_sample_time", "last_sample_time",
        ).orderBy("stat_hour"),
        "status_trend": rows("status_hourly", "stat_hour", "status_anchor_time", hours, "HOURS").select(
            "stat_hour", "sample_count", "online_sample_count", "error_sample_count", "avg_speed_mps", "max_speed_mps",
            "first_status_time", "last_status_time",
        ).orderBy("stat_hour"),
        "wifi_trend": rssi.profile_wifi_hourly(signals),
        "job_trend": jobs.groupBy("stat_date").agg(
            *[F.sum(name).alias(name) for name in
              ("job_count", "distinct_job_count", "completed_status_count", "failed_status_count")],
            F.min("first_job_start_time").alias("first_job_start_time"),
            F.max("last_job_start_time").alias("last_job_start_time"),
        ).orderBy("stat_date"),
        "task_breakdown": work.task_breakdown(jobs),
        "anchors": anchors.select(
            "*", F.lit(signal_hours).alias("wifi_window_hours"), lit_ts(as_of).alias("database_current_time")
        ),
    }
