"""Named export datasets: report results under their published column names."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import vocab as V
from ..functions.scalar import count_if, percent
from ..functions.time import lit_ts
from ..operators import joins, rules, scope

# Export column -> source column, in export order.
STATUS_DISTRIBUTION = {"Status": "status_name", "Robot_Count": "robot_count"}
MODE_DISTRIBUTION = {"Mode": "mode_name", "Robot_Count": "robot_count"}
BATTERY_TREND = {
    "Statistical_Hour": "stat_hour", "Sample_Count": "sample_count", "Average_Battery_Percent": "avg_battery_soc",
    "Minimum_Battery_Percent": "min_battery_soc", "Maximum_Battery_Percent": "max_battery_soc",
    "Charging_Sample_Count": "charging_sample_count",
}
WIFI_TREND = {
    "Statistical_Hour": "stat_hour", "Sample_Count": "sample_count", "Average_RSSI": "avg_rssi",
    "Minimum_RSSI": "min_rssi", "Maximum_RSSI": "max_rssi", "Zero_Signal_Sample_Count": "zero_signal_sample_count",
    "Zero_Signal_Rate_Percent": "zero_signal_rate", "Weak_Signal_Sample_Count": "weak_signal_sample_count",
}
STATUS_TREND = {
    "Statistical_Hour": "stat_hour", "Status_Sample_Count": "sample_count", "Online_Sample_Count": "online_sample_count",
    "Error_Sample_Count": "error_sample_count", "Average_Speed_Meters_Per_Second": "avg_speed_mps",
    "Maximum_Speed_Meters_Per_Second": "max_speed_mps",
}
JOB_TREND = {
    "Statistical_Date": "stat_date", "Job_Record_Count": "job_count", "Distinct_Job_Count": "distinct_job_count",
    "Completed_Status_Count": "completed_status_count", "Failed_Status_Count": "failed_status_count",
}
QUEUE_TREND = {
    "Statistical_Date": "stat_date", "Queue_Record_Count": "queue_count", "Distinct_Queue_Count": "distinct_queue_count",
    "Completed_Status_Count": "completed_status_count", "Failed_Status_Count": "failed_status_count",
    "Average_Duration_Seconds": "avg_duration_seconds",
}
FAILURES = {
    "Recorded_Outcome": "failure_outcome", "Robot_ID": "robot_code", "Source_Robot_Reference": "source_robot_reference",
    "Failed_Task_Count": "failure_count", "Latest_Failure_Time": "latest_failure_time",
}
TASK_BREAKDOWN = {
    "Task_Type": "job_type_code", "Operating_Mode_ID": "robot_mode_id", "Operating_Mode": "robot_mode_detail",
    "Task_Count": "job_count", "Completed_Status_Count": "completed_status_count",
    "Failed_Status_Count": "failed_status_count", "Latest_Task_Time": "latest_job_time",
}
ACCESS_POINTS = {
    "Wireless_Access_Point": "wifi_ap", "Risk_Level": "risk_level", "Sample_Count": "wifi_sample_count",
    "Zero_Signal_Sample_Count": "zero_signal_sample_count", "Zero_Signal_Rate_Percent": "zero_signal_rate",
    "Weak_Signal_Sample_Count": "weak_signal_sample_count", "Weak_Signal_Rate_Percent": "weak_signal_rate",
    "Affected_Robot_Count": "affected_robot_count", "Average_RSSI": "avg_valid_rssi",
    "Latest_Sample_Time": "last_sample_time",
}
BATCHES = {
    "Batch_ID": "batch_id", "Start_Time": "batch_start_time", "End_Time": "batch_end_time", "Status": "batch_status",
    "Error_Message": "error_message",
}
DIAGNOSTICS = {
    "Robot_ID": "robot_id", "Robot_Type": "robot_type", "Phenomenon": "phenomenon",
    "Most_Likely_Explanation": "diagnosis", "Confidence": "confidence", "Severity": "severity", "Evidence": "evidence_text",
    "Recommended_Actions": "recommended_actions", "Alternative_Causes": "alternative_causes",
    "Triggered_Rules": "rule_ids",
}
PROJECT_TASKS = {
    "Project": "project_name", "Project_ID": "project_id", "Task": "task_name", "Job_ID": "job_id",
    "Task_Records": "queue_count", "Robots": "robot_count", "Completed": "completed_count",
    "Unsuccessful": "unsuccessful_count", "Open": "open_count", "Execution_Seconds": "execution_seconds",
    "Average_Execution_Seconds": "average_execution_seconds", "Subjob_Runs": "subjob_run_count",
    "Latest_Record": "latest_event_time",
}
LOW_BATTERY = {
    "Robot_ID": "_name", "Robot_Type": "robot_type", "Master_Data_ID": "master_robot_id",
    "Battery_Percent": "battery_soc", "Battery_Voltage_V": "battery_voltage", "Battery_Current_A": "battery_current",
    "Operating_Status": "current_status", "Online_Status": "online_status", "Charging_Status": "charging_status",
    "Current_Position": "station_code", "Target_Position": "target_station_code", "Battery_Data_Time": "_battery_time",
}
TASKS = {
    "Robot_ID": "_name", "Robot_Type": "robot_type", "Job_ID": "job_id", "Subjob_ID": "subjob_id",
    "Job_Status": "job_status", "Has_Active_Job": "_active", "Operating_Mode_ID": "current_mode_id",
    "Operating_Mode": "current_mode", "Current_Position": "station_code", "Target_Position": "target_station_code",
    "Job_Data_Time": "job_event_time",
}
ROBOTS = {
    "Robot_ID": "_name", "Robot_Type": "robot_type", "Master_Data_ID": "master_robot_id",
    "Serial_Number": "robot_serial_number", "Current_Status": "current_status", "Online_Status": "online_status",
    "Battery_Percent": "battery_soc", "Voltage_V": "battery_voltage", "Current_A": "battery_current",
    "Charging_Status": "charging_status", "Current_Job": "job_id", "Job_Status": "job_status",
    "Operating_Mode_ID": "current_mode_id", "Operating_Mode": "current_mode", "Current_RSSI": "current_rssi",
    "WiFi_Quality": "current_wifi_quality", "Zero_Signal_Rate_Percent": "zero_signal_rate",
    "Current_Access_Point": "current_wifi_ap", "Map": "map_code", "Current_Position": "station_code",
    "Target_Position": "target_station_code", "Alarm_Code": "error_code", "Alarm_Reason": "error_message",
    "Derived_Alert_Causes": "_reasons", "Latest_Data_Time": "latest_data_time", "Status_Data_Time": "_status_time",
    "Battery_Data_Time": "battery_event_time", "WiFi_Data_Time": "latest_wifi_time",
}
PROFILE_ROBOT = {
    "Robot_Type": "robot_type", "Robot_ID": "_name", "Master_Data_ID": "master_robot_id",
    "Serial_Number": "robot_serial_number", "Current_Status": "current_status", "Online_Status": "online_status",
    "Battery_Percent": "battery_soc", "Voltage_V": "battery_voltage", "Current_A": "battery_current",
    "Charging_Status": "charging_status", "Current_Job": "job_id", "Job_Status": "job_status",
    "Operating_Mode_ID": "current_mode_id", "Operating_Mode": "current_mode", "Current_RSSI": "current_rssi",
    "WiFi_Quality": "current_wifi_quality", "Access_Point": "current_wifi_ap", "Map": "map_code",
    "Current_Position": "station_code", "Target_Position": "target_station_code", "Alert_Causes": "_coded_reasons",
    "Latest_Data_Time": "latest_data_time", "Status_Data_Time": "_status_time",
    "Battery_Data_Time": "battery_event_time", "WiFi_Data_Time": "latest_wifi_time", "Task_Data_Time": "job_event_time",
    "DWS_Load_Time": "dws_load_time",
}
MAP = {
    "Map": "_map", "Robot_ID": "_name", "X_Coordinate": "position_x", "Y_Coordinate": "position_y",
    "Heading": "position_theta", "Current_Status": "current_status", "Online_Status": "online_status",
    "Alarm_Reason": "error_message", "Current_Position": "station_code", "Target_Position": "target_station_code",
    "Data_Time": "source_event_time",
}
IDENTITY_RULE = "Robots are named through the robot id of their queue records; robot codes of the records are not shown"
NO_QUEUE_CAUSE = "Not captured by the source queue table"
NO_JOB_CAUSE = "Not captured by the source job history table"

Report = Mapping[str, DataFrame]
EXPORTS: dict[str, Callable[..., DataFrame]] = {}


def _export(name: str):
    def add(function):
        EXPORTS[name] = function
        return function
    return add


def export_dataset(report: Report, name: str, **options: object) -> DataFrame:
    """Rows of the named export; ``options`` are those of the dataset.

    ``report`` is the report the dataset belongs to: the dashboard, a robot
    profile (``profile-*``, with ``robot_id``) or the project analytics.
    """
    if name not in EXPORTS:
        raise KeyError(f"unknown export: {name}")
    return EXPORTS[name](report, **options)


def _renamed(df: DataFrame, columns: Mapping[str, str], *extra: Column) -> DataFrame:
    """Select under export names; fields a result does not carry become NULL."""
    return df.select(
        *[(F.col(source) if source in df.columns else S.typed_null("string")).alias(target)
          for target, source in columns.items()],
        *extra,
    )


def _simple(name: str, result: str, columns: Mapping[str, str], *extra: Column) -> None:
    EXPORTS[name] = lambda report, **_: _renamed(report[result], columns, *extra)


_simple("status-distribution", "status_distribution", STATUS_DISTRIBUTION)
_simple("mode-distribution", "mode_distribution", MODE_DISTRIBUTION)
_simple("battery-trend", "battery_trend", BATTERY_TREND)
_simple("alarm-trend", "status_trend", STATUS_TREND)
_simple("queue-trend", "queue_trend", QUEUE_TREND)
_simple("wifi-risk", "access_point_risk", ACCESS_POINTS)
_simple("batches", "batches", BATCHES)


@_export("wifi-trend")
def _wifi_trend(report: Report) -> DataFrame:
    named = report["wifi_trend"].withColumnsRenamed(
        {"avg_valid_rssi": "avg_rssi", "min_valid_rssi": "min_rssi", "max_valid_rssi": "max_rssi"}
    )
    return _renamed(named, WIFI_TREND)


@_export("task-failure-outcomes")
def _failures(report: Report) -> DataFrame:
    return _renamed(report["failure_outcomes"], FAILURES, F.lit(NO_QUEUE_CAUSE).alias("Root_Cause"))


@_export("job-trend")
def _job_trend(report: Report) -> DataFrame:
    finished = F.col("completed_status_count") + F.col("failed_status_count")
    return _renamed(report["job_trend"], JOB_TREND, percent("completed_status_count", finished).alias("Success_Rate_Percent"))


def _moment(at: datetime | None) -> Column:
    return lit_ts(at) if at else S.typed_null("timestamp")


@_export("analysis")
def _analysis(report: Report, generated_at: datetime | None = None) -> DataFrame:
    return _renamed(
        report["diagnostics"], DIAGNOSTICS, F.lit(V.RULE_VERSION).alias("Rule_Version"), _moment(generated_at).alias("Analysis_Generated_At")
    )


@_export("project-analytics")
def _project(
    report: Report, projects: object = None, jobs: object = None, display_robots: object = None, identity_rule: str = IDENTITY_RULE
) -> DataFrame:
    def listed(values: object, otherwise: str) -> Column:
        return F.lit(",".join(scope.parse_list(values)) or otherwise)

    bounds = report["summary"].select(F.struct("analysis_start", "analysis_end").alias("b")).scalar()
    return _renamed(
        report["tasks"], PROJECT_TASKS, bounds["analysis_start"].alias("Analysis_Start"),
        bounds["analysis_end"].alias("Analysis_End"), listed(projects, "ALL").alias("Selected_Projects"),
        listed(jobs, "ALL").alias("Selected_Jobs"), listed(display_robots, "ALL_DERIVED").alias("Display_Robots"),
        F.lit("Project -> Task -> Robot").alias("Navigation_Axis"),
        F.lit("DERIVED_FROM_SELECTED_WORK").alias("Robot_Scope"), F.lit(identity_rule).alias("Identity_Rule"),
    )


def _robots(report: Report) -> DataFrame:
    """All robots of the report with display name and derived times."""
    robots = report["all_robots"]
    return robots.withColumns({
        "_name": S.robot_display("robot_code", "robot_name", "master_robot_id"),
        "_status_time": F.coalesce("status_event_time", "source_event_time"),
        "_battery_time": F.coalesce("battery_event_time", "source_event_time"),
        "_active": S.has_active_job("is_active_job", "job_id").cast("int"),
        "_map": F.coalesce(S.blank_to_null("map_code"), F.lit(V.NO_MAP_LABEL)),
    })


def _with_reasons(report: Report) -> DataFrame:
    """Robots with their alert reasons as text; a robot has at most five."""
    alerts = report["alerts"].withColumn("_coded", F.concat_ws(": ", "code", "reason"))
    ordered = F.array_sort(F.collect_list(F.struct("position", "reason", "_coded")))
    texts = alerts.groupBy("master_robot_id").agg(ordered.alias("_a")).select(
        "master_robot_id", F.array_join(F.transform("_a", lambda cause: cause["reason"]), "; ").alias("_reasons"),
        F.array_join(F.transform("_a", lambda cause: cause["_coded"]), "; ").alias("_coded_reasons"),
    )
    return joins.lookup(_robots(report), texts, ["master_robot_id"], "left", balanced=True)


@_export("low-battery-risk")
def _low_battery(report: Report) -> DataFrame:
    return _renamed(_robots(report).filter(S.is_low_battery("battery_soc")), LOW_BATTERY)


@_export("tasks")
def _tasks(report: Report) -> DataFrame:
    return _renamed(_robots(report), TASKS)


@_export("robots")
def _robot_rows(report: Report, search: str | None = None) -> DataFrame:
    return _renamed(scope.search(_with_reasons(report), search), ROBOTS)


@_export("map")
def _map_rows(report: Report, map_code: str = V.NO_MAP_CODE) -> DataFrame:
    placed = _robots(report).filter(F.col("position_x").isNotNull() & F.col("position_y").isNotNull())
    return _renamed(placed.filter(F.coalesce(S.blank_to_null("map_code"), F.lit(V.NO_MAP_CODE)) == map_code), MAP)


@_export("alerts")
def _alerts(report: Report) -> DataFrame:
    current, target = S.blank_to_null("station_code"), S.blank_to_null("target_station_code")
    place = (
        F.when(current.isNotNull() & target.isNotNull() & (current != target), F.concat_ws(" → ", current, target))
        .when(current.isNotNull(), current).when(target.isNotNull(), F.concat(F.lit("Target "), target))
        .otherwise(F.coalesce(S.blank_to_null("map_code"), F.lit("--")))
    )
    robots = _robots(report).select(
        "master_robot_id", "current_status", "job_id", "battery_soc", "current_rssi", place.alias("_place")
    )
    return joins.lookup(report["alerts"], robots, ["master_robot_id"], "inner", balanced=True).select(
        F.col("robot_id").alias("Robot_ID"), F.col("code").alias("Alert_Code"), F.col("reason").alias("Alert_Cause"),
        F.col("type").alias("Cause_Type"), F.col("current_status").alias("Current_Status"),
        F.col("job_id").alias("Current_Job"), F.col("_place").alias("Current_Position"),
        F.col("battery_soc").alias("Battery_Percent"), F.col("current_rssi").alias("Current_RSSI"),
        F.col("data_time").alias("Cause_Data_Time"),
    )


def _listed_robots(report: Report) -> DataFrame:
    """Every robot with what the lists of the overview ask of it."""
    alerted = report["alerts"].groupBy("master_robot_id").agg(
        F.max((F.col("type") == "no-signal")).alias("_no_signal"),
        F.max((F.col("type") == "device-error")).alias("_device_error"),
    ).withColumn("_alert", F.lit(True))
    return joins.lookup(_robots(report), alerted, ["master_robot_id"], "left", balanced=True)


def _id_lists() -> dict[str, Column]:
    return {
        "Offline_Robot_IDs": S.online_state("online_status") != "online", "Active_Job_Robot_IDs": F.col("_active") == 1,
        "Low_Battery_Robot_IDs": S.is_low_battery("battery_soc"), "Alert_Robot_IDs": F.col("_alert"),
        "No_Signal_Robot_IDs": F.col("_no_signal"), "Device_Error_Robot_IDs": F.col("_device_error"),
    }


@_export("overview-robots")
def _overview_robots(report: Report) -> DataFrame:
    """The overview's lists in full: one row per list and robot."""
    found = rules.id_rows(_listed_robots(report), _id_lists(), "_name")
    return found.select(F.col("list").alias("List"), F.col("_name").alias("Robot_ID"))


@_export("overview")
def _overview(
    report: Report, window_label: str = "", robot_type: str = V.ALL_ROBOT_TYPES, ids_in_cell: int | None = None,
    generated_at: datetime | None = None,
) -> DataFrame:
    """One row; a cell lists all names, or the first ``ids_in_cell``; ``overview-robots`` has them as rows."""
    jobs = report["job_trend"].agg(
        F.coalesce(F.sum("completed_status_count"), F.lit(0)).alias("Completed_Task_States"),
        F.coalesce(F.sum("failed_status_count"), F.lit(0)).alias("Failed_Task_States"),
    )
    jobs = jobs.withColumn(
        "Task_Success_Rate_Percent",
        percent("Completed_Task_States", F.col("Completed_Task_States") + F.col("Failed_Task_States")),
    )
    robots = _listed_robots(report)

    def shown(named: DataFrame) -> DataFrame:
        return named if ids_in_cell is None else named.orderBy("_name").limit(ids_in_cell)

    alerts = robots.agg(count_if(F.col("_alert")).alias("Alert_Robots"))
    lists = [
        shown(robots.filter(condition)).agg(F.array_join(F.array_sort(F.collect_list("_name")), ", ").alias(name))
        for name, condition in _id_lists().items()
    ]
    names = {
        "Status_Data_Time": "source_anchor_time", "DWS_Refresh_Time": "latest_dws_load_time",
        "Enabled_Robots": "total_robot_count", "Commissioned_Robots": "commissioned_robot_count",
        "Online_Robots": "online_robot_count", "Offline_Robots": "offline_robot_count",
        "Active_Job_Robots": "active_job_robot_count", "Average_Battery_Percent": "avg_battery_soc",
        "Low_Battery_Robots": "low_battery_robot_count", "Current_Average_RSSI": "avg_current_rssi",
        "Zero_Signal_Sample_Rate_Percent": "zero_signal_rate",
    }
    label = "All Robots" if robot_type == V.ALL_ROBOT_TYPES else robot_type
    row = joins.one_row(_renamed(report["summary"], names), alerts, *lists, jobs)
    return row.select(
        F.lit(label).alias("Robot_Type_Filter"), F.lit(window_label).alias("Analysis_Window"), _moment(generated_at).alias("Dashboard_Generated_At"), *[row[c] for c in row.columns]
    )


@_export("robot-profile")
def _robot_profile(report: Report, robot_id: object, window_label: str = "") -> DataFrame:
    mine = _with_reasons(report).filter(F.col("master_robot_id") == int(robot_id))
    rows = _renamed(mine, PROFILE_ROBOT)
    return rows.select(F.lit(window_label).alias("Analysis_Window"), *rows.columns)


def _profile(name: str, result: str, columns: Mapping[str, str], *extra: Column) -> None:
    def rows(report: Report) -> DataFrame:
        robot = report["robot"].select("robot_code").scalar()
        renamed = _renamed(report[result], columns, *extra)
        return renamed.select(robot.alias("Robot_ID"), *renamed.columns)

    EXPORTS[name] = rows


_profile("profile-battery", "battery_trend", BATTERY_TREND)
_profile("profile-wifi", "wifi_trend", WIFI_TREND)
_profile("profile-status", "status_trend", STATUS_TREND)
_profile("profile-jobs", "job_trend", JOB_TREND)



@_export("profile-task-breakdown")
def _task_breakdown(report: Report) -> DataFrame:
    robot = report["robot"].select("robot_code").scalar()
    renamed = _renamed(report["task_breakdown"], TASK_BREAKDOWN, F.lit(NO_JOB_CAUSE).alias("Failure_Root_Cause"))
    return renamed.select(robot.alias("Robot_ID"), *renamed.columns)
