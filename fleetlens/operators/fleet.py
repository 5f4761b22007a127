"""Freshness-gated fleet state, fleet KPIs and weighted hourly trends."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import vocab as V
from ..functions.scalar import count_if
from ..functions.time import ColumnOrName, as_col, lit_ts, minutes_between
from .joins import attach_by_reference, latest_per_key, lookup, one_row
from .scope import commissioned, null_cols, reference_bridge, robot_scope


def freshness(
    event: ColumnOrName, load: ColumnOrName, as_of: Column, timeout: int = V.DEFAULT_FRESHNESS_MINUTES
) -> Column:
    """Freshness state of a reading; each limit is exceeded strictly."""
    return (
        F.when(as_col(event).isNull() | as_col(load).isNull(), F.lit(V.MISSING))
        .when(minutes_between(load, as_of) > timeout, F.lit(V.REFRESH_TIMEOUT))
        .when(minutes_between(event, load) > timeout, F.lit(V.SOURCE_LAG))
        .when(minutes_between(event, as_of) > timeout, F.lit(V.SOURCE_TIMEOUT))
        .otherwise(F.lit(V.CURRENT))
    )


def gate_columns(prefix: str, event: str, load: str, as_of: Column, timeout: int) -> list[Column]:
    return [
        freshness(event, load, as_of, timeout).alias(f"{prefix}_freshness_status"),
        minutes_between(event, as_of).alias(f"{prefix}_data_age_minutes"),
        minutes_between(load, as_of).alias(f"{prefix}_refresh_age_minutes"),
        minutes_between(event, load).alias(f"{prefix}_pipeline_lag_minutes"),
    ]


def latest_by_robot(
    facts: DataFrame, bridge: DataFrame, event: str, row_id: str, columns: Mapping[str, str], load: str = "dws_load_time"
) -> DataFrame:
    """Newest rollup row of each robot, whichever reference it was stored under.

    Reduced per reference first; the bridge join and second pick then run on
    at most two rows per robot.
    """
    order = [event, load, row_id]
    kept = list(dict.fromkeys([*columns, *order]))
    newest = latest_per_key(facts, ["robot_code"], order, [name for name in kept if name != "robot_code"])
    resolved = attach_by_reference(newest, bridge, "robot_code", balanced=True).drop("scope_robot_code", "robot_type")
    best = latest_per_key(resolved, ["master_robot_id"], order)
    return best.select("master_robot_id", *[F.col(source).alias(target) for source, target in columns.items()])


STATUS_LATEST = {
    "status_hourly_id": "status_hourly_id", "robot_code": "status_robot_code", "robot_id": "status_robot_id",
    "sample_count": "status_hour_sample_count", "online_sample_count": "status_hour_online_sample_count",
    "error_sample_count": "status_hour_error_sample_count", "avg_speed_mps": "last_avg_speed_mps",
    "max_speed_mps": "status_hour_max_speed_mps", "last_status_time": "status_event_time",
    "dws_load_time": "status_dws_load_time",
}
BATTERY_LATEST = {
    "battery_hourly_id": "battery_hourly_id", "robot_code": "battery_robot_code", "robot_id": "battery_robot_id",
    "sample_count": "battery_hour_sample_count", "avg_battery_soc": "last_battery_soc",
    "min_battery_soc": "battery_hour_min_soc", "max_battery_soc": "battery_hour_max_soc",
    "avg_battery_voltage": "last_battery_voltage", "avg_battery_current": "last_battery_current",
    "charging_sample_count": "battery_hour_charging_sample_count", "last_sample_time": "battery_event_time",
    "dws_load_time": "battery_dws_load_time",
}
WIFI_LATEST = {
    "wifi_hourly_id": "wifi_hourly_id", "robot_code": "wifi_robot_code", "robot_id": "wifi_robot_id",
    "sample_count": "wifi_hour_sample_count", "avg_rssi": "wifi_hour_avg_rssi", "min_rssi": "wifi_hour_min_rssi",
    "max_rssi": "wifi_hour_max_rssi", "weak_signal_sample_count": "wifi_hour_weak_signal_sample_count",
    "last_sample_time": "wifi_event_time", "dws_load_time": "wifi_dws_load_time",
}
UNMEASURED_ROBOT_FIELDS = {
    "current_status": "string", "current_mode_id": "string", "current_mode": "string",
    "source_current_mode": "string", "job_id": "string", "subjob_id": "string", "job_status": "string",
    "map_code": "string", "station_code": "string", "target_station_code": "string",
    "position_x": "decimal(18,6)", "position_y": "decimal(18,6)", "position_theta": "decimal(18,6)",
    "charging_status": "string", "error_code": "string", "error_message": "string",
    "source_snapshot_time": "timestamp",
}


def fleet_state(
    master: DataFrame, status_hourly: DataFrame, battery_hourly: DataFrame, wifi_hourly: DataFrame,
    job_daily: DataFrame, as_of: datetime, timeout: int = V.DEFAULT_FRESHNESS_MINUTES,
    robot_type: str = V.ALL_ROBOT_TYPES,
) -> DataFrame:
    """One row per active robot with its newest evidence, suppressed unless current."""
    now = lit_ts(as_of)
    scope = robot_scope(master, robot_type)
    bridge = reference_bridge(scope)
    identity = scope.select("master_robot_id", "robot_type")
    robots = lookup(
        master.select(
            F.col("id").alias("master_robot_id"), F.col("name").alias("robot_code"), F.col("name").alias("robot_name"),
            F.col("serial_number").alias("robot_serial_number"), F.col("status").alias("master_status"), "factory_id",
            "max_battery", "min_battery", F.col("updated_at").alias("master_updated_at"),
        ),
        identity, ["master_robot_id"], "inner", balanced=True,
    )
    sources = (
        latest_by_robot(status_hourly, bridge, "last_status_time", "status_hourly_id", STATUS_LATEST),
        latest_by_robot(battery_hourly, bridge, "last_sample_time", "battery_hourly_id", BATTERY_LATEST),
        latest_by_robot(wifi_hourly, bridge, "last_sample_time", "wifi_hourly_id", WIFI_LATEST),
        latest_by_robot(
            job_daily, bridge, "last_job_start_time", "job_daily_id", {"last_job_start_time": "job_event_time"}
        ),
    )
    joined = robots
    for source in sources:
        joined = lookup(joined, source, ["master_robot_id"], "left", balanced=True)
    gated = joined.select(
        "*",
        *gate_columns("status", "status_event_time", "status_dws_load_time", now, timeout),
        *gate_columns("battery", "battery_event_time", "battery_dws_load_time", now, timeout),
        *gate_columns("wifi", "wifi_event_time", "wifi_dws_load_time", now, timeout),
    )
    is_current = F.col("status_freshness_status") == V.CURRENT
    measured = gated.select(
        "*",
        F.coalesce("status_robot_code", "battery_robot_code", "wifi_robot_code").alias("source_robot_code"),
        F.coalesce("status_robot_id", "battery_robot_id", "wifi_robot_id").alias("source_robot_id"),
        F.col("status_hourly_id").isNotNull().alias("has_dws_status"),
        F.col("battery_hourly_id").isNotNull().alias("has_dws_battery"),
        F.col("wifi_hourly_id").isNotNull().alias("has_dws_wifi"),
        F.col("status_freshness_status").alias("data_freshness_status"),
        F.when(is_current, F.lit("ONLINE")).otherwise(F.lit("TIMEOUT")).alias("online_status"),
        F.lit(False).alias("current_task_supported"),
        F.lit(False).alias("is_active_job"),
        S.suppress("last_avg_speed_mps", "status_freshness_status").alias("speed_mps"),
        S.suppress("last_battery_soc", "battery_freshness_status").alias("battery_soc"),
        S.suppress("last_battery_voltage", "battery_freshness_status").alias("battery_voltage"),
        S.suppress("last_battery_current", "battery_freshness_status").alias("battery_current"),
        S.row_max("status_event_time", "battery_event_time", "wifi_event_time", "job_event_time").alias(
            "source_event_time"
        ),
        now.alias("source_anchor_time"),
        S.row_max("status_dws_load_time", "battery_dws_load_time", "wifi_dws_load_time").alias("dws_load_time"),
    ).drop(
        "status_hourly_id", "battery_hourly_id", "wifi_hourly_id", "status_robot_code", "battery_robot_code",
        "wifi_robot_code", "status_robot_id", "battery_robot_id", "wifi_robot_id", "last_avg_speed_mps",
        "last_battery_soc", "last_battery_voltage", "last_battery_current", "wifi_event_time",
    )
    return null_cols(measured, UNMEASURED_ROBOT_FIELDS)


def fleet_kpis(
    fleet: DataFrame, master: DataFrame, as_of: datetime, timeout: int = V.DEFAULT_FRESHNESS_MINUTES,
    robot_type: str = V.ALL_ROBOT_TYPES, anchors: DataFrame | None = None,
) -> DataFrame:
    """One row of fleet metrics and source freshness."""
    now = lit_ts(as_of)
    state = F.col("data_freshness_status")
    soc = F.when(F.col("battery_soc").between(*V.SOC_RANGE), F.col("battery_soc").cast("decimal(18,6)"))
    totals = fleet.agg(
        F.count(F.lit(1)).alias("total_robot_count"),
        count_if(F.col("has_dws_status") | F.col("has_dws_battery") | F.col("has_dws_wifi")).alias(
            "dws_known_robot_count"
        ),
        count_if(state == V.CURRENT).alias("current_data_robot_count"),
        count_if(state.isin(*V.TIMED_OUT_STATES)).alias("timed_out_robot_count"),
        count_if(state == V.MISSING).alias("missing_data_robot_count"),
        count_if(F.col("online_status") == "ONLINE").alias("online_robot_count"),
        count_if(F.col("online_status") == "TIMEOUT").alias("offline_robot_count"),
        count_if(F.col("battery_soc").between(*V.LOW_BATTERY_RANGE)).alias("low_battery_robot_count"),
        F.avg(soc).cast("decimal(18,2)").alias("avg_battery_soc"),
        F.max("source_event_time").alias("latest_source_event_time"),
        F.max("dws_load_time").alias("latest_dws_load_time"),
        F.max("master_updated_at").alias("latest_master_update_time"),
    ).select(
        "*",
        F.col("latest_source_event_time").alias("source_anchor_time"),
        minutes_between("latest_source_event_time", now).alias("source_anchor_lag_minutes"),
        minutes_between("latest_dws_load_time", now).alias("dws_refresh_lag_minutes"),
        F.lit(timeout).alias("freshness_timeout_minutes"),
        F.lit(V.CURRENT_SOURCE_NAME).alias("current_data_source"),
        now.alias("database_current_time"),
        S.typed_null("bigint").alias("active_job_robot_count"),
        S.typed_null("bigint").alias("alarm_robot_count"),
        S.typed_null("timestamp").alias("latest_source_snapshot_time"),
    )
    counted = commissioned(master, robot_type).agg(F.count(F.lit(1)).alias("commissioned_robot_count"))
    parts = [totals, counted] + ([anchors] if anchors is not None else [])
    return one_row(*parts)


def freshness_distribution(fleet: DataFrame, coarse: bool = False) -> DataFrame:
    """Robots per freshness label; ``coarse`` folds the states into current, delayed and missing."""
    state = S.upper_trim("data_freshness_status")
    if coarse:
        name = (
            F.when(state.isin(V.MISSING, ""), F.lit("missing"))
            .when(state == V.CURRENT, F.lit("current"))
            .otherwise(F.lit("delayed"))
        )
    else:
        name = F.lit(V.FRESHNESS_MISSING_LABEL)
        for code, text in reversed(list(V.FRESHNESS_LABELS.items())):
            name = F.when(state == code, F.lit(text)).otherwise(name)
    return (
        fleet.groupBy(name.alias("status_name")).agg(F.count(F.lit(1)).alias("robot_count"))
        .orderBy(F.desc("robot_count"), "status_name")
    )


def mode_distribution(fleet: DataFrame) -> DataFrame:
    """Placeholder row: the hourly rollups hold no operating mode."""
    return fleet.agg(F.count(F.lit(1)).alias("robot_count")).select(
        F.lit(V.MODE_PLACEHOLDER).alias("mode_name"), "robot_count"
    )


def weighted_trend(
    df: DataFrame,
    bucket: str,
    value: str,
    weight: str = "sample_count",
    mins: Sequence[str] = (),
    maxes: Sequence[str] = (),
    sums: Sequence[str] = (),
    scale: int = 2,
    out: str | None = None,
) -> DataFrame:
    """Mean weighted by sample count per bucket, with minima, maxima and sums."""
    known = F.col(value).isNotNull()
    weighted = F.sum(F.when(known, F.col(value) * F.col(weight).cast("decimal(20,0)")))
    mean = F.try_divide(weighted, F.nullif(F.sum(F.when(known, F.col(weight))), F.lit(0).cast("bigint")))
    return (
        df.groupBy(bucket)
        .agg(
            F.sum(weight).alias(weight),
            mean.cast(f"decimal(18,{scale})").alias(out or value),
            *[F.min(name).alias(name) for name in mins],
            *[F.max(name).alias(name) for name in maxes],
            *[F.sum(name).alias(name) for name in sums],
        )
        .orderBy(bucket)
    )


def status_coverage(scope: DataFrame, bridge: DataFrame, status_in_window: DataFrame) -> DataFrame:
    """Status samples, weighted mean speed and newest hour of every robot in scope."""
    known = F.col("avg_speed_mps").isNotNull()
    weighted = F.col("avg_speed_mps") * F.col("sample_count").cast("decimal(20,0)")
    sums = {
        "status_sample_count": F.col("sample_count"),
        "online_sample_count": F.col("online_sample_count"),
        "error_sample_count": F.col("error_sample_count"),
        "_speed": F.when(known, weighted),
        "_weight": F.when(known, F.col("sample_count")),
    }
    per_reference = status_in_window.groupBy("robot_code").agg(
        *[F.sum(column).alias(name) for name, column in sums.items()], F.max("stat_hour").alias("latest_status_hour")
    )
    per_robot = (
        attach_by_reference(per_reference, bridge, "robot_code", balanced=True)
        .groupBy("master_robot_id")
        .agg(*[F.sum(name).alias(name) for name in sums], F.max("latest_status_hour").alias("latest_status_hour"))
    )
    mean = F.try_divide(F.col("_speed"), F.nullif(F.col("_weight"), F.lit(0).cast("bigint"))).cast("decimal(18,4)")
    zero = F.lit(0).cast("bigint")
    return lookup(scope.select("master_robot_id", "robot_code"), per_robot, ["master_robot_id"], "left", True).select(
        "master_robot_id", "robot_code",
        *[F.coalesce(name, zero).alias(name) for name in ("status_sample_count", "online_sample_count",
                                                          "error_sample_count")],
        mean.alias("weighted_avg_speed_mps"), "latest_status_hour",
    ).orderBy("robot_code")


# --------------------------------------------------------------------------
# hourly signal rollup per robot
# --------------------------------------------------------------------------

UNMEASURED_WIFI_FIELDS = {
    "raw_current_rssi": "decimal(18,2)", "current_wifi_quality": "decimal(18,2)", "current_wifi_ap": "string",
    "current_wifi_count": "int", "current_scan_average_signal": "decimal(18,2)",
    "zero_signal_sample_count": "bigint", "zero_signal_rate": "decimal(9,2)",
    "unusable_rssi_sample_count": "bigint", "dominant_wifi_ap": "string", "highest_zero_signal_ap": "string",
    "highest_ap_zero_signal_count": "bigint",
}
ACCESS_POINT_SCHEMA = (
    "wifi_ap string, wifi_sample_count bigint, zero_signal_sample_count bigint, zero_signal_rate decimal(9,2), "
    "weak_signal_sample_count bigint, weak_signal_rate decimal(9,2), affected_robot_count bigint, "
    "avg_valid_rssi decimal(18,2), last_sample_time timestamp, risk_level string"
)


def wifi_latest(
    scope: DataFrame, bridge: DataFrame, wifi_hourly: DataFrame, as_of: datetime,
    timeout: int = V.DEFAULT_FRESHNESS_MINUTES,
) -> DataFrame:
    """Newest signal rollup of every robot in scope with its freshness gate."""
    columns = {
        "sample_count": "sample_count", "avg_rssi": "avg_rssi", "min_rssi": "min_rssi", "max_rssi": "max_rssi",
        "weak_signal_sample_count": "hour_weak_count", "last_sample_time": "latest_wifi_time",
        "dws_load_time": "wifi_dws_load_time",
    }
    newest = latest_by_robot(wifi_hourly, bridge, "last_sample_time", "wifi_hourly_id", columns)
    joined = lookup(scope.select("master_robot_id", "robot_code"), newest, ["master_robot_id"], "left", True)
    return joined.select(
        "*", *gate_columns("wifi", "latest_wifi_time", "wifi_dws_load_time", lit_ts(as_of), timeout)
    )


def wifi_robot_rows(latest: DataFrame) -> DataFrame:
    """Per-robot signal row; values appear only while current."""
    is_current = F.col("wifi_freshness_status") == V.CURRENT
    samples = F.when(is_current, F.col("sample_count")).otherwise(F.lit(0))
    weak = F.when(is_current, F.col("hour_weak_count")).otherwise(F.lit(0))
    rows = latest.select(
        "master_robot_id", "robot_code", "latest_wifi_time", is_current.alias("wifi_is_current"),
        "wifi_freshness_status", "wifi_dws_load_time", "wifi_data_age_minutes", "wifi_refresh_age_minutes",
        "wifi_pipeline_lag_minutes",
        S.suppress("avg_rssi", "wifi_freshness_status").alias("current_rssi"),
        samples.alias("wifi_sample_count"), weak.alias("weak_signal_sample_count"),
        S.percent(weak, samples).alias("weak_signal_rate"),
        S.suppress("avg_rssi", "wifi_freshness_status").alias("avg_valid_rssi"),
        S.suppress("min_rssi", "wifi_freshness_status").alias("min_valid_rssi"),
        S.suppress("max_rssi", "wifi_freshness_status").alias("max_valid_rssi"),
    )
    return null_cols(rows, UNMEASURED_WIFI_FIELDS).orderBy(F.desc("wifi_is_current"), "robot_code")


def wifi_fleet(latest: DataFrame, hours: int, as_of: datetime) -> DataFrame:
    """Fleet totals of the newest signal rollups; MISSING counts as timed out."""
    is_current = F.col("wifi_freshness_status") == V.CURRENT
    average = F.avg(F.when(is_current, F.col("avg_rssi"))).cast("decimal(18,2)")
    return latest.agg(
        F.lit(hours).alias("wifi_window_hours"),
        F.max("latest_wifi_time").alias("wifi_anchor_time"),
        F.count(F.lit(1)).alias("active_robot_count"),
        count_if(F.col("latest_wifi_time").isNotNull()).alias("wifi_known_robot_count"),
        count_if(is_current).alias("wifi_current_robot_count"),
        count_if(~is_current).alias("wifi_timed_out_robot_count"),
        F.sum(F.when(is_current, F.col("sample_count")).otherwise(F.lit(0))).alias("wifi_sample_count"),
        average.alias("avg_valid_rssi"),
        average.alias("avg_current_rssi"),
        F.max("wifi_dws_load_time").alias("latest_wifi_dws_load_time"),
    ).select(
        "*", lit_ts(as_of).alias("wifi_database_current_time"),
        S.typed_null("bigint").alias("zero_signal_sample_count"),
        S.typed_null("decimal(9,2)").alias("zero_signal_rate"),
        S.typed_null("bigint").alias("unusable_rssi_sample_count"),
    )
