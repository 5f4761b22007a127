"""Fleet dashboard: state, trends, outcomes, rules and running-task signal analysis."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import vocab as V
from ..functions.time import (
    WindowSpec, clamp_days, clamp_hours, clamp_int, days_before, grain_for, in_trailing, in_window, lit_ts,
    minutes_between, parse_wifi_window,
)
from ..operators import fleet, intervals, joins, recent, rssi, rules, scope, work
from ..session import cut
from ..sources import profile
from ..sources.tables import co_located

Report = dict[str, DataFrame]
RECENT_BATCHES = 10
ASSOCIATION_RULE = "RUNNING_ONLY_EXACT_TIMESTAMP"


def _anchors(tables, bridge: DataFrame, robots: DataFrame) -> dict[str, object]:
    """Newest reading of every source in scope, fetched as one row.

    Tables stored by day are read from the newest day backwards.
    """
    ids = robots.select(F.col("master_robot_id").alias("amr_id"))

    def newest(name: str, df: DataFrame, time: str, ref: DataFrame | None = bridge) -> DataFrame:
        kept = (lambda part: scope.in_scope(part, ref)) if ref is not None else None
        return scope.anchor(recent.newest_part(df, time, kept), time, ref).select(F.col("anchor").alias(name))

    def newest_by_id(name: str, table: str, time: str) -> DataFrame:
        facts = recent.newest_part(tables[table], time, lambda part: joins.lookup(part, ids, ["amr_id"], "left_semi"))
        per_robot = facts.groupBy("amr_id").agg(F.max(time).alias(time))
        return joins.lookup(per_robot, ids, ["amr_id"], "left_semi").agg(F.max(time).alias(name))

    return joins.one_row(
        newest("battery", tables["battery_hourly"], "stat_hour"),
        newest("status", tables["status_hourly"], "stat_hour"),
        newest("job", tables["job_daily"], "stat_date"),
        newest("workload", work.rollup_rows(tables["job_daily"]), "stat_date"),
        newest("queue", tables["queue_daily"], "stat_date"),
        newest("running_job", tables["job_history"], "pc_timestamp", None),
        newest("running_wifi", tables["wifi_history"], "pc_timestamp", None),
        newest_by_id("task", "task_run", "start_time"),
        newest_by_id("battery_sample", "battery_history", "pc_timestamp"),
    ).first().asDict()


def _upto(df: DataFrame, time: str, anchor: object, amount: int, unit: str, closed: str) -> DataFrame:
    """Trailing window before a known anchor; nothing when the source is empty."""
    if anchor is None:
        return df.filter(F.lit(False))
    literal = lit_ts(anchor) if isinstance(anchor, datetime) else F.lit(anchor)
    return in_trailing(df, time, literal, amount, unit, closed)


def running_wifi(
    tables, robots: DataFrame, window: WindowSpec, anchors: dict, as_of: datetime, timeout: int, is_custom: bool,
    hours: int, materialize: Callable[[DataFrame], DataFrame] | None = cut,
) -> Report:
    """Signal statistics and diagnoses of samples taken while tasks ran."""
    start, end = lit_ts(window.start), lit_ts(window.end)
    grain = grain_for(window.start, window.end - timedelta(milliseconds=1))
    samples = rssi.running_samples(tables["job_history"], tables["wifi_history"], robots, start, end)
    histogram = rssi.rssi_histogram(samples, robots, grain)
    if materialize:
        histogram = materialize(histogram)
    now = lit_ts(as_of)
    latest = [value for value in (anchors["running_job"], anchors["running_wifi"]) if value is not None]
    anchor = lit_ts(min(latest)) if latest else S.typed_null("timestamp")
    summary = rssi.stats_summary(histogram).select(
        now.alias("database_current_time"), anchor.alias("analysis_anchor_time"),
        minutes_between(anchor, now).alias("source_age_minutes"), F.lit(hours).alias("analysis_window_hours"),
        start.alias("analysis_start_time"), (end - F.expr("INTERVAL 1 MILLISECOND")).alias("analysis_end_time"),
        F.lit(is_custom).alias("is_custom_window"), F.lit(grain).alias("bucket_minutes"), "*",
        minutes_between("last_sample_time", now).alias("running_sample_age_minutes"),
        F.coalesce(minutes_between("last_sample_time", now) <= timeout, F.lit(False)).alias("is_current"),
        F.coalesce(minutes_between(anchor, now) <= timeout, F.lit(False)).alias("source_is_current"),
        F.lit(ASSOCIATION_RULE).alias("association_rule"), F.lit(V.WEAK_RSSI).alias("weak_rssi_threshold"),
    )
    by_target, by_robot = rssi.stats_by_target(histogram), rssi.stats_by_robot(histogram)
    by_pair, worst = rssi.stats_by_robot_target(histogram), rssi.minimum_witness(histogram)
    return {
        "wifi_running_summary": summary,
        "wifi_running_trend": rssi.stats_trend(histogram),
        "wifi_running_by_target": by_target,
        "wifi_running_by_robot": by_robot,
        "wifi_running_by_robot_target": by_pair,
        "wifi_running_worst_samples": worst,
        "wifi_running_weak_timeline": rssi.weak_timeline(histogram),
        "wifi_minimum_diagnostics": rules.minimum_rssi_diagnosis(by_target, by_robot, by_pair, worst),
        "wifi_weak_diagnostics": rules.weak_signal_diagnosis(by_robot, by_target),
    }


def dashboard(
    tables,
    as_of: datetime,
    hours: object = None,
    days: object = None,
    robot_type: str = V.ALL_ROBOT_TYPES,
    wifi_start: object = None,
    wifi_end: object = None,
    timeout: object = None,
    rollup: str = "only",
    robot_limit: int | None = None,
    task_sample_limit: int | None = None,
    playbook: DataFrame | None = None,
    batch_rows: int = RECENT_BATCHES,
    materialize: Callable[[DataFrame], DataFrame] | None = cut,
) -> Report:
    """All named results of the dashboard.

    ``as_of`` stands for the current time.  One job over the time columns finds
    the newest reading of every source, so that all windows are literals the
    scans use to skip files, and frames that several results read are written
    to the shared folder at once; the results themselves run when they are read.
    Rules, counts and exports see every robot; ``robot_limit`` only shortens the
    listing named ``robots``.
    ``rollup="as_is"`` sums rollup and detail rows of the daily jobs together.
    """
    hours, days = clamp_hours(hours), clamp_days(days)
    timeout = clamp_int(timeout, V.DEFAULT_FRESHNESS_MINUTES, *V.FRESHNESS_MINUTES_RANGE)
    custom = parse_wifi_window(wifi_start, wifi_end, hours)
    kind = S.normalize_robot_type(robot_type)
    master = tables["robot_master"]
    robots = scope.robot_scope(master, kind)
    bridge = scope.reference_bridge(robots)
    anchors = _anchors(tables, bridge, robots)

    def in_hours(table: str, anchor: str) -> DataFrame:
        return scope.in_scope(_upto(tables[table], "stat_hour", anchors[anchor], hours, "HOURS", "buckets"), bridge)

    def in_days(df: DataFrame, anchor: str) -> DataFrame:
        return scope.in_scope(_upto(df, "stat_date", anchors[anchor], days, "DAYS", "buckets"), bridge)

    def keep(df: DataFrame) -> DataFrame:
        return materialize(df) if materialize else df

    state = keep(fleet.fleet_state(
        master, tables["status_hourly"], tables["battery_hourly"], tables["wifi_hourly"], tables["job_daily"], as_of,
        timeout, kind,
    ))
    wifi_latest = keep(fleet.wifi_latest(robots, bridge, tables["wifi_hourly"], as_of, timeout))
    merged = keep(joins.overlay(state, fleet.wifi_robot_rows(wifi_latest), "master_robot_id").withColumn(
        "latest_data_time",
        S.row_max(F.coalesce("status_event_time", "source_event_time"), "battery_event_time", "latest_wifi_time"),
    ))
    listed = merged.orderBy("robot_name", "master_robot_id")
    if robot_limit is not None:
        listed = listed.limit(robot_limit)
    spark = master.sparkSession
    trend_anchors = spark.range(1).select(*[
        (lit_ts(value) if isinstance(value, datetime) else F.lit(value).cast(kind_of)).alias(name)
        for name, value, kind_of in (
            ("battery_trend_anchor_time", anchors["battery"], "timestamp"),
            ("status_trend_anchor_time", anchors["status"], "timestamp"),
            ("job_trend_anchor_date", anchors["job"], "date"),
            ("queue_trend_anchor_date", anchors["queue"], "date"),
        )
    ])
    kpis = fleet.fleet_kpis(state, master, as_of, timeout, kind, trend_anchors)
    # The signal trend is open at its start and anchored at the newest sample, not at an hour.
    wifi_anchor = wifi_latest.agg(F.max("latest_wifi_time")).scalar()
    wifi_rows = scope.in_scope(
        in_trailing(tables["wifi_hourly"], "stat_hour", wifi_anchor, hours, "HOURS", "right"), bridge
    )
    queue_day, attempts = anchors["queue"], tables["queue_fact"].filter(F.lit(False))
    if queue_day is not None:
        first = datetime.combine(queue_day, datetime.min.time()) - timedelta(days=days - 1)
        span = WindowSpec(first, first + timedelta(days=days))
        attempts = scope.in_scope(in_window(tables["queue_fact"], "event_time", span), bridge)

    workload = keep(work.workload(robots, bridge, in_days(work.rollup_rows(tables["job_daily"]), "workload")))
    coverage = keep(fleet.status_coverage(robots, bridge, in_hours("status_hourly", "status")))
    runs, truncated = task_runs(tables, robots, anchors["task"], days, task_sample_limit)
    timing = keep(work.task_timing(runs, tables["duration_limit"], robots, window_truncated=truncated))
    waits = keep(work.queue_wait(
        runs, tables["queue_source"], robots, co_located=co_located(tables, "task_run", "queue_source")
    ))
    segments = keep(work.segment_durations(runs, tables["subjob"], tables["subjob_type"], robots))
    battery = keep(battery_share(tables, robots, anchors["battery_sample"], hours))
    ready = keep(profile.readiness(tables, robots, days))
    coverage_source = tables["event_coverage"] if "event_coverage" in tables else profile.event_coverage(
        tables["operation_event"]
    )

    diagnostics = keep(rules.diagnose(merged, as_of, timeout, playbook))
    groups = keep(rules.workload_groups(workload, merged))
    assessment = rules.workload_assessment(groups)
    metrics = rules.operational_metrics(timing, waits, battery, segments)
    gaps = rules.measurement_gaps(ready, metrics)

    if custom.is_custom:
        signal_window = WindowSpec(custom.start, custom.end + timedelta(milliseconds=1), True, custom.hours)
    else:
        latest = [value for value in (anchors["running_job"], anchors["running_wifi"]) if value is not None]
        newest = min(latest) if latest else as_of
        signal_window = WindowSpec(
            newest - timedelta(hours=custom.hours), newest + timedelta(milliseconds=1), False, custom.hours
        )
    report: Report = {
        "summary": joins.one_row(kpis, fleet.wifi_fleet(wifi_latest, hours, as_of)),
        "robots": listed,
        "all_robots": merged,
        "status_distribution": fleet.freshness_distribution(state),
        "freshness_donut": fleet.freshness_distribution(merged, coarse=True),
        "mode_distribution": fleet.mode_distribution(state),
        "battery_trend": fleet.weighted_trend(
            in_hours("battery_hourly", "battery"), "stat_hour", "avg_battery_soc", mins=["min_battery_soc"],
            maxes=["max_battery_soc"], sums=["charging_sample_count"],
        ),
        "status_trend": fleet.weighted_trend(
            in_hours("status_hourly", "status"), "stat_hour", "avg_speed_mps", maxes=["max_speed_mps"],
            sums=["online_sample_count", "error_sample_count"], scale=3,
        ),
        "wifi_trend": fleet.weighted_trend(
            wifi_rows, "stat_hour", "avg_rssi", mins=["min_rssi"], maxes=["max_rssi", "last_sample_time"],
            sums=["weak_signal_sample_count"], out="avg_valid_rssi",
        ).withColumnsRenamed({"min_rssi": "min_valid_rssi", "max_rssi": "max_valid_rssi"}),
        "access_point_risk": scope.empty(spark, fleet.ACCESS_POINT_SCHEMA),
        "job_trend": work.daily_totals(
            in_days(work.rollup_rows(tables["job_daily"], rollup), "job"), "stat_date",
            ["job_count", "distinct_job_count", "completed_status_count", "failed_status_count"],
        ),
        "queue_trend": work.daily_totals(
            in_days(tables["queue_daily"], "queue"), "stat_date",
            ["queue_count", "distinct_queue_count", "completed_status_count", "failed_status_count"],
            {"avg_duration_seconds": 2},
        ),
        "failure_outcomes": work.unsuccessful_outcomes(attempts, master),
        "batches": profile.latest_rows(tables["etl_batch"], ["batch_id"], batch_rows),
        "workload": workload,
        "status_coverage": coverage,
        "readiness": ready,
        "task_timing": timing,
        "queue_wait": waits,
        "battery_share": battery,
        "route_segments": segments,
        "event_audit": coverage_source,
        "diagnostics": diagnostics,
        "diagnostic_groups": rules.group_diagnostics(diagnostics),
        "alerts": rules.alert_causes(merged, as_of, timeout),
        "workload_groups": groups,
        "workload_robots": rules.classify_workload(workload, merged, groups=groups, playbook=playbook),
        "workload_assessment": assessment,
        "operational_metrics": metrics,
        "measurement_gaps": gaps,
        "assessment": rules.fleet_assessment(diagnostics, merged, coverage, assessment, gaps),
    }
    report |= running_wifi(
        tables, robots, signal_window, anchors, as_of, timeout, custom.is_custom, custom.hours, materialize
    )
    return report


def task_runs(
    tables, robots: DataFrame, anchor: datetime | None, days: int, sample_limit: int | None = None
) -> tuple[DataFrame, Column]:
    """Executions of the trailing days, and whether a requested sample may have cut the window short."""
    runs = work.runs_in_scope(tables["task_run"], robots, sample_limit)
    if anchor is None:
        return runs.filter(F.lit(False)), F.lit(False)
    lower = days_before(lit_ts(anchor), days)
    truncated = F.lit(False)
    if sample_limit is not None:
        seen = runs.agg(
            ((F.count(F.lit(1)) >= sample_limit) & (F.min("start_time") > lower)).alias("cut_short")
        ).scalar()
        truncated = F.coalesce(seen, F.lit(False))
    return in_trailing(runs, "start_time", lit_ts(anchor), days, "DAYS", "both"), truncated


def battery_share(tables, robots: DataFrame, anchor: datetime | None, hours: int) -> DataFrame:
    """Time-weighted share above the level, per robot in scope."""
    samples = _upto(tables["battery_history"], "pc_timestamp", anchor, hours, "HOURS", "both")
    share = intervals.time_weighted_share(
        samples, ["amr_id"], "pc_timestamp", "batt_level", window_s=hours * 3600
    ).withColumnRenamed("amr_id", "master_robot_id")
    return joins.attach_dim(
        share, robots, {"master_robot_id": "master_robot_id"}, {"robot_code": "robot_code", "robot_type": "robot_type"},
        "inner",
    ).orderBy("robot_code")
