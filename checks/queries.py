"""Every operator as a query over the benchmark tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions import scalar as S
from fleetlens.functions import vocab as V
from fleetlens.functions.time import WindowSpec, hours_before, trailing
from fleetlens.operators import fleet, intervals, joins, rssi, rules, scan, scope, tasks, timeline, work
from fleetlens.plans import dashboard, export, project_analytics, robot_profile, task_analytics
from fleetlens.sources import profile
from fleetlens.session import checkpoint_dir
from fleetlens.sources.driver_tables import DriverTables
from fleetlens.sources.interval_store import IntervalStore

AS_OF = datetime(2024, 1, 31)
TIMEOUT = 1440
TELEMETRY = WindowSpec(datetime(2024, 1, 1), datetime(2024, 2, 1))
# Bounds that cut intervals at both ends of the telemetry.
INNER = WindowSpec(datetime(2024, 1, 1, 7, 2, 30), datetime(2024, 1, 30, 17, 1, 10))
# The 5-minute grain exists for windows of at most six hours.
SIX_HOURS = WindowSpec(datetime(2024, 1, 30, 17, 2), datetime(2024, 1, 30, 23, 1))
ORDERS = WindowSpec(datetime(1995, 1, 1), datetime(2002, 1, 1))
# The benchmark telemetry has hours between samples, so gaps up to 12 h count.
GAP = 12 * 3600

Query = Callable[[DriverTables], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def plain(df: DataFrame) -> DataFrame:
    """Column types every engine has: decimals as doubles, timestamps without a zone."""
    out = []
    for field in df.schema:
        column = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, T.TimestampType):
            column = column.cast("timestamp_ntz")
        elif isinstance(field.dataType, T.ArrayType):
            column = F.array_join(column.cast("array<string>"), "|")
        out.append(column.alias(field.name))
    return df.select(*out)


def registered(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(QUERIES[name](DriverTables(spark, sf_dir)))

    run.__name__ = name
    return run


# -- shared pieces -----------------------------------------------------------

def _scope(t: DriverTables) -> DataFrame:
    return scope.robot_scope(t["robot_master"])


def _bridge(t: DriverTables) -> DataFrame:
    return scope.reference_bridge(_scope(t))


def _fleet(t: DriverTables) -> DataFrame:
    return fleet.fleet_state(
        t["robot_master"], t["status_hourly"], t["battery_hourly"], t["wifi_hourly"], t["job_daily"], AS_OF, TIMEOUT
    )


def _in_hours(t: DriverTables, table: str, hours: int = 720) -> DataFrame:
    bridge = _bridge(t)
    newest = scope.anchor(t[table], "stat_hour", bridge).scalar()
    return scope.in_scope(t[table].filter(trailing("stat_hour", newest, hours, "HOURS", "buckets")), bridge)


def _in_days(t: DriverTables, facts: DataFrame, days: int = 90) -> DataFrame:
    bridge = _bridge(t)
    newest = scope.anchor(facts, "stat_date", bridge).scalar()
    return scope.in_scope(facts.filter(trailing("stat_date", newest, days, "DAYS", "buckets")), bridge)


def _work(t: DriverTables) -> DataFrame:
    return work.workload(_scope(t), _bridge(t), _in_days(t, work.rollup_rows(t["job_daily"])))


def _runs(t: DriverTables) -> DataFrame:
    return work.runs_in_scope(t["task_run"], _scope(t))


def _cells(t: DriverTables) -> DataFrame:
    return work.queue_cells(_scoped(t))


def _scoped(t: DriverTables) -> DataFrame:
    return work.scoped_queue(
        t["queue_fact"], t["task_run_raw"], t["project"], t["task_dim"], t["robot_master"], ORDERS
    )


def _histogram(t: DriverTables, minutes: int = 60) -> DataFrame:
    """Running samples of the 30 days before the older of both sources' newest times."""
    robots = _scope(t)
    newest_job = t["job_history"].agg(F.max("pc_timestamp").alias("a"))
    newest_wifi = t["wifi_history"].agg(F.max("pc_timestamp").alias("a"))
    newest = newest_job.unionByName(newest_wifi).agg(F.min("a").alias("a")).scalar()
    samples = rssi.running_samples(
        t["job_history"], t["wifi_history"], robots, hours_before(newest, 720),
        newest + F.expr("INTERVAL 1 MILLISECOND"),
    )
    return rssi.rssi_histogram(samples, robots, minutes)


# -- scope and fleet -----------------------------------------------------------

@query
def robot_scope(t):
    return _scope(t)


@query
def robot_scope_amr(t):
    return scope.robot_scope(t["robot_master"], "AMR")


@query
def reference_bridge(t):
    return _bridge(t).select("robot_reference", "master_robot_id")


@query
def commissioned_count(t):
    return scope.commissioned(t["robot_master"]).agg(F.count(F.lit(1)).alias("commissioned_robot_count"))


@query
def latest_per_key(t):
    columns = {"status_hourly_id": "status_hourly_id", "last_status_time": "last_status_time",
               "dws_load_time": "dws_load_time"}
    return fleet.latest_by_robot(t["status_hourly"], _bridge(t), "last_status_time", "status_hourly_id", columns)


@query
def freshness_gate(t):
    return _fleet(t).select(
        "master_robot_id", "robot_code", "robot_type", "online_status", "status_freshness_status",
        "battery_freshness_status", "wifi_freshness_status", "status_data_age_minutes", "status_refresh_age_minutes",
        "status_pipeline_lag_minutes", "battery_soc", "speed_mps", "source_event_time", "dws_load_time",
        "has_dws_status", "job_event_time",
    )


@query
def fleet_kpis(t):
    return fleet.fleet_kpis(_fleet(t), t["robot_master"], AS_OF, TIMEOUT).drop(
        "active_job_robot_count", "alarm_robot_count", "latest_source_snapshot_time", "source_anchor_time",
        "database_current_time",
    )


@query
def freshness_distribution(t):
    return fleet.freshness_distribution(_fleet(t))


@query
def freshness_donut(t):
    return fleet.freshness_distribution(_fleet(t), coarse=True)


@query
def weighted_hourly_trend(t):
    return fleet.weighted_trend(
        _in_hours(t, "battery_hourly"), "stat_hour", "avg_battery_soc", mins=["min_battery_soc"],
        maxes=["max_battery_soc"], sums=["charging_sample_count"],
    )


@query
def status_hourly_trend(t):
    return fleet.weighted_trend(
        _in_hours(t, "status_hourly"), "stat_hour", "avg_speed_mps", maxes=["max_speed_mps"],
        sums=["online_sample_count", "error_sample_count"], scale=3,
    )


@query
def wifi_hourly_trend(t):
    return fleet.weighted_trend(
        _in_hours(t, "wifi_hourly"), "stat_hour", "avg_rssi", mins=["min_rssi"], maxes=["max_rssi", "last_sample_time"],
        sums=["weak_signal_sample_count"], out="avg_valid_rssi",
    )


@query
def wifi_fleet(t):
    latest = fleet.wifi_latest(_scope(t), _bridge(t), t["wifi_hourly"], AS_OF, TIMEOUT)
    return fleet.wifi_fleet(latest, 720, AS_OF).select(
        "wifi_anchor_time", "active_robot_count", "wifi_known_robot_count", "wifi_current_robot_count",
        "wifi_timed_out_robot_count", "wifi_sample_count", "avg_current_rssi", "latest_wifi_dws_load_time",
    )


@query
def wifi_robot_rows(t):
    latest = fleet.wifi_latest(_scope(t), _bridge(t), t["wifi_hourly"], AS_OF, TIMEOUT)
    return fleet.wifi_robot_rows(latest).select(
        "master_robot_id", "robot_code", "wifi_is_current", "wifi_freshness_status", "current_rssi",
        "wifi_sample_count", "weak_signal_sample_count", "weak_signal_rate", "min_valid_rssi",
    )


@query
def status_coverage(t):
    return fleet.status_coverage(_scope(t), _bridge(t), _in_hours(t, "status_hourly"))


@query
def overlay_robots(t):
    """Robots with their signal row laid over them."""
    latest = fleet.wifi_latest(_scope(t), _bridge(t), t["wifi_hourly"], AS_OF, TIMEOUT)
    merged = joins.overlay(_fleet(t), fleet.wifi_robot_rows(latest), "master_robot_id")
    newest = S.row_max(F.coalesce("status_event_time", "source_event_time"), "battery_event_time", "latest_wifi_time")
    return merged.select(
        "master_robot_id", "robot_code", "battery_soc", "current_rssi", "wifi_sample_count", "wifi_freshness_status",
        newest.alias("latest_data_time"),
    )


@query
def offline_ids(t):
    return rules.id_rows(_fleet(t), {
        "offline": F.col("online_status") != "ONLINE", "low_battery": S.is_low_battery("battery_soc"),
    })


@query
def text_search(t):
    robots = _fleet(t)
    return scope.search(robots, "_1").select("master_robot_id", "robot_code", "robot_serial_number")


@query
def natural_sort_rank(t):
    prefix, number, lowered, _ = S.natural_key("robot_code")
    return _scope(t).select(
        "robot_code", prefix.alias("prefix"), number.cast("bigint").alias("number"), lowered.alias("lowered")
    ).orderBy("prefix", "number", "lowered")


@query
def robot_diagnosis(t):
    return rules.diagnose(_fleet(t), AS_OF, TIMEOUT).select(
        "robot_id", "master_robot_id", "robot_type", "confidence", "severity", "rule_ids"
    )


@query
def diagnostic_groups(t):
    return rules.group_diagnostics(rules.diagnose(_fleet(t), AS_OF, TIMEOUT)).groupBy("rules", "severity").agg(
        F.sum("robot_count").alias("robot_count")
    )


@query
def alert_causes(t):
    return rules.alert_causes(_fleet(t), AS_OF, TIMEOUT).select("master_robot_id", "code", "type", "data_time")


@query
def alert_groups(t):
    return rules.group_alerts(rules.alert_causes(_fleet(t), AS_OF, TIMEOUT)).select(
        "code", "type", "robot_count", "latest_time"
    )


# -- daily rollups and outcomes ------------------------------------------------

@query
def daily_totals(t):
    jobs = _in_days(t, work.rollup_rows(t["job_daily"]))
    return work.daily_totals(
        jobs, "stat_date", ["job_count", "distinct_job_count", "completed_status_count", "failed_status_count"]
    )


@query
def daily_success_rate(t):
    jobs = _in_days(t, work.rollup_rows(t["job_daily"]))
    return work.success_rate(jobs, "completed_status_count", "failed_status_count", "success_rate_percent", ["stat_date"])


@query
def queue_daily_totals(t):
    bridge = _bridge(t)
    return work.daily_totals(
        scope.in_scope(t["queue_daily"], bridge), "stat_date",
        ["queue_count", "distinct_queue_count", "completed_status_count", "failed_status_count"],
        {"avg_duration_seconds": 2},
    )


def _outcomes(t):
    return work.unsuccessful_outcomes(scope.in_scope(t["queue_attempts"], _bridge(t)), t["robot_master"])


@query
def unsuccessful_outcomes(t):
    return _outcomes(t)


@query
def outcome_groups(t):
    return work.outcome_groups(_outcomes(t))


@query
def workload_per_robot(t):
    return _work(t)


@query
def workload_concentration(t):
    return rules.workload_groups(_work(t), _fleet(t))


@query
def workload_classification(t):
    return rules.classify_workload(_work(t), _fleet(t)).select(
        "robot_id", "master_robot_id", "robot_type", "assigned_task_count", "classification"
    )


@query
def workload_assessment(t):
    return rules.workload_assessment(rules.workload_groups(_work(t), _fleet(t))).drop("title")


@query
def workload_highlights(t):
    return rules.workload_highlights(rules.classify_workload(_work(t), _fleet(t))).select(
        "robot_id", "assigned_task_count", "classification"
    )


@query
def profile_task_breakdown(t):
    return work.task_breakdown(t["job_daily"])


# -- executions and batteries --------------------------------------------------

@query
def task_timing(t):
    return work.task_timing(_runs(t), t["duration_limit"], _scope(t))


@query
def queue_wait(t):
    return work.queue_wait(_runs(t), t["queue_source"], _scope(t))


@query
def segment_durations(t):
    return work.segment_durations(_runs(t), t["subjob"], t["subjob_type"], _scope(t))


def _share(t):
    newest = scope.anchor(
        joins.lookup(t["battery_history"], _scope(t).select(F.col("master_robot_id").alias("amr_id")), ["amr_id"],
                     "left_semi"),
        "pc_timestamp",
    ).scalar()
    samples = t["battery_history"].filter(trailing("pc_timestamp", newest, 720, "HOURS", "both"))
    share = intervals.time_weighted_share(
        samples, ["amr_id"], "pc_timestamp", "batt_level", max_gap_s=GAP, window_s=720 * 3600
    )
    return joins.attach_dim(
        share, _scope(t), {"amr_id": "master_robot_id"}, {"robot_code": "robot_code", "robot_type": "robot_type"}, "inner"
    )


@query
def battery_time_share(t):
    return _share(t)


@query
def sample_share(t):
    return profile.sample_share(t["battery_history"], _scope(t), hours=720)


@query
def operational_metrics(t):
    return rules.operational_metrics(
        work.task_timing(_runs(t), t["duration_limit"], _scope(t)),
        work.queue_wait(_runs(t), t["queue_source"], _scope(t)), _share(t),
        work.segment_durations(_runs(t), t["subjob"], t["subjob_type"], _scope(t)),
    )


def _rankings(t):
    return rules.metric_rankings(
        work.task_timing(_runs(t), t["duration_limit"], _scope(t)),
        work.queue_wait(_runs(t), t["queue_source"], _scope(t)), _share(t),
    )


@query
def on_time_ranking(t):
    return _rankings(t)["on_time"]


@query
def queue_wait_ranking(t):
    return _rankings(t)["queue_wait"]


@query
def battery_share_ranking(t):
    return _rankings(t)["battery_share"]


@query
def fleet_assessment(t):
    robots = _fleet(t)
    groups = rules.workload_groups(_work(t), robots)
    gaps = rules.measurement_gaps(profile.readiness(t, _scope(t), 90), operational_metrics(t))
    coverage = fleet.status_coverage(_scope(t), _bridge(t), _in_hours(t, "status_hourly"))
    return rules.fleet_assessment(
        rules.diagnose(robots, AS_OF, TIMEOUT), robots, coverage, rules.workload_assessment(groups), gaps
    ).drop("headline", "title", "rule_version")


# -- readiness -------------------------------------------------------------------

@query
def event_audit_coverage(t):
    return profile.event_coverage(t["operation_event"])


@query
def watermark_currency(t):
    sources = {"AMR_Queue": t["queue_raw"], "TA_AMR": t["task_run_raw"],
               "MA_AMR_Project_Assignment": t["assignment_raw"]}
    return joins.current_sources(t["watermark"], profile.watermark_anchors(sources))


@query
def readiness(t):
    return profile.readiness(t, _scope(t), 90)


@query
def measurement_gaps(t):
    return rules.measurement_gaps(profile.readiness(t, _scope(t), 90), operational_metrics(t)).select(
        "position", "metric", "status"
    )


@query
def coverage_profile(t):
    return profile.coverage_profile(
        t["task_run"],
        {"start_time_row_count": F.col("start_time").isNotNull(), "end_time_row_count": F.col("end_time").isNotNull(),
         "subjob_row_count": F.col("subjob_id") > 0},
        "start_time", 3650, "task_row_count",
    )


@query
def source_anchors(t):
    return profile.source_anchors({
        "ODS.AMR_Queue": (t["queue_raw"], "ods_row_id", "enqueued_at"),
        "ODS.TA_AMR": (t["task_run_raw"], "ods_row_id", "start_time"),
        "ODS.MA_AMR_Project_Assignment": (t["assignment_raw"], "ods_row_id", "start_time"),
    })


@query
def row_counts(t):
    return profile.row_counts({name: t[name] for name in ("task_run", "queue_fact", "operation_event", "wifi_history")})


@query
def latest_batches(t):
    return profile.latest_rows(t["etl_batch"], ["batch_id"], 10)


# -- hourly task states ------------------------------------------------------------

@query
def task_state_summary(t):
    return tasks.state_summary(t["task_hourly"], t["assigned_task_hourly"])


@query
def state_coverage_quality(t):
    return tasks.coverage_quality(tasks.state_summary(t["task_hourly"], t["assigned_task_hourly"]))


@query
def robot_picker(t):
    return tasks.robot_picker(t["task_hourly"])


@query
def state_rollup_hour(t):
    return tasks.state_rollup_trend(t["task_hourly"], 60)


@query
def state_rollup_day(t):
    return tasks.state_rollup_trend(t["task_hourly"], 1440)


@query
def state_exceptions(t):
    return tasks.state_exceptions(t["task_hourly"], t["battery_hourly"])


@query
def asof_before(t):
    return tasks.asof_before(
        t["task_hourly"].select("robot_code", "stat_hour", "data_unavailable_seconds"), t["battery_hourly"],
        ["robot_code"], "stat_hour", "stat_hour", "last_sample_time", "prior_battery_time",
        where=F.col("sample_count") > 0,
    )


@query
def idle_split(t):
    return tasks.idle_split(t["task_hourly"])


@query
def idle_minutes_trend(t):
    return tasks.idle_minutes_trend(tasks.state_rollup_trend(t["task_hourly"], 1440))


@query
def usage_minutes_trend(t):
    return tasks.usage_minutes_trend(tasks.state_rollup_trend(t["task_hourly"], 1440))


@query
def leaderboard_top10(t):
    return tasks.leaderboard(
        t["assigned_task_hourly"], "task_label", ["assigned_task_count", "completed_task_count"], "first_assigned_at",
        "last_assigned_at",
    )


@query
def calling_box_top10(t):
    return tasks.leaderboard(
        t["calling_box_hourly"], "calling_box_label", ["calling_box_count"], "first_called_at", "last_called_at"
    )


@query
def label_trend_top6(t):
    return tasks.topk_label_trend(
        t["assigned_task_hourly"], "task_label", "stat_hour", 60, ["assigned_task_count", "completed_task_count"]
    )


@query
def calling_box_trend_top6(t):
    return tasks.topk_label_trend(t["calling_box_hourly"], "calling_box_label", "stat_hour", 1440, ["calling_box_count"])


def _labels(t):
    return tasks.queue_labels(t["queue_fact"], t["robot_master"], t["task_dim"], ORDERS)


@query
def label_trend_distinct(t):
    return tasks.assigned_task_event_trend(_labels(t), 1440)


@query
def calling_box_trend_distinct(t):
    return tasks.calling_box_event_trend(_labels(t), 1440)


# -- projects --------------------------------------------------------------------

@query
def execution_per_queue(t):
    return work.execution_per_queue(t["task_run_raw"], ORDERS)


@query
def project_summary(t):
    return work.project_summary(_cells(t))


@query
def project_list(t):
    return work.project_list(_cells(t))


@query
def task_list(t):
    return work.task_list(_cells(t))


@query
def robot_breakdown(t):
    return work.robot_breakdown(_cells(t))


@query
def completion_totals(t):
    return project_analytics.completion_totals(work.robot_breakdown(_cells(t)))


@query
def project_robot_scope(t):
    """Diagnoses of the robots that carried work of the projects."""
    derived = work.robot_breakdown(_cells(t)).filter(F.col("robot_name") != V.UNMAPPED_ROBOT)
    robots = _fleet(t)
    members = scope.display_robots(robots, derived)
    return scope.restrict(rules.diagnose(robots, AS_OF, TIMEOUT), "master_robot_id", members).select(
        "robot_id", "master_robot_id", "severity"
    )


@query
def project_trend(t):
    return work.project_trend(_cells(t))


@query
def outcome_breakdown(t):
    return work.outcome_breakdown(_cells(t))


@query
def recent_evidence(t):
    return work.recent_evidence(_scoped(t))


@query
def idle_causes(t):
    return work.idle_causes(t["task_hourly"], _scoped(t))


# -- signal strength ---------------------------------------------------------------

@query
def wifi_running_summary(t):
    return rssi.stats_summary(_histogram(t))


@query
def wifi_running_trend(t):
    return rssi.stats_trend(_histogram(t))


@query
def wifi_running_by_target(t):
    return rssi.stats_by_target(_histogram(t))


@query
def wifi_running_by_robot(t):
    return rssi.stats_by_robot(_histogram(t))


@query
def wifi_running_by_robot_target(t):
    return rssi.stats_by_robot_target(_histogram(t))


@query
def wifi_minimum_witness(t):
    return rssi.minimum_witness(_histogram(t))


@query
def weak_timeline(t):
    return rssi.weak_timeline(_histogram(t))


@query
def weak_buckets(t):
    return rssi.weak_buckets(rssi.weak_timeline(_histogram(t)))


@query
def weak_peak(t):
    return rssi.weak_peak(rssi.weak_timeline(_histogram(t)))


@query
def rssi_reaggregate(t):
    return rssi.reaggregate_rssi(rssi.stats_by_robot_target(_histogram(t)), ["poi_target"])


@query
def rssi_trend_reaggregate(t):
    return rssi.reaggregate_rssi(rssi.stats_trend(_histogram(t)), ["bucket_start"])


@query
def point_comparison(t):
    return rssi.point_comparison(rssi.stats_by_robot_target(_histogram(t)))


@query
def wifi_minimum_diagnosis(t):
    h = _histogram(t)
    return rules.minimum_rssi_diagnosis(
        rssi.stats_by_target(h), rssi.stats_by_robot(h), rssi.stats_by_robot_target(h), rssi.minimum_witness(h)
    ).select("scope_type", "scope_key", "robot_code", "poi_target", "event_time", "minimum_rssi", "rule_id", "confidence",
             "cause_status")


@query
def wifi_weak_diagnosis(t):
    h = _histogram(t)
    return rules.weak_signal_diagnosis(rssi.stats_by_robot(h), rssi.stats_by_target(h)).select(
        "scope_type", "scope_robot_code", "scope_poi_target", "rule_id", "confidence", "cause_status", "priority",
        "weak_signal_sample_count", "weak_signal_rate",
    )


@query
def primary_wifi_diagnostic(t):
    h = _histogram(t)
    found = rules.weak_signal_diagnosis(rssi.stats_by_robot(h), rssi.stats_by_target(h))
    return rules.primary_diagnostic(found).select(
        "scope_robot_code", "rule_id", "weak_signal_sample_count", "weak_signal_rate"
    )


@query
def profile_wifi_hourly(t):
    return rssi.profile_wifi_hourly(t["wifi_source"])


# -- intervals ---------------------------------------------------------------------

def _executions(t):
    return intervals.execution_events(t["operation_event"])


@query
def pair_events(t):
    return joins.pair_events(_executions(t))


@query
def pair_events_clipped(t):
    return joins.pair_events(_executions(t), window=INNER)


@query
def merge_intervals(t):
    return intervals.merge_intervals(joins.pair_events(_executions(t)), ["robot_code"])


@query
def state_islands(t):
    return intervals.state_islands(
        intervals.charging_samples(t["battery_fact"]), ["robot_code"], "sample_time", "is_charging", GAP
    )


@query
def waiting_intervals(t):
    starts = _executions(t).filter(F.col("source_event_part") == V.EVENT_START)
    return intervals.queue_to_first_start(t["event_queue"], starts)


def _interval_sets(t, window):
    return intervals.state_intervals(t["operation_event"], t["battery_fact"], t["event_queue"], window, GAP)


@query
def atomic_segments(t):
    robots = intervals.active_robots(t["robot_dim"])
    return intervals.atomic_segments(robots, INNER, 60, _interval_sets(t, INNER)).select(
        "robot_code", "bucket_start", "start_time", "end_time",
        *[(F.col(kind) > 0).alias(kind) for kind in intervals.KINDS],
    )


THREE_DAYS = WindowSpec(datetime(2024, 1, 20, 5), datetime(2024, 1, 23, 5))


@query
def stored_intervals(t):
    """Executions and waits of some days, from intervals stored by day in two steps."""
    events, queue = t["operation_event"], t["event_queue"].withColumn("event_time", F.col("queue_start_time"))
    store = IntervalStore(events.sparkSession, f"{checkpoint_dir(events.sparkSession).rstrip('/')}/intervals-{uuid.uuid4().hex}")
    for upto in (date(2024, 1, 20), date(2024, 1, 31)):
        store.advance(events, queue, upto)
    ran = store.executing(THREE_DAYS).select(F.lit("executing").alias("kind"), F.col("source_ods_row_id").cast("string").alias("id"), "robot_code", "start_time", "end_time")
    return ran.unionByName(store.waiting(THREE_DAYS).select(F.lit("waiting").alias("kind"), F.col("queue_id").alias("id"), "robot_code", "start_time", "end_time"))


@query
def state_runs(t):
    sets = intervals.state_intervals(t["operation_event"], t["battery_fact"], t["event_queue"], TELEMETRY, GAP, merged=False)
    return timeline.state_runs(intervals.active_robots(t["robot_dim"]), TELEMETRY, sets)


def _trend(t, window, minutes):
    return intervals.state_trend_from_events(
        t["robot_dim"], t["operation_event"], t["battery_fact"], t["event_queue"], window, minutes, gap_seconds=GAP
    )


@query
def state_trend_5min(t):
    return _trend(t, SIX_HOURS, 5)


@query
def state_trend_15min(t):
    return _trend(t, TELEMETRY, 15)


@query
def state_trend_hour(t):
    return _trend(t, TELEMETRY, 60)


@query
def state_trend_day(t):
    return _trend(t, TELEMETRY, 1440)


# -- rules over states derived from every event ---------------------------------

RULE_LIMIT = 60


def _states(t: DriverTables) -> DataFrame:
    """A robot state per event; residues of its numbers vary all that the rules read."""
    i = F.col("event_id")
    now = F.lit(AS_OF).cast("timestamp")

    def ago(minutes: Column) -> Column:
        return now - F.make_dt_interval(mins=minutes.cast("int"))

    stopped, unmetered = i % 19 == 0, i % 23 == 0
    level = F.when(stopped, -60).when(unmetered, None).when(i % 5 == 0, 0).when(i % 5 == 1, -60).when(i % 5 == 2, -80)
    samples = 50 + (i % 3) * 60
    gate = F.when(stopped, V.CURRENT)
    for residue, name in enumerate((V.REFRESH_TIMEOUT, V.SOURCE_LAG, V.SOURCE_TIMEOUT, V.MISSING)):
        gate = gate.when(i % 13 == residue, name)
    return t._events.select(
        i.cast("int").alias("master_robot_id"), F.concat(F.lit("R"), i.cast("string")).alias("robot_code"), F.lit("AMR").alias("robot_type"),
        gate.otherwise(V.CURRENT).alias("data_freshness_status"),
        F.when(i % 3 == 0, "OFFLINE").otherwise("ONLINE").alias("online_status"),
        ago(F.when(stopped, 200).when(unmetered, 0).otherwise((i % 5) * 30)).alias("status_event_time"),
        ago(F.when(stopped, 201).otherwise((i % 4) * 25)).alias("latest_wifi_time"),
        ago(F.when(stopped, 200).otherwise((i % 6) * 20)).alias("battery_event_time"),
        level.cast("double").alias("current_rssi"), F.when(level.isNull(), 0).cast("double").alias("raw_current_rssi"),
        samples.cast("double").alias("wifi_sample_count"), F.when(i % 2 == 0, samples).otherwise(0).cast("double").alias("unusable_rssi_sample_count"),
        F.when(i % 2 == 0, "ap").otherwise("-").alias("current_wifi_ap"), (i % 7 == 0).cast("double").alias("current_wifi_count"),
        (i % 7 != 1).alias("wifi_is_current"), ((F.col("k") * 7 + i) % 101).cast("double").alias("battery_soc"),
        F.when(i % 4 == 0, "charging").otherwise("").alias("charging_status"),
        F.when(i % 17 == 0, "E7").otherwise("0").alias("error_code"), F.when(i % 34 == 0, " stuck ").alias("error_message"),
    )


@query
def robot_diagnosis_every_rule(t):
    return rules.diagnose(_states(t), AS_OF, RULE_LIMIT).select(
        "robot_id", F.col("rule_ids")[0].alias("rule_id"), "confidence", "severity"
    )


@query
def alert_causes_every_kind(t):
    return rules.alert_causes(_states(t), AS_OF, RULE_LIMIT).select("robot_id", "code", "type")


@query
def fleet_assessment_every_rule(t):
    """The fleet's assessment where every robot rule has fired."""
    robots, states = _fleet(t), _states(t)
    gaps = rules.measurement_gaps(profile.readiness(t, _scope(t), 90), operational_metrics(t))
    coverage = fleet.status_coverage(_scope(t), _bridge(t), _in_hours(t, "status_hourly"))
    workload = rules.workload_assessment(rules.workload_groups(_work(t), robots))
    found = rules.fleet_assessment(rules.diagnose(states, AS_OF, RULE_LIMIT), robots, coverage, workload, gaps)
    return found.drop("headline", "title", "rule_version")


def _varied_work(t: DriverTables) -> tuple[DataFrame, DataFrame]:
    """Workload and states of a robot per event: one type with a busiest robot, one without, one without any task."""
    i = F.col("event_id")
    kind = F.when(i % 3 == 0, "AMR").when(i % 3 == 1, "AMB").otherwise(V.OTHER_ROBOT_TYPE)
    assigned = F.when(i % 3 == 0, F.when(i % 2 == 0, 0).otherwise(10 + F.col("k"))).when(i == 1, 1_000_000_000).when(i % 3 == 1, i % 2).otherwise(0)
    work_rows = t._events.select(
        i.cast("int").alias("master_robot_id"), F.concat(F.lit("R"), i.cast("string")).alias("robot_code"), kind.alias("robot_type"),
        assigned.cast("bigint").alias("assigned_task_count"),
    )
    states = t._events.select(
        i.cast("int").alias("master_robot_id"), F.when(i % 5 == 0, "OFFLINE").otherwise("ONLINE").alias("online_status"),
        (i % 7 != 0).alias("current_task_supported"), F.when(i % 4 == 0, "charging").otherwise("").alias("charging_status"),
        F.when(i % 17 == 0, "E7").otherwise("0").alias("error_code"),
    )
    return work_rows, states


@query
def workload_every_class(t):
    return rules.classify_workload(*_varied_work(t)).select("robot_id", "robot_type", "assigned_task_count", "classification")


@query
def exception_every_type(t):
    i = F.col("event_id")
    hours = t._events.select("event_id", F.when(i % 2 == 0, 3600).otherwise(60).alias("gap"), (i % 3).alias("battery"), (i % 5).alias("task"))
    return hours.select("event_id", tasks.exception_type("gap", "battery", "task").alias("exception_type"))


@query
def asof_before_null_keys(t):
    """As-of join where keys and values are NULL on both sides."""
    left = t._events.filter(F.col("event_type") == "purchase").select(
        "event_id", F.when(F.col("event_id") % 7 != 0, F.col("user_id")).alias("key"), "ts"
    )
    right = t._events.filter(F.col("event_type") != "purchase").select(
        F.when(F.col("event_id") % 5 != 0, F.col("user_id")).alias("key"), F.col("ts").alias("at"),
        F.when(F.col("event_id") % 3 != 0, F.col("event_id")).alias("seen"),
    )
    return scan.asof_before(left, right, ["key"], "ts", "at", "seen", "prior")


# -- results of whole reports ----------------------------------------------------

@query
def dashboard_diagnostics(t):
    """Diagnoses of the dashboard report: as many as the operator gives over all robots."""
    report = dashboard.dashboard(t, AS_OF, hours=720, days=90, timeout=TIMEOUT, materialize=None)
    return report["diagnostics"].select("master_robot_id", F.col("rule_ids")[0].alias("rule_id"), "confidence", "severity")


@query
def profile_job_days(t):
    """Daily jobs of one robot, rollup and detail rows together."""
    return robot_profile.robot_profile(t, 7, AS_OF, hours=720, days=90)["job_trend"]


@query
def usage_minutes_per_robot(t):
    return tasks.usage_minutes_trend(tasks.state_rollup_trend(t["task_hourly"], 1440), per_robot=True)


@query
def daily_totals_as_is(t):
    """Daily jobs where rollup and detail rows are added up."""
    names = ["job_count", "distinct_job_count", "completed_status_count", "failed_status_count"]
    return work.daily_totals(work.rollup_rows(t["job_daily"], "as_is"), "stat_date", names)


@query
def recent_tasks(t):
    """Newest task runs of the readiness report."""
    return profile.latest_rows(t["task_run"], ["id"], 20).select("id", "amr_id", "start_time", "end_time")


def _project_report(t: DriverTables):
    return project_analytics.project_analytics(
        t, "1997-03-01T00:00", "1997-05-15T00:00", projects="1,2,3", as_of=AS_OF, materialize=None
    )


def _report_result(result: str) -> None:
    def read(t: DriverTables) -> DataFrame:
        return _project_report(t)[result]

    QUERIES[f"project_report_{result}"] = read


for _result in ("projects", "tasks", "robots", "trend", "outcomes", "recent", "displayed_totals"):
    _report_result(_result)


@query
def project_report_export(t):
    rows = export.export_dataset(_project_report(t), "project-analytics", projects="1,2,3")
    return rows.select(
        "Project", "Task", "Task_Records", "Selected_Jobs", "Selected_Projects", "Execution_Seconds", "Latest_Record", "Analysis_Start", "Analysis_End"
    )


def _task_report(t: DriverTables, robots=None):
    return task_analytics.task_analytics(t, "2024-01-05T00:00", "2024-01-25T00:00", robots, per_robot=True)


@query
def task_report_state_trend(t):
    return _task_report(t)["state_trend"]


@query
def task_report_usage(t):
    return _task_report(t, "3,5,8")["usage_trend"]


@query
def task_report_coverage(t):
    return _task_report(t)["coverage_quality"]


@query
def profile_status_hours(t):
    return robot_profile.robot_profile(t, 7, AS_OF, hours=720, days=90)["status_trend"].drop("avg_speed_mps", "max_speed_mps")
