"""Hourly task-state rollups: summaries, trends, exceptions and label charts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import vocab as V
from ..functions.scalar import count_if
from ..functions.time import WindowSpec, bucket_start, in_window
from .intervals import STATE_COLUMNS
from .joins import attach_dim, lookup, one_row
from .scan import asof_before

EVENT_COLUMNS = tuple(V.EVENT_TYPE_COUNTS)
FULL_HOUR = 3600


def state_summary(task_hourly: DataFrame, assigned_hourly: DataFrame) -> DataFrame:
    """Totals of the window's state seconds, coverage gaps, events and assignments."""
    gap = F.col("data_unavailable_seconds")
    by_robot = task_hourly.groupBy("robot_code").agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(name).alias(name) for name in STATE_COLUMNS + EVENT_COLUMNS],
        count_if(gap > 0).alias("_gaps"),
        count_if(gap == FULL_HOUR).alias("_exceptions"),
        F.max("last_source_event_time").alias("latest_source_event_time"),
        F.max("dws_load_time").alias("latest_dws_load_time"),
    )
    states = by_robot.agg(
        F.coalesce(F.sum("_rows"), F.lit(0).cast("bigint")).alias("hourly_row_count"),
        F.count("robot_code").alias("robot_count"),
        *[F.sum(name).alias(name) for name in STATE_COLUMNS],
        F.sum("_gaps").alias("data_gap_robot_hour_count"),
        F.sum("_exceptions").alias("data_exception_robot_hour_count"),
        count_if(F.col("robot_code").isNotNull() & (F.col("_exceptions") > 0)).alias("data_exception_robot_count"),
        *[F.sum(name).alias(name) for name in EVENT_COLUMNS],
        F.max("latest_source_event_time").alias("latest_source_event_time"),
        F.max("latest_dws_load_time").alias("latest_dws_load_time"),
    )
    per_robot = assigned_hourly.groupBy("robot_code").agg(
        F.sum("assigned_task_count").alias("_assigned"), F.sum("completed_task_count").alias("_completed")
    )
    assigned = per_robot.agg(
        F.coalesce(F.sum("_assigned"), F.lit(0).cast("bigint")).alias("queue_assigned_task_count"),
        F.coalesce(F.sum("_completed"), F.lit(0).cast("bigint")).alias("queue_completed_task_count"),
        F.count("robot_code").alias("task_activity_robot_count"),
    )
    return one_row(states, assigned)


def robot_picker(task_hourly: DataFrame) -> DataFrame:
    return (
        task_hourly.groupBy("robot_code")
        .agg(F.max("robot_id").alias("robot_id"), F.max("dws_load_time").alias("latest_dws_load_time"))
        .orderBy("robot_code")
    )


def state_rollup_trend(task_hourly: DataFrame, minutes: int = 60) -> DataFrame:
    """State seconds and events per bucket of at least an hour and robot."""
    return (
        task_hourly.groupBy(bucket_start("stat_hour", minutes).alias("stat_hour"), "robot_code")
        .agg(*[F.sum(name).alias(name) for name in STATE_COLUMNS + EVENT_COLUMNS])
        .orderBy("stat_hour", "robot_code")
    )


def leaderboard(
    df: DataFrame, label: str, sums: Sequence[str], first: str | None = None, last: str | None = None, k: int = 10
) -> DataFrame:
    """Top ``k`` labels by the first sum; label order settles ties."""
    aggregates = [F.sum(name).alias(name) for name in sums]
    per_robot = df.groupBy(label, "robot_code").agg(
        *aggregates,
        *([F.min(first).alias(first)] if first else []), *([F.max(last).alias(last)] if last else []),
    )
    return (
        per_robot.groupBy(label)
        .agg(
            *aggregates, F.count("robot_code").alias("robot_count"),
            *([F.min(first).alias(first)] if first else []), *([F.max(last).alias(last)] if last else []),
        )
        .orderBy(F.desc(sums[0]), label)
        .limit(k)
    )


def topk_label_trend(
    df: DataFrame, label: str, time: str, minutes: int, values: Sequence[str], k: int = 6, out: str = "stat_hour"
) -> DataFrame:
    """Sums per bucket for the ``k`` labels with the largest total."""
    cells = df.groupBy(bucket_start(time, minutes).alias(out), label).agg(*[F.sum(name).alias(name) for name in values])
    # At most k rows, so the broadcast has a fixed bound.
    top = cells.groupBy(label).agg(F.sum(values[0]).alias("_total")).orderBy(F.desc("_total"), label).limit(k)
    return cells.join(F.broadcast(top.select(label)), [label], "left_semi").select(out, label, *values).orderBy(out, label)


def topk_label_trend_distinct(
    df: DataFrame, label: str, time: str, minutes: int, item: str, total: str,
    conditions: Mapping[str, Column] | None = None, k: int = 6, out: str = "stat_hour",
) -> DataFrame:
    """Distinct items per bucket for the ``k`` labels with the most distinct items.

    ``conditions`` adds counts of distinct items that meet a condition.
    Items are made unique per bucket and label before anything is counted.
    """
    conditions = conditions or {}
    unique = df.filter(F.col(item).isNotNull()).groupBy(bucket_start(time, minutes).alias(out), label, item).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.max(F.when(condition, 1).otherwise(0)).alias(name) for name, condition in conditions.items()],
    )
    top = (
        unique.groupBy(label, item).agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(label).agg(F.count(F.lit(1)).alias("_total"))
        .orderBy(F.desc("_total"), label).limit(k)
    )
    return (
        unique.join(F.broadcast(top.select(label)), [label], "left_semi")
        .groupBy(out, label)
        .agg(F.count(F.lit(1)).alias(total), *[F.sum(name).alias(name) for name in conditions])
        .orderBy(out, label)
    )


def queue_labels(
    queue: DataFrame, master: DataFrame, task_dim: DataFrame, window: WindowSpec, robots: Sequence[str] | None = None
) -> DataFrame:
    """Queue events of known robots with their calling-box and task labels."""
    events = in_window(queue, "event_time", window).select(
        "queue_id", "event_time", "queue_status", "calling_box_id", "calling_box_name",
        S.try_int("robot_id").alias("_robot"), S.try_int("job_id").alias("job_id"),
    )
    known = attach_dim(events, master, {"_robot": "id"}, {"name": "robot_code"}, "inner").drop("_robot")
    if robots:
        known = known.filter(F.col("robot_code").isin(*robots))
    named = attach_dim(known, task_dim, {"job_id": "job_id"}, {"task_name": "task_name"})
    return named.select(
        "*", S.label("calling_box_name", "calling_box_id", V.CALLING_BOX_PREFIX).alias("calling_box_label"),
        S.label("task_name", "job_id", V.TASK_PREFIX).alias("task_label"),
    )


def calling_box_event_trend(labelled: DataFrame, minutes: int, k: int = 6) -> DataFrame:
    return topk_label_trend_distinct(
        labelled.filter(F.col("calling_box_id").isNotNull()), "calling_box_label", "event_time", minutes, "queue_id",
        "calling_box_count", k=k,
    )


def assigned_task_event_trend(labelled: DataFrame, minutes: int, k: int = 6) -> DataFrame:
    completed = S.lower_trim("queue_status").isin(*V.TREND_COMPLETED_WORDS)
    return topk_label_trend_distinct(
        labelled.filter(F.col("job_id").isNotNull()), "task_label", "event_time", minutes, "queue_id",
        "assigned_task_count", {"completed_task_count": completed}, k=k,
    )


def exception_type(gap: str, battery_events: str, task_events: str) -> Column:
    """What the evidence says about an hour without full state coverage."""
    full, no_battery = F.col(gap) == FULL_HOUR, F.col(battery_events) == 0
    return (
        F.when(full & no_battery & (F.col(task_events) == 0), F.lit("FULL_NO_BATTERY_OR_TASK_EVIDENCE"))
        .when(full & no_battery, F.lit("FULL_TASK_EVENT_WITHOUT_BATTERY_EVIDENCE"))
        .when(full, F.lit("FULL_STATE_COVERAGE_GAP_UNRESOLVED"))
        .otherwise(F.lit("PARTIAL_STATE_COVERAGE_GAP"))
    )


def state_exceptions(
    task_hourly_in_window: DataFrame, battery_hourly: DataFrame, n: int | None = None
) -> DataFrame:
    """Robot hours with a coverage gap and the evidence around them, worst and newest first; all, or the first ``n``."""
    zero = F.lit(0).cast("bigint")
    events = sum((F.col(name) for name in EVENT_COLUMNS[1:]), F.col(EVENT_COLUMNS[0]))
    gaps = task_hourly_in_window.filter(F.col("data_unavailable_seconds") > 0).select(
        "stat_hour", "robot_code", "robot_id", "data_unavailable_seconds", F.coalesce(events, zero).alias("task_event_count"),
        F.col("last_source_event_time").alias("task_event_time_in_hour"),
    )
    if n is not None:
        gaps = gaps.orderBy(F.desc("data_unavailable_seconds"), F.desc("stat_hour"), "robot_code").limit(n)
    battery = battery_hourly.select(
        "robot_code", "stat_hour", F.col("sample_count").alias("_samples"),
        F.col("charging_sample_count").alias("_charging"), F.col("last_sample_time").alias("battery_event_time_in_hour"),
    )
    with_battery = lookup(battery, gaps.select("robot_code", "stat_hour"), ["robot_code", "stat_hour"], "left_semi")
    joined = lookup(gaps, with_battery, ["robot_code", "stat_hour"], "left")
    relevant = lookup(battery_hourly, gaps.select("robot_code").distinct(), ["robot_code"], "left_semi")
    dated = asof_before(
        joined, relevant, ["robot_code"], "stat_hour", "stat_hour", "last_sample_time",
        "last_battery_event_time_before_hour", where=F.col("sample_count") > 0, chunk_seconds=30 * 86400,
    )
    return dated.select(
        "stat_hour", "robot_code", "robot_id", "data_unavailable_seconds",
        F.coalesce("_samples", zero).alias("battery_event_count"),
        F.coalesce("_charging", zero).alias("charging_sample_count"), "task_event_count",
        "battery_event_time_in_hour", "task_event_time_in_hour", "last_battery_event_time_before_hour",
    ).withColumn(
        "exception_type", exception_type("data_unavailable_seconds", "battery_event_count", "task_event_count")
    ).orderBy(F.desc("data_unavailable_seconds"), F.desc("stat_hour"), "robot_code")


def coverage_quality(summary: DataFrame) -> DataFrame:
    """Unavailable share of all state time, and hours with a partial gap only."""
    total = sum((F.col(name) for name in STATE_COLUMNS[1:]), F.col(STATE_COLUMNS[0]))
    return summary.select(
        F.coalesce(S.percent("data_unavailable_seconds", total), F.lit(0).cast("decimal(18,2)")).alias(
            "unavailable_percent"
        ),
        F.greatest(
            F.col("data_gap_robot_hour_count") - F.col("data_exception_robot_hour_count"), F.lit(0).cast("bigint")
        ).alias("partial_gap_robot_hours"),
        "data_exception_robot_hour_count",
    )


IDLE_COLUMNS = ("no_task_seconds", "waiting_seconds", "charging_seconds")


def idle_split(rows: DataFrame) -> DataFrame:
    """Idle seconds by cause and their share of all idle time."""
    totals = rows.agg(*[F.coalesce(F.sum(name), F.lit(0).cast("bigint")).alias(name) for name in IDLE_COLUMNS])
    whole = sum((F.col(name) for name in IDLE_COLUMNS[1:]), F.col(IDLE_COLUMNS[0]))
    causes = F.explode(
        F.array(*[
            F.struct(F.lit(name.removesuffix("_seconds")).alias("cause"), F.col(name).alias("seconds"))
            for name in IDLE_COLUMNS
        ])
    )
    return totals.select(whole.alias("_whole"), causes.alias("_c")).select(
        "_c.cause", "_c.seconds", S.percent("_c.seconds", "_whole").alias("share_percent")
    )


def idle_minutes_trend(trend: DataFrame) -> DataFrame:
    """Idle minutes of all robots per bucket."""
    idle = sum((F.col(name) for name in IDLE_COLUMNS[1:]), F.col(IDLE_COLUMNS[0]))
    return trend.groupBy("stat_hour").agg((F.sum(idle) / 60).alias("idle_minutes")).orderBy("stat_hour")


def usage_minutes_trend(trend: DataFrame, selected_robots: Sequence[str] = (), per_robot: bool = False) -> DataFrame:
    """Executing minutes per bucket: one series per robot if asked for, else one in all."""
    if per_robot:
        series = F.col("robot_code")
    else:
        series = F.lit("Selected fleet" if selected_robots else "All robots")
    return (
        trend.groupBy("stat_hour", series.alias("series"))
        .agg((F.sum("executing_seconds") / 60).alias("executing_minutes"))
        .orderBy("stat_hour", "series")
    )
