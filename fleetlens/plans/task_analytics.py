"""Task analytics: hourly state totals plus exact sub-hour timelines."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import (
    TASK_WINDOW, TREND_WINDOW, WindowSpec, describe_grain, in_window, lit_ts, parse_window, snap_to_hours,
)
from ..operators import intervals, scope, tasks
from ..operators.recent import newest_part

Report = dict[str, DataFrame]
ROLLUP_GRAIN = 60


def latest_end(task_hourly: DataFrame) -> datetime | None:
    """End of the newest hour the rollup holds."""
    newest = newest_part(task_hourly, "stat_hour").agg(F.max("stat_hour")).first()[0]
    return newest + timedelta(hours=1) if newest else None


def task_analytics(
    tables, start: object = None, end: object = None, robots: object = None, exception_rows: int | None = None,
    leaders: int = 10, chart_labels: int = 6, source: str | None = None, per_robot: bool = False, store=None,
) -> Report:
    """Named results for a window of at most 30 days and an optional robot selection.

    ``source`` is "events" or "rollup" for the trends, see ``trends``;
    ``per_robot`` splits the usage trend by robot; ``store`` is an ``IntervalStore``
    that is up to date with the window, for trends from events.
    """
    anchor = latest_end(tables["task_hourly"])
    window = parse_window(start, end, anchor, TASK_WINDOW)
    parse_window(window.start, window.end, anchor, TREND_WINDOW)
    full_hours = snap_to_hours(window, TASK_WINDOW)
    selected = scope.parse_list(robots)

    def hourly(name: str) -> DataFrame:
        return scope.in_or_all(in_window(tables[name], "stat_hour", full_hours), "robot_code", selected)

    states, assigned, boxes = hourly("task_hourly"), hourly("assigned_task_hourly"), hourly("calling_box_hourly")
    summary = tasks.state_summary(states, assigned).select(
        lit_ts(window.start).alias("requested_start"), lit_ts(window.end).alias("requested_end"),
        lit_ts(full_hours.start).alias("analysis_start"), lit_ts(full_hours.end).alias("analysis_end"),
        (lit_ts(anchor) if anchor else F.lit(None).cast("timestamp")).alias("latest_available_end"),
        F.lit(len(selected)).alias("selected_robot_count"), "*",
    )
    report: Report = {
        "summary": summary,
        "coverage_quality": tasks.coverage_quality(summary),
        "robots": tasks.robot_picker(tables["task_hourly"]),
        "calling_boxes": tasks.leaderboard(
            boxes, "calling_box_label", ["calling_box_count"], "first_called_at", "last_called_at", leaders
        ),
        "assigned_tasks": tasks.leaderboard(
            assigned, "task_label", ["assigned_task_count", "completed_task_count"], "first_assigned_at",
            "last_assigned_at", leaders,
        ),
        "state_exceptions": tasks.state_exceptions(states, tables["battery_hourly"], exception_rows),
    }
    report |= trends(tables, window, selected, chart_labels, source, store)
    report["idle_trend"] = tasks.idle_minutes_trend(report["state_trend"])
    report["usage_trend"] = tasks.usage_minutes_trend(report["state_trend"], selected, per_robot)
    report["idle_split"] = tasks.idle_split(states)
    return report


def trends(
    tables, window: WindowSpec, selected: Sequence[str] = (), chart_labels: int = 6, source: str | None = None,
    store=None,
) -> Report:
    """Trend results at the window's grain.

    By default hour and day buckets come from the hourly rollups, over full
    hours, and finer buckets are rebuilt from events, because a rollup hour says
    nothing about its minutes.  ``source="events"`` rebuilds buckets of any
    grain over the exact window; ``source="rollup"`` needs an hour or more.  The
    summary names the source and the bounds that were used.
    """
    grain = window.grain
    source = source or ("rollup" if grain >= ROLLUP_GRAIN else "events")
    if source not in ("rollup", "events") or source == "rollup" and grain < ROLLUP_GRAIN:
        raise ValueError(f"no {source} source for buckets of {grain} minutes")
    if source == "rollup":
        span = snap_to_hours(window)

        def hourly(name: str) -> DataFrame:
            return scope.in_or_all(in_window(tables[name], "stat_hour", span), "robot_code", selected)

        state = tasks.state_rollup_trend(hourly("task_hourly"), grain)
        counted = hourly("task_hourly")
        boxes = tasks.topk_label_trend(
            hourly("calling_box_hourly"), "calling_box_label", "stat_hour", grain, ["calling_box_count"], chart_labels
        )
        labels = tasks.topk_label_trend(
            hourly("assigned_task_hourly"), "task_label", "stat_hour", grain,
            ["assigned_task_count", "completed_task_count"], chart_labels,
        )
    else:
        span = window
        state = intervals.state_trend_from_events(
            tables["robot_dim"], tables["operation_event"], tables["battery_fact"], tables["queue_fact"], window,
            robots=selected, store=store,
        )
        counted = state
        labelled = tasks.queue_labels(
            tables["queue_fact"], tables["robot_master"], tables["task_dim"], window, selected
        )
        boxes = tasks.calling_box_event_trend(labelled, grain, chart_labels)
        labels = tasks.assigned_task_event_trend(labelled, grain, chart_labels)
    described = describe_grain(grain)
    summary = counted.agg(
        F.count(F.lit(1)).alias("trend_row_count"), F.count_distinct("robot_code").alias("robot_count")
    ).select(
        F.lit(source).alias("trend_source"), lit_ts(span.start).alias("analysis_start"), lit_ts(span.end).alias("analysis_end"),
        *[F.lit(value).alias(name) for name, value in described.items()], "trend_row_count", "robot_count",
    )
    return {
        "trend_summary": summary, "state_trend": state.orderBy("stat_hour", "robot_code"), "calling_box_trend": boxes,
        "assigned_task_trend": labels,
    }
