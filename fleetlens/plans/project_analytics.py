"""Project analytics: project to task to robot, all from one scoped relation."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.scalar import percent
from ..functions.time import PROJECT_WINDOW, describe_grain, in_window, lit_ts, parse_window, snap_to_hours
from ..operators import scope, tasks, work
from ..session import cut
from .task_analytics import latest_end

Report = dict[str, DataFrame]


def project_analytics(
    tables, start: object = None, end: object = None, projects: object = None, jobs: object = None,
    robots: object = None, display_robots: object = None, evidence_rows: int | None = None, case_insensitive: bool = False,
    as_of: datetime | None = None, materialize: Callable[[DataFrame], DataFrame] | None = cut,
) -> Report:
    """Named results for a window of at most 90 days.

    Only projects and tasks filter; robots are derived from the selected work,
    so asking for robots is an error.  ``display_robots`` narrows what the
    robot results show without changing what is counted elsewhere.
    """
    if scope.parse_list(robots):
        raise scope.ScopeError("robots are derived from the selected work and cannot be a filter")
    wanted_projects, wanted_jobs = scope.parse_id_list(projects), scope.parse_id_list(jobs)
    shown = scope.parse_list(display_robots)
    anchor = latest_end(tables["task_hourly"])
    window = parse_window(start, end, anchor or as_of, PROJECT_WINDOW)
    scoped = work.scoped_queue(
        tables["queue_fact"], tables["task_run_raw"], tables["project"], tables["task_dim"], tables["robot_master"],
        window, case_insensitive=case_insensitive,
    )
    # The records are as many as the facts; what all other results read is one row per combination.
    cells = work.queue_cells(scoped)
    if materialize:
        cells = materialize(cells)
    selected = work.select_work(cells, wanted_projects, wanted_jobs)
    evidence = work.select_work(scoped, wanted_projects, wanted_jobs)
    robot_rows = work.robot_breakdown(selected)
    hours = snap_to_hours(window)
    idle = work.idle_causes(in_window(tables["task_hourly"], "stat_hour", hours), selected)
    shown_rows = scope.in_or_all(robot_rows, "robot_name", shown)
    summary = work.project_summary(selected).select(
        lit_ts(window.start).alias("analysis_start"), lit_ts(window.end).alias("analysis_end"),
        (lit_ts(anchor) if anchor else F.lit(None).cast("timestamp")).alias("source_anchor"),
        *[F.lit(value).alias(name) for name, value in describe_grain(window.grain).items()],
        F.lit(len(wanted_projects)).alias("selected_project_count"), F.lit(len(wanted_jobs)).alias("selected_job_count"),
        "*",
    )
    return {
        "summary": summary,
        "projects": work.project_list(cells),
        "tasks": work.task_list(work.select_work(cells, wanted_projects)),
        "robots": robot_rows,
        "trend": work.project_trend(selected),
        "outcomes": work.outcome_breakdown(selected),
        "recent": work.recent_evidence(evidence, evidence_rows),
        "idle_causes": idle,
        "displayed_robots": shown_rows,
        "displayed_totals": completion_totals(shown_rows),
        "displayed_idle_split": tasks.idle_split(scope.in_or_all(idle, "robot_name", shown)),
    }


def completion_totals(robot_rows: DataFrame) -> DataFrame:
    """Records, outcomes and completion rate of the displayed robots."""
    zero = F.lit(0).cast("bigint")
    totals = robot_rows.agg(*[
        F.coalesce(F.sum(name), zero).alias(name)
        for name in ("queue_count", "completed_count", "unsuccessful_count", "execution_seconds")
    ])
    finished = F.col("completed_count") + F.col("unsuccessful_count")
    return totals.withColumn("completion_rate_percent", percent("completed_count", finished))


def diagnostics_of_project(diagnostics: DataFrame, robots: DataFrame, project_report: Report, shown: object = None) -> DataFrame:
    """Dashboard diagnoses of the robots that carried a project's work."""
    derived = project_report["robots"].filter(F.col("robot_name") != V.UNMAPPED_ROBOT)
    members = scope.display_robots(robots, derived, scope.parse_list(shown))
    return scope.restrict(diagnostics, "master_robot_id", members)
