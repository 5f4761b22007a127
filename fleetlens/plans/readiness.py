"""Readiness profile: what the sources hold before any report is run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import seconds_between
from ..operators import scope
from ..operators.joins import attach_dim, lookup
from ..sources import profile
from ..sources.tables import SCHEMAS


def readiness_profile(
    spark: SparkSession, tables, names: Sequence[str] | None = None, days: int = 7, battery_hours: int = 24,
    evidence_rows: int = 20,
) -> dict[str, DataFrame]:
    """Schema, counts, coverage and newest rows of the source tables."""
    present = {name: tables[name] for name in (names or [n for n in SCHEMAS if n in tables])}
    schema = profile.profile_schema(spark, present)
    master, runs = tables["robot_master"], tables["task_run"]
    robots = scope.robot_scope(master)
    limits = tables["duration_limit"].groupBy("job_id", "subjob_id").agg(F.max("limit").alias("limit"))
    limited = lookup(runs, limits, ["job_id", "subjob_id"], "left")
    newest_runs = attach_dim(
        profile.latest_rows(runs, ["id"], evidence_rows), master, {"amr_id": "id"}, {"name": "robot_code"}
    ).withColumn("actual_duration_seconds", seconds_between("start_time", "end_time"))
    return {
        "schema": schema,
        "keyword_columns": profile.keyword_columns(schema),
        "row_counts": profile.row_counts(present),
        "anchors": profile.source_anchors({
            "ODS.AMR_Queue": (tables["queue_raw"], "ods_row_id", "enqueued_at"),
            "ODS.TA_AMR": (tables["task_run_raw"], "ods_row_id", "start_time"),
            "ODS.MA_AMR_Project_Assignment": (tables["assignment_raw"], "ods_row_id", "start_time"),
        }),
        "task_coverage": profile.coverage_profile(limited, {
            "start_time_row_count": F.col("start_time").isNotNull(), "end_time_row_count": F.col("end_time").isNotNull(),
            "duration_row_count": F.col("start_time").isNotNull() & F.col("end_time").isNotNull(),
            "estimated_duration_row_count": F.col("limit") > 0,
        }, "start_time", days, "task_row_count"),
        "queue_coverage": profile.coverage_profile(tables["queue_fact"], {
            "queue_start_row_count": F.col("queue_start_time").isNotNull(),
            "queue_end_row_count": F.col("queue_end_time").isNotNull(),
            "duration_row_count": F.col("duration_seconds").isNotNull(),
        }, "event_time", days, "queue_row_count"),
        "subjob_coverage": tables["subjob_fact"].agg(
            F.count(F.lit(1)).alias("subjob_row_count"),
            *[F.count(column).alias(name) for name, column in (
                ("start_time_row_count", "subjob_start_time"), ("end_time_row_count", "subjob_end_time"),
                ("duration_row_count", "duration_seconds"), ("start_station_row_count", "start_station_code"),
                ("end_station_row_count", "end_station_code"),
            )],
        ),
        "battery_sample_share": profile.sample_share(tables["battery_history"], robots, battery_hours),
        "recent_tasks": newest_runs,
        "recent_limits": profile.latest_rows(tables["duration_limit"], ["id"], evidence_rows),
    }
