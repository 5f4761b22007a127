"""Readiness probes: table health, schema and coverage profiles, source anchors."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.scalar import count_if, percent
from ..functions.time import in_trailing
from ..operators.joins import attach_dim, current_sources, lookup, one_row
from ..operators.recent import newest_part, newest_time

HEALTH_TABLES = ("status_hourly", "battery_hourly", "wifi_hourly")


def health(spark: SparkSession, names: Iterable[str] = HEALTH_TABLES, database: str | None = None) -> DataFrame:
    """Which of the needed tables the catalog holds."""
    prefix = f"{database}." if database else ""
    rows = [(name, bool(spark.catalog.tableExists(prefix + name))) for name in names]
    return spark.createDataFrame(rows, "table_name string, table_exists boolean")


def required_field_count(df: DataFrame | None, fields: Sequence[str] = V.DISPATCH_AUDIT_FIELDS) -> int:
    """How many of the contract's fields the relation has; none when it does not exist."""
    return len(set(df.columns) & set(fields)) if df is not None else 0


def profile_schema(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per column of the given tables."""
    rows = [
        (name, position, field.name, field.dataType.simpleString(), field.nullable)
        for name, df in tables.items() for position, field in enumerate(df.schema, 1)
    ]
    return spark.createDataFrame(
        rows, "table_name string, column_id int, column_name string, data_type string, is_nullable boolean"
    )


def keyword_columns(profile: DataFrame, keywords: Sequence[str] = V.SCHEMA_KEYWORDS) -> DataFrame:
    """Columns whose name contains one of the keywords."""
    return profile.filter(F.lower("column_name").rlike("|".join(keywords))).orderBy("table_name", "column_name")


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return _union(parts)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    first, *others = parts
    for part in others:
        first = first.unionByName(part)
    return first


def coverage_profile(
    df: DataFrame, conditions: Mapping[str, Column], time_col: str, days: int = 7, row_count: str = "row_count"
) -> DataFrame:
    """Rows meeting each condition, and the time span, over the trailing days of the source."""
    recent = in_trailing(df, time_col, newest_time(df, time_col), days, "DAYS", "both")
    return recent.agg(
        F.count(F.lit(1)).alias(row_count), *[count_if(condition).alias(name) for name, condition in conditions.items()],
        F.min(time_col).alias("first_time"), F.max(time_col).alias("last_time"),
    )


def source_anchors(sources: Mapping[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Lowest and highest row id and time of each source; values are (relation, id, time)."""
    return _union([
        df.agg(
            F.min(row_id).cast("bigint").alias("min_ods_row_id"), F.max(row_id).cast("bigint").alias("max_ods_row_id"),
            F.min(time).alias("min_event_time"), F.max(time).alias("max_event_time"),
        ).select(F.lit(name).alias("source_object"), "*")
        for name, (df, row_id, time) in sources.items()
    ])


def sample_share(
    samples: DataFrame, scope: DataFrame, hours: int = 24, above: int = V.BATTERY_SHARE_LEVEL
) -> DataFrame:
    """Share of battery samples above a level, by count, over the trailing hours."""
    recent = in_trailing(samples, "pc_timestamp", newest_time(samples, "pc_timestamp"), hours, "HOURS", "both")
    per_robot = recent.groupBy("amr_id").agg(
        F.count(F.lit(1)).alias("sample_count"), count_if(F.col("batt_level") > above).alias(f"above_{above}_sample_count"),
        F.min("pc_timestamp").alias("first_sample_time"), F.max("pc_timestamp").alias("last_sample_time"),
    )
    named = attach_dim(per_robot, scope, {"amr_id": "master_robot_id"}, {"robot_code": "robot_code"}, "inner")
    return named.drop("amr_id").withColumn(
        f"above_{above}_sample_share_percent", percent(f"above_{above}_sample_count", "sample_count")
    ).orderBy("robot_code")


def latest_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The ``n`` newest rows by the order columns."""
    return df.orderBy(*[F.desc(name) for name in order]).limit(n)


def event_coverage(events: DataFrame) -> DataFrame:
    """Operation events by source and type: how many, how many with a robot, and from when to when."""
    return (
        events.groupBy("source_schema", "source_table", "event_category", "event_type")
        .agg(
            F.count(F.lit(1)).alias("event_count"), F.count("robot_id").alias("robot_attributed_event_count"),
            F.min("event_time").alias("first_event_time"), F.max("event_time").alias("latest_event_time"),
            F.max("dwd_load_time").alias("latest_load_time"),
        )
        .orderBy("source_schema", "source_table", "event_category", "event_type")
    )


def in_scope_by_code_or_id(facts: DataFrame, scope: DataFrame) -> DataFrame:
    """Facts whose robot code is a robot's name or whose robot id is its id.

    The choice is made once per distinct (code, id) pair, then applied to the
    facts with an equality join.
    """
    code, robot_id = F.coalesce("robot_code", F.lit("")), F.coalesce("robot_id", F.lit(""))
    pairs = facts.select(code.alias("_code"), robot_id.alias("_id")).distinct()
    codes = scope.select(F.col("robot_code").alias("_code"), F.lit(True).alias("_by_code")).distinct()
    ids = scope.select(F.col("master_robot_id").cast("string").alias("_id"), F.lit(True).alias("_by_id")).distinct()
    hits = lookup(lookup(pairs, codes, ["_code"]), ids, ["_id"]).filter(
        F.col("_by_code").isNotNull() | F.col("_by_id").isNotNull()
    ).select("_code", "_id")
    tagged = facts.withColumns({"_code": code, "_id": robot_id})
    return lookup(tagged, hits, ["_code", "_id"], "left_semi").select(*facts.columns)


def watermark_anchors(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Newest row id of each raw source, keyed like the watermark table."""
    return _union([
        df.agg(F.max("ods_row_id").cast("bigint").alias("source_max_ods_row_id")).select(
            F.lit(V.EVENT_SOURCE_SCHEMA).alias("source_schema"), F.lit(table).alias("source_table"),
            "source_max_ods_row_id",
        )
        for table, df in sources.items()
    ])


def readiness(tables, scope: DataFrame, days: int = 7) -> DataFrame:
    """One row of counts telling which analyses the sources can support."""
    queue = in_scope_by_code_or_id(tables["queue_fact"], scope)
    newest = newest_part(queue, "event_time").agg(F.max("event_time").alias("queue_history_anchor_time"))
    queue_counts = in_trailing(queue, "event_time", newest.scalar(), days, "DAYS", "both").agg(
        F.count(F.lit(1)).alias("queue_row_count"), F.count("duration_seconds").alias("queue_duration_row_count")
    )
    subjobs = in_scope_by_code_or_id(tables["subjob_fact"], scope).agg(F.count(F.lit(1)).alias("subjob_row_count"))
    robots = scope.select(F.col("master_robot_id").alias("amr_id"))
    assignments = lookup(tables["project_assignment"], robots, ["amr_id"], "left_semi").agg(
        F.count(F.lit(1)).alias("dispatch_assignment_row_count")
    )
    candidates = tables["dispatch_candidate"]
    audit = candidates.agg(F.count(F.lit(1)).alias("dispatch_audit_row_count")).withColumn(
        "dispatch_audit_field_count", F.lit(required_field_count(candidates)).cast("bigint")
    )
    events = tables["operation_event"].agg(
        F.count(F.lit(1)).alias("operation_event_row_count"),
        F.count("robot_id").alias("operation_event_robot_attributed_count"),
        F.max("event_time").alias("operation_event_latest_time"),
    )
    marks = tables["watermark"]
    sources = {
        "AMR_Queue": tables["queue_raw"], "TA_AMR": tables["task_run_raw"],
        "MA_AMR_Project_Assignment": tables["assignment_raw"],
    }
    return one_row(
        newest, queue_counts, subjobs, assignments, audit, events,
        marks.agg(F.count(F.lit(1)).alias("audit_watermark_source_count")),
        current_sources(marks, watermark_anchors(sources)).agg(F.count(F.lit(1)).alias("audit_sources_current_count")),
        tables["incident"].agg(F.count(F.lit(1)).alias("incident_row_count")),
        tables["incident_evidence"].agg(F.count(F.lit(1)).alias("incident_evidence_row_count")),
    )
