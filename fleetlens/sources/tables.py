"""Warehouse tables: names, schemas and loading."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import DAY_COLUMN

# Model table -> warehouse schema and table.
WAREHOUSE_TABLES: dict[str, tuple[str, str]] = {
    "robot_master": ("dbo", "MA_AMR"),
    "project": ("dbo", "MA_AMR_Project"),
    "project_assignment": ("dbo", "MA_AMR_Project_Assignment"),
    "task_run": ("dbo", "TA_AMR"),
    "queue_source": ("dbo", "AMR_Queue"),
    "duration_limit": ("dbo", "AMR_Subjob_Analyze"),
    "subjob": ("dbo", "MA_AMR_Subjob"),
    "subjob_type": ("dbo", "MA_AMR_Subjob_Type"),
    "battery_history": ("dbo", "robot_battery_history"),
    "wifi_source": ("dbo", "robot_wifi_history"),
    "job_history": ("ODS", "robot_job_history"),
    "wifi_history": ("ODS", "robot_wifi_history"),
    "task_run_raw": ("ODS", "TA_AMR"),
    "queue_raw": ("ODS", "AMR_Queue"),
    "assignment_raw": ("ODS", "MA_AMR_Project_Assignment"),
    "queue_fact": ("DWD", "fact_amr_queue"),
    "subjob_fact": ("DWD", "fact_amr_subjob"),
    "operation_event": ("DWD", "fact_robot_operation_event"),
    "battery_fact": ("DWD", "fact_robot_battery"),
    "robot_dim": ("DWD", "dim_amr_robot"),
    "task_dim": ("DWD", "dim_amr_task"),
    "watermark": ("DWD", "robot_event_watermark"),
    "dispatch_candidate": ("DWD", "fact_dispatch_decision_candidate"),
    "incident": ("DWD", "fact_robot_incident"),
    "incident_evidence": ("DWD", "fact_robot_incident_evidence"),
    "status_hourly": ("DWS", "dws_robot_status_hourly"),
    "battery_hourly": ("DWS", "dws_robot_battery_hourly"),
    "wifi_hourly": ("DWS", "dws_robot_wifi_hourly"),
    "job_daily": ("DWS", "dws_robot_job_daily"),
    "queue_daily": ("DWS", "dws_amr_queue_daily"),
    "task_hourly": ("DWS", "dws_robot_task_hourly"),
    "calling_box_hourly": ("DWS", "dws_robot_calling_box_hourly"),
    "assigned_task_hourly": ("DWS", "dws_robot_assigned_task_hourly"),
    "etl_batch": ("DWS", "etl_batch"),
    "event_coverage": ("DWS", "v_robot_event_audit_coverage"),
}

_DEC = "decimal(18,6)"
_STATES = (
    "executing_seconds bigint, charging_seconds bigint, waiting_seconds bigint, no_task_seconds bigint, "
    "data_unavailable_seconds bigint"
)
_QUEUE = (
    "queue_fact_id bigint, queue_id string, event_time timestamp, robot_code string, robot_id string, "
    "queue_status string, project_id string, job_id string, calling_box_id int, calling_box_name string, "
    "queue_start_time timestamp, queue_end_time timestamp, duration_seconds bigint"
)

# Columns the operators read, in DDL form.
SCHEMAS: dict[str, str] = {
    "robot_master": "id int, name string, is_active string, serial_number string, status string, factory_id int, "
                    "max_battery int, min_battery int, updated_at timestamp",
    "project": "id int, name string",
    "project_assignment": "amr_id int",
    "task_run": "id bigint, amr_id int, queue_id bigint, job_id int, subjob_id int, start_time timestamp, "
                "end_time timestamp, status string",
    "queue_source": "id bigint, enqueued_at timestamp",
    "duration_limit": "id bigint, job_id int, subjob_id int, limit bigint",
    "subjob": "id int, name string, type_id int",
    "subjob_type": "id int, name string",
    "battery_history": "amr_id int, pc_timestamp timestamp, batt_level int",
    "wifi_source": "amr_id int, pc_timestamp timestamp, wifi_signal_level int",
    "job_history": "ods_row_id bigint, amr_id int, pc_timestamp timestamp, job_status string, poi_target string",
    "wifi_history": "ods_row_id bigint, amr_id int, pc_timestamp timestamp, wifi_signal_level int",
    "task_run_raw": "ods_row_id bigint, queue_id bigint, start_time timestamp, end_time timestamp, status string",
    "queue_raw": "ods_row_id bigint, enqueued_at timestamp",
    "assignment_raw": "ods_row_id bigint, start_time timestamp",
    "queue_fact": _QUEUE,
    "subjob_fact": "robot_code string, robot_id string, subjob_start_time timestamp, subjob_end_time timestamp, "
                   "duration_seconds bigint, start_station_code string, end_station_code string",
    "operation_event": "source_schema string, source_table string, source_ods_row_id bigint, source_event_part string, "
                       "event_time timestamp, event_category string, event_type string, event_status string, "
                       "robot_code string, robot_id string, queue_id string, dwd_load_time timestamp",
    "battery_fact": "robot_code string, sample_time timestamp, charging_status string",
    "robot_dim": "robot_code string, robot_id string, is_enabled boolean",
    "task_dim": "job_id int, task_name string",
    "watermark": "source_schema string, source_table string, last_ods_row_id bigint",
    "dispatch_candidate": "decision_id bigint, task_id bigint, robot_id string, eligibility_result string, "
                          "total_score double, selected_flag boolean, rejection_reason_code string",
    "incident": "incident_id bigint",
    "incident_evidence": "incident_evidence_id bigint",
    "status_hourly": f"status_hourly_id bigint, robot_code string, robot_id string, stat_hour timestamp, "
                     f"sample_count bigint, online_sample_count bigint, error_sample_count bigint, "
                     f"avg_speed_mps {_DEC}, max_speed_mps {_DEC}, first_status_time timestamp, "
                     f"last_status_time timestamp, dws_load_time timestamp",
    "battery_hourly": f"battery_hourly_id bigint, robot_code string, robot_id string, stat_hour timestamp, "
                      f"sample_count bigint, avg_battery_soc {_DEC}, min_battery_soc {_DEC}, max_battery_soc {_DEC}, "
                      f"avg_battery_voltage {_DEC}, avg_battery_current {_DEC}, avg_battery_power {_DEC}, "
                      f"charging_sample_count bigint, first_sample_time timestamp, last_sample_time timestamp, "
                      f"dws_load_time timestamp",
    "wifi_hourly": f"wifi_hourly_id bigint, robot_code string, robot_id string, stat_hour timestamp, "
                   f"sample_count bigint, avg_rssi {_DEC}, min_rssi {_DEC}, max_rssi {_DEC}, "
                   f"weak_signal_sample_count bigint, last_sample_time timestamp, dws_load_time timestamp",
    "job_daily": "job_daily_id bigint, robot_code string, stat_date date, job_type_code string, robot_mode_id string, "
                 "robot_mode_detail string, job_count bigint, distinct_job_count bigint, "
                 "completed_status_count bigint, failed_status_count bigint, first_job_start_time timestamp, "
                 "last_job_start_time timestamp, dws_load_time timestamp",
    "queue_daily": "robot_code string, stat_date date, queue_count bigint, distinct_queue_count bigint, "
                   "completed_status_count bigint, failed_status_count bigint, avg_duration_seconds decimal(18,2)",
    "task_hourly": f"stat_hour timestamp, robot_code string, robot_id string, {_STATES}, "
                   f"accepted_queue_count bigint, task_started_count bigint, subtask_started_count bigint, "
                   f"task_completed_count bigint, first_source_event_time timestamp, "
                   f"last_source_event_time timestamp, dws_load_time timestamp",
    "calling_box_hourly": "stat_hour timestamp, robot_code string, calling_box_label string, calling_box_count bigint, "
                          "first_called_at timestamp, last_called_at timestamp",
    "assigned_task_hourly": "stat_hour timestamp, robot_code string, task_label string, assigned_task_count bigint, "
                            "completed_task_count bigint, first_assigned_at timestamp, last_assigned_at timestamp",
    "etl_batch": "batch_id bigint, batch_start_time timestamp, batch_end_time timestamp, batch_status string, "
                 "error_message string",
    "event_coverage": "source_schema string, source_table string, event_category string, event_type string, "
                      "event_count bigint, robot_attributed_event_count bigint, first_event_time timestamp, "
                      "latest_event_time timestamp, latest_load_time timestamp",
}

# Rollups and facts are best laid out by day: every report reads a time window.
PARTITION_TIME = {
    "wifi_history": "pc_timestamp", "job_history": "pc_timestamp", "battery_history": "pc_timestamp",
    "wifi_source": "pc_timestamp", "operation_event": "event_time", "queue_fact": "event_time",
    "battery_fact": "sample_time", "task_run": "start_time", "task_run_raw": "start_time",
    "status_hourly": "stat_hour", "battery_hourly": "stat_hour", "wifi_hourly": "stat_hour", "task_hourly": "stat_hour",
}

# Facts that are joined or grouped by one queue record, and the column that names it.
BUCKET_KEY = {"task_run": "queue_id", "queue_source": "id", "task_run_raw": "queue_id"}

Tables = Mapping[str, DataFrame]


UTC_NAMES = ("UTC", "Etc/UTC", "Z", "GMT", "+00:00")  # zones in which wall-clock readings stay as they are


def to_model(df: DataFrame, name: str) -> DataFrame:
    """Columns of a source in model names and types; zone-less readings become session timestamps.

    A table stored by day keeps its day column, which windows use to skip
    folders.
    """
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    if zone not in UTC_NAMES:
        raise ValueError(f"the session's time zone is {zone}; the model's wall-clock times need spark.sql.session.timeZone=UTC")
    wanted = df.sparkSession.createDataFrame([], SCHEMAS[name]).schema
    present = {column.lower(): column for column in df.columns}
    missing = [field.name for field in wanted if field.name.lower() not in present]
    if missing:
        raise ValueError(f"{name} lacks columns: {', '.join(missing)}")
    columns = [F.col(present[f.name.lower()]).cast(f.dataType).alias(f.name) for f in wanted]
    if name in PARTITION_TIME and DAY_COLUMN in present:
        columns.append(F.col(present[DAY_COLUMN]))
    return df.select(*columns)


class WarehouseTables(dict):
    """Tables by model name, opened on first use."""

    def __init__(self, opener, names: Iterable[str], buckets=None):
        super().__init__()
        self._opener, self.names, self._buckets = opener, tuple(names), buckets

    def buckets(self, name: str) -> tuple[str, int] | None:
        """Column and number of the table's buckets, if it is stored in buckets by one column."""
        return self._buckets(name) if self._buckets and name in self.names else None

    def __missing__(self, name: str) -> DataFrame:
        if name not in self.names:
            raise KeyError(name)
        self[name] = self._opener(name)
        return self[name]

    def __contains__(self, name: object) -> bool:
        return name in self.names


def load_parquet(spark: SparkSession, base: str, names: Iterable[str] = tuple(SCHEMAS)) -> WarehouseTables:
    """Model tables stored as one Parquet folder each."""
    return WarehouseTables(lambda name: to_model(spark.read.parquet(f"{base.rstrip('/')}/{name}"), name), names)


def load_catalog(spark: SparkSession, database: str | None = None, names: Iterable[str] = tuple(SCHEMAS)) -> WarehouseTables:
    """Model tables registered in the session catalog."""
    prefix = f"{database}." if database else ""

    def buckets(name: str) -> tuple[str, int] | None:
        told = {row["col_name"]: row["data_type"] for row in spark.sql(f"DESCRIBE EXTENDED {prefix}{name}").collect()}
        columns = re.findall(r"`([^`]+)`", told.get("Bucket Columns", ""))
        return (columns[0], int(told["Num Buckets"])) if len(columns) == 1 else None

    return WarehouseTables(lambda name: to_model(spark.table(prefix + name), name), names, buckets)


def co_located(tables: Tables, one: str, other: str) -> bool:
    """Whether two facts lie in equally many buckets of the same queue records, so that a join shuffles neither."""
    spec = getattr(tables, "buckets", lambda name: None)
    found = [spec(name) for name in (one, other)]
    return all(found) and found[0][1] == found[1][1] and all(b[0] == BUCKET_KEY.get(n) for b, n in zip(found, (one, other)))


def jdbc_options(
    name: str, url: str, properties: Mapping[str, str], split: tuple[str, object, object, int] | None = None
) -> dict[str, str]:
    """Reader options of one warehouse table; ``split`` is (column, lower, upper, parts)."""
    schema, table = WAREHOUSE_TABLES[name]
    options = {"url": url, "dbtable": f"[{schema}].[{table}]", "fetchsize": "10000", **properties}
    if split:
        column, lower, upper, parts = split
        options |= {
            "partitionColumn": column, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(parts),
        }
    return options


def split_points(df: DataFrame, column: str, parts: int) -> list:
    """Values that divide the rows of a stored copy into ``parts`` of about the same size.

    They are quantiles, not steps from the smallest to the largest value; one
    that holds more rows than a part stands there several times.
    """
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(column, shares, max(10_000, 100 * parts)).alias("points")).first()["points"]
    return list(found or [])


def split_predicates(column: str, points: Sequence, hot_by: str | None = None, quotes: str = "[]") -> list[str]:
    """Conditions of which every row meets exactly one, NULLs the first.

    Rows of a value that repeats among the points are divided by the remainder
    of ``hot_by``, a whole-number column, if one is named.
    """
    def named(name: str) -> str:
        return quotes[0] + name + quotes[-1]

    col, times = named(column), Counter(points)
    found, lower = [], None
    for value in sorted(times):
        shown = repr(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"
        below = f"{col} < {shown}"
        found.append(f"{lower} AND {below}" if lower else f"({below} OR {col} IS NULL)")
        lower = f"{col} >= {shown}"
        if times[value] > 1:
            ways = times[value] if hot_by else 1
            for i in range(ways):
                rest = f"ABS({named(hot_by)} % {ways}) = {i}" if hot_by else "1 = 1"
                found.append(f"{col} = {shown} AND " + (f"({rest} OR {named(hot_by)} IS NULL)" if hot_by and not i else rest))
            lower = f"{col} > {shown}"
    return [*found, lower] if lower else ["1 = 1"]


def load_jdbc(
    spark: SparkSession, url: str, properties: Mapping[str, str], splits: Mapping[str, tuple | list[str]] | None = None,
    names: Iterable[str] = tuple(SCHEMAS),
) -> WarehouseTables:
    """Model tables read from the warehouse; filters and columns are pushed to the database.

    ``splits`` names how tables are read by several tasks: by a list of
    conditions, see ``split_predicates``, or evenly by value from (column,
    lower, upper, parts).
    """
    def opened(name: str) -> DataFrame:
        split = (splits or {}).get(name)
        if isinstance(split, list):
            options = jdbc_options(name, url, properties)
            rest = {key: value for key, value in options.items() if key not in ("url", "dbtable")}
            return to_model(spark.read.jdbc(url, options["dbtable"], predicates=split, properties=rest), name)
        return to_model(spark.read.format("jdbc").options(**jdbc_options(name, url, properties, split)).load(), name)

    return WarehouseTables(opened, names)


def write_model(df: DataFrame, base: str, name: str, key: str | None = None) -> None:
    """Store a model table by day, sorted by key and time inside files for range skipping.

    Ranges, not hashes, divide the rows, so a busy robot or day is spread over
    several files.
    """
    path, time = f"{base.rstrip('/')}/{name}", PARTITION_TIME.get(name)
    if time is None:
        df.write.mode("overwrite").parquet(path)
        return
    order = [DAY_COLUMN, *([key] if key else []), time]
    dated = df.withColumn(DAY_COLUMN, F.to_date(time)).repartitionByRange(*order).sortWithinPartitions(*order)
    dated.write.mode("overwrite").partitionBy(DAY_COLUMN).parquet(path)


def write_buckets(df: DataFrame, base: str, name: str, buckets: int, database: str | None = None) -> None:
    """Store a fact by day and in buckets of its queue record, as a catalog table under ``base``.

    Facts written with the same number of buckets are joined and grouped by
    queue record without a shuffle.  Choose it so that a day's bucket makes a
    file of some 128 MB; a day has one file for each bucket.
    """
    key, time = BUCKET_KEY[name], PARTITION_TIME.get(name)
    dealt = df.withColumn(DAY_COLUMN, F.to_date(time)) if time else df
    writer = dealt.repartition(buckets, key).write.mode("overwrite").option("path", f"{base.rstrip('/')}/{name}")
    if time:
        writer = writer.partitionBy(DAY_COLUMN)
    writer.bucketBy(buckets, key).sortBy(key).saveAsTable(f"{database}.{name}" if database else name)
