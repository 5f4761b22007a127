"""Workload, task timing, queue waits, outcomes and project breakdowns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import vocab as V
from ..functions.scalar import count_if, percent, ratio
from ..functions.time import WindowSpec, bucket_start, in_window, millis_between, seconds_between
from .joins import attach_by_reference, attach_dim, latest_per_key, lookup


def _zero() -> Column:
    return F.lit(0).cast("bigint")


# --------------------------------------------------------------------------
# daily rollups
# --------------------------------------------------------------------------

def rollup_rows(job_daily: DataFrame, rollup: str = "only") -> DataFrame:
    """Choose between the all-types rollup rows and the detail rows stored beside them.

    ``as_is`` keeps both and therefore counts jobs twice.
    """
    marked = (F.col("job_type_code") == V.ROLLUP_MARK) & (F.col("robot_mode_id") == V.ROLLUP_MARK)
    if rollup == "only":
        return job_daily.filter(marked)
    if rollup == "detail":
        return job_daily.filter(~F.coalesce(marked, F.lit(False)))
    if rollup == "as_is":
        return job_daily
    raise ValueError(f"unknown rollup choice: {rollup}")


def daily_totals(
    df: DataFrame, date: str, sums: Sequence[str], avgs: Mapping[str, int] | None = None
) -> DataFrame:
    """Sums, and unweighted means of daily averages, per date."""
    means = [F.avg(name).cast(f"decimal(18,{scale})").alias(name) for name, scale in (avgs or {}).items()]
    return df.groupBy(date).agg(*[F.sum(name).alias(name) for name in sums], *means).orderBy(date)


def workload(scope: DataFrame, bridge: DataFrame, job_daily_in_window: DataFrame) -> DataFrame:
    """Assigned, completed and unsuccessful tasks of every robot in scope."""
    sums = {
        "assigned_task_count": "distinct_job_count",
        "completed_task_count": "completed_status_count",
        "unsuccessful_task_count": "failed_status_count",
    }
    per_reference = job_daily_in_window.groupBy("robot_code").agg(
        *[F.sum(source).alias(name) for name, source in sums.items()],
        F.min("stat_date").alias("first_workload_date"), F.max("stat_date").alias("latest_workload_date"),
    )
    per_robot = (
        attach_by_reference(per_reference, bridge, "robot_code", balanced=True)
        .groupBy("master_robot_id")
        .agg(
            *[F.sum(name).alias(name) for name in sums],
            F.min("first_workload_date").alias("first_workload_date"),
            F.max("latest_workload_date").alias("latest_workload_date"),
        )
    )
    return lookup(scope, per_robot, ["master_robot_id"], "left", balanced=True).select(
        "master_robot_id", "robot_code", "robot_type",
        *[F.coalesce(name, _zero()).alias(name) for name in sums], "first_workload_date", "latest_workload_date",
    ).orderBy("robot_type", F.desc("assigned_task_count"), "robot_code")


def task_breakdown(job_daily_in_window: DataFrame) -> DataFrame:
    """Job counts by task type and operating mode; rollup rows get readable names."""
    all_types = F.col("job_type_code") == V.ROLLUP_MARK
    all_modes = F.col("robot_mode_id") == V.ROLLUP_MARK

    def named(column: str, is_rollup: Column, rollup_name: str, missing: str) -> Column:
        return F.when(is_rollup, F.lit(rollup_name)).otherwise(S.fallback(S.blank_to_null(column), missing)).alias(column)

    return (
        job_daily_in_window.groupBy(
            named("job_type_code", all_types, V.ROLLUP_TASK_LABEL, V.NOT_REPORTED_CODE),
            named("robot_mode_id", all_modes, V.ROLLUP_MODE_LABEL, V.NOT_REPORTED_CODE),
            named("robot_mode_detail", all_types & all_modes, V.ROLLUP_DETAIL_LABEL, V.NOT_REPORTED_TEXT),
        )
        .agg(
            *[F.sum(name).alias(name) for name in
              ("job_count", "distinct_job_count", "completed_status_count", "failed_status_count")],
            F.max("last_job_start_time").alias("latest_job_time"),
        )
        .orderBy(F.desc("job_count"), "job_type_code", "robot_mode_id")
    )


# --------------------------------------------------------------------------
# outcomes
# --------------------------------------------------------------------------

def failure_rank(status: str) -> Column:
    text = S.upper_trim(status)
    chain = F.lit(V.NO_FAILURE_RANK)
    for rank, words in reversed(list(V.FAILURE_WORDS.items())):
        chain = F.when(text.isin(*words), F.lit(rank)).otherwise(chain)
    return chain


def unsuccessful_outcomes(queue: DataFrame, master: DataFrame) -> DataFrame:
    """Queue records that failed and never completed, by outcome and robot.

    Attempts of a record on one day count once, under their gravest outcome.
    ``queue`` is already limited to the window and scope.
    """
    robot = F.coalesce(S.blank_to_null("robot_code"), S.blank_to_null("robot_id"), F.lit(V.UNKNOWN_OUTCOME))
    records = (
        queue.filter(S.blank_to_null("queue_id").isNotNull())
        .groupBy(
            F.to_date("event_time").alias("stat_date"), robot.alias("source_robot_reference"),
            S.blank_to_null("queue_id").alias("queue_id"),
        )
        .agg(
            F.max(F.when(S.upper_trim("queue_status").isin(*V.COMPLETED_WORDS), 1).otherwise(0)).alias("_completed"),
            F.min(failure_rank("queue_status")).alias("_rank"),
            F.max("event_time").alias("_latest"),
        )
        .filter((F.col("_completed") == 0) & (F.col("_rank") < V.NO_FAILURE_RANK))
    )
    counted = records.groupBy("_rank", "source_robot_reference").agg(
        F.count(F.lit(1)).alias("failure_count"), F.max("_latest").alias("latest_failure_time")
    )
    named = attach_dim(
        counted.withColumn("_id", S.try_int("source_robot_reference")), master, {"_id": "id"}, {"name": "_name"}
    )
    outcome = F.lit(V.UNKNOWN_OUTCOME)
    for rank, name in V.FAILURE_NAMES.items():
        outcome = F.when(F.col("_rank") == rank, F.lit(name)).otherwise(outcome)
    return named.select(
        outcome.alias("failure_outcome"), F.coalesce("_name", "source_robot_reference").alias("robot_code"),
        "source_robot_reference", "failure_count", "latest_failure_time",
    ).orderBy(F.desc("failure_count"), "failure_outcome", "robot_code")


def outcome_groups(outcomes: DataFrame) -> DataFrame:
    """Unsuccessful outcomes regrouped over robots."""
    return (
        outcomes.groupBy(S.upper_trim("failure_outcome").alias("failure_outcome"))
        .agg(
            F.sum("failure_count").alias("failure_count"),
            F.count_distinct("robot_code").alias("robot_count"),
            F.max("latest_failure_time").alias("latest_failure_time"),
        )
        .orderBy(F.desc("failure_count"), "failure_outcome")
    )


def success_rate(df: DataFrame, completed: str, failed: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """Completed share of all finished work, in percent; NULL when nothing finished."""
    sums = df.groupBy(*keys).agg(F.sum(completed).alias(completed), F.sum(failed).alias(failed))
    return sums.withColumn(out, percent(completed, F.col(completed) + F.col(failed)))


# --------------------------------------------------------------------------
# task executions
# --------------------------------------------------------------------------

def newest_sample(df: DataFrame, order: str, limit: int | None = None) -> DataFrame:
    """All rows, or only the ``limit`` newest when the caller asks for a sample."""
    return df if limit is None else df.orderBy(F.desc(order)).limit(int(limit))


def runs_in_scope(runs: DataFrame, scope: DataFrame, sample_limit: int | None = None) -> DataFrame:
    """Task executions of robots in scope."""
    robots = scope.select(F.col("master_robot_id").alias("amr_id"))
    return newest_sample(lookup(runs, robots, ["amr_id"], "left_semi"), "id", sample_limit).select(*runs.columns)


def _valid() -> Column:
    return F.col("end_time") >= F.col("start_time")


def duration_limits(reference: DataFrame) -> DataFrame:
    """Newest duration limit of each job and subjob; "no subjob" is a key of its own."""
    keyed = reference.select("id", "job_id", F.coalesce("subjob_id", F.lit(-1)).alias("_subjob"), "limit")
    return latest_per_key(keyed, ["job_id", "_subjob"], ["id"], ["limit"]).withColumnRenamed("limit", "limit_ms")


def task_timing(
    runs: DataFrame, reference: DataFrame, scope: DataFrame, long_s: int = V.LONG_TASK_SECONDS,
    window_truncated: Column | None = None,
) -> DataFrame:
    """Duration and on-time statistics per robot.

    The limit is read as milliseconds.  Runs are reduced per robot id before
    the robot's name is attached.
    """
    limited = lookup(
        runs.withColumn("_subjob", F.coalesce("subjob_id", F.lit(-1))), duration_limits(reference),
        ["job_id", "_subjob"], "left",
    )
    valid = _valid()
    millis = millis_between("start_time", "end_time")
    seconds = seconds_between("start_time", "end_time")
    referenced = valid & (F.col("limit_ms") > 0)
    per_robot = limited.groupBy("amr_id").agg(
        F.count(F.lit(1)).alias("task_execution_count"),
        count_if(valid).alias("duration_complete_count"),
        count_if(referenced).alias("duration_reference_count"),
        count_if(referenced & (millis <= F.col("limit_ms"))).alias("on_time_count"),
        F.sum(F.when(valid, millis)).alias("_millis"),
        F.max(F.when(valid, seconds)).alias("max_actual_duration_seconds"),
        count_if(valid & (seconds > long_s)).alias("over_1_hour_duration_count"),
        F.min("start_time").alias("first_task_time"),
        F.max("start_time").alias("last_task_time"),
    )
    return _named(per_robot, scope).select(
        "master_robot_id", "robot_code", "robot_type", "task_execution_count", "duration_complete_count",
        "duration_reference_count", "on_time_count",
        percent("on_time_count", "duration_reference_count").alias("on_time_rate_percent"),
        ratio("_millis", F.col("duration_complete_count") * 1000, 2).alias("avg_actual_duration_seconds"),
        "max_actual_duration_seconds", "over_1_hour_duration_count", "first_task_time", "last_task_time",
        (window_truncated if window_truncated is not None else F.lit(False)).alias("window_truncated"),
    ).orderBy("robot_code")


def _named(per_robot: DataFrame, scope: DataFrame, how: str = "inner") -> DataFrame:
    return attach_dim(
        per_robot.withColumnRenamed("amr_id", "master_robot_id"), scope, {"master_robot_id": "master_robot_id"},
        {"robot_code": "robot_code", "robot_type": "robot_type"}, how, balanced=True,
    )


def queue_wait(
    runs: DataFrame, queue_source: DataFrame, scope: DataFrame, over_s: int = V.LONG_QUEUE_SECONDS, co_located: bool = False
) -> DataFrame:
    """Time from enqueueing to the linked execution start, per robot.

    ``co_located`` states that both facts lie in the same buckets of queue
    records: they are joined bucket by bucket, without a shuffle.
    """
    linked = lookup(
        runs.filter(F.col("queue_id").isNotNull() & F.col("start_time").isNotNull()).select(
            "amr_id", "queue_id", "start_time"
        ),
        queue_source.filter(F.col("enqueued_at").isNotNull()).select(F.col("id").alias("queue_id"), "enqueued_at"),
        ["queue_id"], "inner", balanced=co_located,
    ).filter(F.col("start_time") >= F.col("enqueued_at"))
    seconds = seconds_between("enqueued_at", "start_time")
    per_robot = linked.groupBy("amr_id").agg(
        F.count(F.lit(1)).alias("linked_queue_count"),
        F.sum(millis_between("enqueued_at", "start_time")).alias("_millis"),
        F.max(seconds).alias("max_queue_wait_seconds"),
        count_if(seconds > over_s).alias("over_5_minute_queue_count"),
    )
    return _named(per_robot, scope).select(
        "master_robot_id", "robot_code", "robot_type", "linked_queue_count",
        ratio("_millis", F.col("linked_queue_count") * 1000, 2).alias("avg_queue_wait_seconds"),
        "max_queue_wait_seconds", "over_5_minute_queue_count",
    ).orderBy("robot_code")


def segment_durations(runs: DataFrame, subjob: DataFrame, subjob_type: DataFrame, scope: DataFrame) -> DataFrame:
    """Closed executions by robot and named subjob, reduced before names are attached."""
    per_subjob = runs.filter(_valid()).groupBy("amr_id", "subjob_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(millis_between("start_time", "end_time")).alias("_millis"),
        F.max(seconds_between("start_time", "end_time")).alias("_max"),
    )
    named = attach_dim(
        per_subjob, subjob, {"subjob_id": "id"}, {"name": "subjob_name", "type_id": "type_id"}, "inner"
    )
    typed = attach_dim(named, subjob_type, {"type_id": "id"}, {"name": "subjob_type_name"})
    merged = typed.groupBy("amr_id", "subjob_type_name", "subjob_name").agg(
        F.sum("_n").alias("completed_segment_count"), F.sum("_millis").alias("_millis"),
        F.max("_max").alias("max_segment_duration_seconds"),
    )
    return _named(merged, scope).select(
        "master_robot_id", "robot_code", "robot_type", "subjob_type_name", "subjob_name", "completed_segment_count",
        ratio("_millis", F.col("completed_segment_count") * 1000, 2).alias("avg_segment_duration_seconds"),
        "max_segment_duration_seconds",
    ).orderBy("robot_code", F.desc("completed_segment_count"), "subjob_name")


# --------------------------------------------------------------------------
# projects
# --------------------------------------------------------------------------

def execution_per_queue(runs: DataFrame, window: WindowSpec) -> DataFrame:
    """Closed execution seconds and run counts of each queue record in the window."""
    closed = F.when(F.col("end_time").isNotNull(), seconds_between("start_time", "end_time")).otherwise(_zero())
    return (
        in_window(runs, "start_time", window)
        .filter(F.col("queue_id").isNotNull())
        .groupBy("queue_id")
        .agg(
            F.sum(closed).alias("execution_seconds"),
            F.count(F.lit(1)).alias("subjob_run_count"),
            count_if(F.col("status") == V.SUBJOB_SUCCESS).alias("subjob_success_count"),
            F.max("start_time").alias("last_execution_time"),
        )
    )


def scoped_queue(
    queue: DataFrame, runs: DataFrame, project: DataFrame, task_dim: DataFrame, master: DataFrame, window: WindowSpec,
    minutes: int | None = None, case_insensitive: bool = False,
) -> DataFrame:
    """Queue records of the window with project, task, robot and execution time.

    Every project result reads this one relation.  The robot resolves through
    its id only, never through the name stored with the record.
    """
    grain = minutes or window.grain
    status = F.lower("queue_status") if case_insensitive else F.col("queue_status")
    base = in_window(queue, "event_time", window).select(
        "queue_fact_id", "queue_id", "event_time", bucket_start("event_time", grain).alias("bucket_start"),
        S.try_int("project_id").alias("project_id"), S.try_int("job_id").alias("job_id"),
        S.try_int("robot_id").alias("_robot"), status.alias("queue_status"), "calling_box_name",
        S.try_long("queue_id").alias("_queue"),
    )
    with_runs = lookup(
        base, execution_per_queue(runs, window).withColumnRenamed("queue_id", "_queue"), ["_queue"], "left"
    ).drop("_queue", "last_execution_time")
    named = attach_dim(with_runs, project, {"project_id": "id"}, {"name": "project_name"})
    named = attach_dim(named, task_dim, {"job_id": "job_id"}, {"task_name": "task_name"})
    named = attach_dim(named, master, {"_robot": "id"}, {"id": "robot_master_id", "name": "robot_name"})
    return named.select(
        "queue_fact_id", "queue_id", "event_time", "bucket_start", "project_id", "project_name", "job_id", "task_name",
        "robot_master_id", "robot_name", "queue_status", "calling_box_name",
        *[F.coalesce(name, _zero()).alias(name) for name in
          ("execution_seconds", "subjob_run_count", "subjob_success_count")],
    )


CELL_KEYS = (
    "bucket_start", "project_id", "project_name", "job_id", "task_name", "robot_master_id", "robot_name",
    "queue_status",
)


def queue_cells(scoped: DataFrame) -> DataFrame:
    """Scoped records reduced to one row per combination of all breakdown columns.

    Summaries and distinct counts of the project views need nothing finer, so
    they read this instead of the records.
    """
    return scoped.groupBy(*CELL_KEYS).agg(
        F.count(F.lit(1)).alias("queue_count"),
        F.sum("execution_seconds").alias("execution_seconds"),
        count_if(F.col("execution_seconds") > 0).alias("_timed"),
        F.sum("subjob_run_count").alias("subjob_run_count"),
        F.max("event_time").alias("latest_event_time"),
    )


def queue_stats(cells: DataFrame, keys: Sequence[str | Column], distinct: Mapping[str, str] | None = None) -> DataFrame:
    """Counts, outcomes, execution time and distinct members of any grouping of the cells."""
    status = F.col("queue_status")

    def records(words: Sequence[str]) -> Column:
        return F.coalesce(F.sum(F.when(status.isin(*words), F.col("queue_count"))), _zero())

    return cells.groupBy(*keys).agg(
        F.coalesce(F.sum("queue_count"), _zero()).alias("queue_count"),
        *[F.count_distinct(column).alias(name) for name, column in (distinct or {}).items()],
        records(V.PROJECT_COMPLETED).alias("completed_count"),
        records(V.PROJECT_UNSUCCESSFUL).alias("unsuccessful_count"),
        records(V.PROJECT_OPEN).alias("open_count"),
        F.sum("execution_seconds").alias("execution_seconds"),
        F.sum("subjob_run_count").alias("subjob_run_count"),
        F.sum("_timed").alias("_timed"),
        F.max("latest_event_time").alias("latest_event_time"),
    ).withColumn("average_execution_seconds", ratio("execution_seconds", "_timed", 6)).drop("_timed")


def _job_name() -> Column:
    return F.coalesce(
        F.col("task_name"), F.concat(F.lit(V.JOB_LABEL_PREFIX), F.coalesce(F.col("job_id").cast("string"), F.lit("")))
    )


def select_work(rows: DataFrame, projects: Sequence[int] = (), jobs: Sequence[int] = ()) -> DataFrame:
    if projects:
        rows = rows.filter(F.col("project_id").isin(*projects))
    if jobs:
        rows = rows.filter(F.col("job_id").isin(*jobs))
    return rows


def project_summary(cells: DataFrame) -> DataFrame:
    return queue_stats(
        cells, [], {"project_count": "project_id", "task_count": "job_id", "robot_count": "robot_master_id"}
    ).drop("subjob_run_count", "average_execution_seconds")


def project_list(cells: DataFrame) -> DataFrame:
    stats = queue_stats(
        cells, ["project_id", "project_name"], {"task_count": "job_id", "robot_count": "robot_master_id"}
    )
    return stats.withColumn("project_name", S.fallback("project_name", V.UNMAPPED_PROJECT)).drop(
        "subjob_run_count", "average_execution_seconds"
    ).orderBy(F.desc("queue_count"), "project_name")


def task_list(cells: DataFrame) -> DataFrame:
    stats = queue_stats(
        cells, ["project_id", "project_name", "job_id", "task_name"], {"robot_count": "robot_master_id"}
    )
    return stats.withColumns(
        {"project_name": S.fallback("project_name", V.UNMAPPED_PROJECT), "task_name": _job_name()}
    ).orderBy(F.desc("queue_count"), "task_name")


def robot_breakdown(cells: DataFrame) -> DataFrame:
    stats = queue_stats(cells, ["robot_master_id", "robot_name"], {"task_count": "job_id"})
    return stats.withColumn("robot_name", S.fallback("robot_name", V.UNMAPPED_ROBOT)).drop(
        "subjob_run_count"
    ).orderBy(F.desc("queue_count"), "robot_name")


def project_trend(cells: DataFrame) -> DataFrame:
    stats = queue_stats(cells, ["bucket_start", "robot_name"])
    return stats.select(
        F.col("bucket_start").alias("stat_hour"), S.fallback("robot_name", V.UNMAPPED_ROBOT).alias("robot_name"),
        "queue_count", "completed_count", "unsuccessful_count", "execution_seconds",
    ).orderBy("stat_hour", "robot_name")


def outcome_breakdown(cells: DataFrame) -> DataFrame:
    return (
        cells.groupBy("queue_status")
        .agg(
            F.sum("queue_count").alias("queue_count"),
            F.count_distinct("robot_master_id").alias("robot_count"),
            F.count_distinct("job_id").alias("task_count"),
            F.max("latest_event_time").alias("latest_event_time"),
        )
        .withColumn("queue_status", S.fallback("queue_status", V.UNKNOWN_STATUS))
        .orderBy(F.desc("queue_count"), "queue_status")
    )


def recent_evidence(scoped: DataFrame, n: int | None = None) -> DataFrame:
    """Queue records from the newest on, all or the first ``n``; the record id settles equal times."""
    newest = scoped.orderBy(F.desc("event_time"), F.desc("queue_fact_id"))
    if n is not None:
        newest = newest.limit(n)
    return newest.select(
        "queue_id", "event_time", S.fallback("project_name", V.UNMAPPED_PROJECT).alias("project_name"),
        _job_name().alias("task_name"), S.fallback("robot_name", V.UNMAPPED_ROBOT).alias("robot_name"),
        "queue_status", "calling_box_name", "execution_seconds", "subjob_run_count", "subjob_success_count",
    )


def idle_causes(task_hourly_in_window: DataFrame, robots: DataFrame, name_col: str = "robot_name") -> DataFrame:
    """State seconds of the robots that carried the selected work."""
    per_robot = task_hourly_in_window.groupBy(F.col("robot_code").alias(name_col)).agg(
        *[F.sum(name).alias(name) for name in
          ("no_task_seconds", "waiting_seconds", "charging_seconds", "executing_seconds")]
    )
    wanted = robots.select(name_col).filter(F.col(name_col).isNotNull()).distinct()
    return lookup(per_robot, wanted, [name_col], "left_semi").orderBy(name_col)
