"""Interval algebra: merging, state islands, exact state timelines."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.scalar import count_if, lower_trim, percent, upper_trim
from ..functions.time import WindowSpec, bucket_start, in_window, lit_ts, seconds_between
from . import timeline
from .joins import clip, pair_events
from .scan import DEFAULT_CHUNK_SECONDS, asof_after, with_neighbours, with_running_max

STATES = ("executing", "charging", "waiting", "no_task", "data_unavailable")
STATE_COLUMNS = tuple(f"{state}_seconds" for state in STATES)


def merge_intervals(
    df: DataFrame,
    keys: Sequence[str],
    start: str = "start_time",
    end: str = "end_time",
    chunk_seconds: int = DEFAULT_CHUNK_SECONDS,
) -> DataFrame:
    """Union of intervals that overlap or touch, per key.

    A row opens a new interval when every earlier row of its key ends before
    it starts.  The merged end is the largest end seen before the next opening.
    """
    keys = list(keys)
    longest = (
        df.filter(F.col(end) >= F.col(start)).groupBy(*keys, F.col(start)).agg(F.max(end).alias(end))
    )
    seen = with_running_max(longest, keys, start, end, "_prior", "_overall", chunk_seconds, keep_chunk=True)
    openings = seen.filter(F.col("_prior").isNull() | (F.col("_prior") < F.col(start)))
    closed = with_neighbours(
        openings, keys, start, following={"_closing": "_prior"}, chunk_seconds=chunk_seconds
    )
    return closed.select(*keys, start, F.coalesce("_closing", "_overall").alias(end))


def state_islands(
    samples: DataFrame,
    keys: Sequence[str],
    time: str,
    state: str,
    gap_seconds: int = V.BATTERY_MAX_GAP_SECONDS,
    chunk_seconds: int = DEFAULT_CHUNK_SECONDS,
) -> DataFrame:
    """Runs of samples in one state without a gap longer than ``gap_seconds``.

    A run ends at the next run's start when that follows its last sample
    within the gap, else at its last sample.  Of several samples at one
    instant the largest state counts.
    """
    keys = list(keys)
    single = df_one_per_instant(samples, keys, time, state)
    seen = with_neighbours(
        single, keys, time,
        preceding={"_prior_time": time, "_prior_state": state}, key_max={"_final": time}, chunk_seconds=chunk_seconds,
        keep_chunk=True,
    )
    openings = seen.filter(
        F.col("_prior_time").isNull()
        | (seconds_between("_prior_time", time) > gap_seconds)
        | (F.col("_prior_state") != F.col(state))
    )
    runs = with_neighbours(
        openings, keys, time, following={"_next_start": time, "_last": "_prior_time"}, chunk_seconds=chunk_seconds
    )
    last = F.coalesce("_last", "_final")
    reaches = F.col("_next_start") <= last + F.expr(f"INTERVAL {int(gap_seconds)} SECONDS")
    return runs.select(
        *keys, F.col(time).alias("start_time"), F.when(reaches, F.col("_next_start")).otherwise(last).alias("end_time"),
        last.alias("last_sample_time"), state,
    )


def df_one_per_instant(samples: DataFrame, keys: Sequence[str], time: str, state: str) -> DataFrame:
    return samples.groupBy(*keys, F.col(time)).agg(F.max(state).alias(state))


def sample_spans(
    samples: DataFrame,
    keys: Sequence[str],
    time: str,
    state: str,
    gap_seconds: int = V.BATTERY_MAX_GAP_SECONDS,
    chunk_seconds: int = DEFAULT_CHUNK_SECONDS,
) -> DataFrame:
    """Sample to next sample where the gap allows it; together they cover the state islands."""
    keys = list(keys)
    seen = with_neighbours(
        df_one_per_instant(samples, keys, time, state), keys, time, following={"end_time": time},
        chunk_seconds=chunk_seconds,
    )
    return seen.filter(seconds_between(time, "end_time") <= gap_seconds).select(
        *keys, F.col(time).alias("start_time"), "end_time", state
    )


def time_weighted_share(
    samples: DataFrame,
    keys: Sequence[str],
    time: str,
    level: str,
    above: int = V.BATTERY_SHARE_LEVEL,
    max_gap_s: int = V.BATTERY_MAX_GAP_SECONDS,
    window_s: int = 24 * 3600,
    tiebreak: str | None = None,
    chunk_seconds: int = DEFAULT_CHUNK_SECONDS,
) -> DataFrame:
    """Share of observed time with ``level`` over ``above``.

    A sample stands for the time to the next one; longer gaps count as not
    observed.  Of several samples at one instant the last one (largest
    ``tiebreak``) holds until the next instant.
    """
    keys = list(keys)
    held = F.max_by(level, tiebreak) if tiebreak else F.max(level)
    instants = samples.groupBy(*keys, F.col(time)).agg(F.count(F.lit(1)).alias("_n"), held.alias("_level"))
    timed = with_neighbours(instants, keys, time, following={"_next": time}, chunk_seconds=chunk_seconds)
    gap = seconds_between(time, "_next")
    observed = F.when(gap <= max_gap_s, gap).otherwise(F.lit(0))
    high = F.when(F.col("_level") > above, F.col("_observed")).otherwise(F.lit(0))
    return (
        timed.withColumn("_observed", F.coalesce(observed, F.lit(0)))
        .groupBy(*keys)
        .agg(
            F.sum("_n").alias("sample_count"),
            F.sum("_observed").alias("observed_seconds"),
            F.sum(high).alias(f"above_{above}_seconds"),
            F.min(time).alias("first_sample_time"),
            F.max(time).alias("last_sample_time"),
        )
        .filter(F.col("observed_seconds") > 0)
        .withColumn(f"above_{above}_time_share_percent", percent(f"above_{above}_seconds", "observed_seconds"))
        .withColumn("window_coverage_percent", percent("observed_seconds", F.lit(int(window_s))))
    )


def queue_to_first_start(
    queue: DataFrame, starts: DataFrame, window: WindowSpec | None = None, robot_col: str = "robot_code"
) -> DataFrame:
    """Waiting interval of a queue record and robot: enqueue to the first start at or after it.

    ``queue`` has ``queue_id, queue_start_time``; ``starts`` has ``queue_id,
    event_time`` and the robot.  Starts are found by an ordered scan, so a
    queue with many records and many starts does not pair them all.
    """
    waiting = queue.filter(F.col("queue_id").isNotNull() & F.col("queue_start_time").isNotNull())
    begun = starts.filter(F.col("queue_id").isNotNull())
    if window is not None:
        waiting = waiting.filter(F.col("queue_start_time") < lit_ts(window.end))
        begun = begun.filter(F.col("event_time") > lit_ts(window.start))
    begun = begun.select("queue_id", robot_col, "event_time")
    asked = waiting.select("queue_id", "queue_start_time").distinct().join(
        begun.select("queue_id", robot_col).distinct(), ["queue_id"], "inner"
    )
    pairs = (
        asof_after(asked, begun, ["queue_id", robot_col], "queue_start_time", "event_time", "event_time", "end_time")
        .filter(F.col("end_time").isNotNull())
        .select(robot_col, "queue_id", F.col("queue_start_time").alias("start_time"), "end_time")
    )
    return clip(pairs, window) if window is not None else pairs


# --------------------------------------------------------------------------
# state timeline
# --------------------------------------------------------------------------

# Interval kinds in order of precedence; "observed" marks battery telemetry.
KINDS = ("executing", "charging", "waiting", "observed")


def _boundary_steps(intervals: DataFrame, key: str, kinds: dict[str, Column], window: WindowSpec) -> DataFrame:
    """+1 at the start and -1 at the end of each clipped interval, for every kind whose condition holds.

    An empty interval only leaves a cut point.
    """
    clipped = clip(intervals, window).filter(F.col("start_time") <= F.col("end_time"))
    zero = F.lit(0).cast("long")
    weights = [F.when(kinds[kind], F.lit(1).cast("long")).otherwise(zero) if kind in kinds else zero for kind in KINDS]

    def step(time: str, sign: int) -> Column:
        return F.struct(F.col(time).alias("at"), *[(w * sign).alias(kind) for kind, w in zip(KINDS, weights)])

    steps = F.explode(F.array(step("start_time", 1), step("end_time", -1)))
    return clipped.select(key, steps.alias("_s")).select(key, "_s.*").filter(F.col("at") < lit_ts(window.end))


def sweep(
    robots: DataFrame, window: WindowSpec, minutes: int, intervals: dict[str, DataFrame], key: str = "robot_code",
    busy_buckets: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Pieces between consecutive cut points, with the number of active intervals of each kind.

    Returns the pieces of busy buckets, those with an interval bound or listed
    in ``busy_buckets``, and the silent buckets, which are one piece each.

    Every bucket border is a cut point, so a piece never leaves its bucket and
    busy buckets are swept per (robot, bucket).  What is active when one opens
    is the sum of all earlier steps, carried over busy buckets only; a silent
    bucket repeats the state the busy bucket before it ended in, so it needs
    neither sorting nor a shuffle.  Robots without any interval are silent
    throughout.  Without charging intervals, ``observed`` must tell by
    ``is_charging`` which of its intervals are charging.
    """
    kinds = list(KINDS)
    steps = None
    for kind, frame in intervals.items():
        held = {kind: F.lit(True)}
        if kind == "observed" and "charging" not in intervals:
            held["charging"] = F.col("is_charging")
        part = _boundary_steps(frame, key, held, window)
        steps = part if steps is None else steps.unionByName(part)
    width = F.expr(f"INTERVAL {int(minutes)} MINUTES")
    first_bucket, after_last = bucket_start(lit_ts(window.start), minutes), lit_ts(window.end)
    steps = steps.groupBy(key, bucket_start("at", minutes).alias("bucket_start"), "at").agg(
        *[F.sum(kind).alias(kind) for kind in kinds]
    )

    zeros = [F.lit(0).cast("long").alias(kind) for kind in kinds]
    known = robots.select(key).distinct().select(
        key, first_bucket.alias("bucket_start"), *zeros, F.lit(True).alias("_known")
    )
    totals = steps.select(key, "bucket_start", *kinds, F.lit(False).alias("_known")).unionByName(known)
    if busy_buckets is not None:
        totals = totals.unionByName(busy_buckets.select(key, "bucket_start", *zeros, F.lit(False).alias("_known")))
    by_bucket = Window.partitionBy(key).orderBy("bucket_start")
    before = by_bucket.rowsBetween(Window.unboundedPreceding, -1)
    busy = (
        totals.groupBy(key, "bucket_start")
        .agg(*[F.sum(kind).alias(kind) for kind in kinds], F.max("_known").alias("_known"))
        .select(
            key, "bucket_start", *kinds,
            *[F.coalesce(F.sum(kind).over(before), F.lit(0).cast("long")).alias(f"{kind}_in") for kind in kinds],
            F.lead("bucket_start").over(by_bucket).alias("_next"),
            F.max("_known").over(Window.partitionBy(key)).alias("_known"),
        )
        .filter("_known")
    )

    openings = busy.select(
        key, "bucket_start", F.greatest(F.col("bucket_start"), lit_ts(window.start)).alias("at"),
        *[F.col(f"{kind}_in").alias(kind) for kind in kinds], F.lit(0).alias("_side"),
    )
    points = openings.unionByName(steps.withColumn("_side", F.lit(1)))
    ordered = Window.partitionBy(key, "bucket_start").orderBy("at", "_side")
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bucket_end = F.least(F.col("bucket_start") + width, after_last)
    in_scope = F.min("_side").over(Window.partitionBy(key, "bucket_start")) == 0
    pieces = (
        points.select(
            key, "bucket_start", F.col("at").alias("start_time"),
            F.coalesce(F.lead("at").over(ordered), bucket_end).alias("end_time"),
            *[F.sum(kind).over(running).alias(kind) for kind in kinds],
            in_scope.alias("_in_scope"),
        )
        .filter(F.col("_in_scope") & (F.col("end_time") > F.col("start_time")))
        .drop("_in_scope")
    )

    first_silent = F.col("bucket_start") + width
    last_silent = F.coalesce(F.col("_next"), bucket_start(after_last - F.expr("INTERVAL 1 MICROSECOND"), minutes) + width) - width
    silent = (
        busy.filter(first_silent <= last_silent)
        .select(
            key, F.explode(F.sequence(first_silent, last_silent, width)).alias("bucket_start"),
            *[(F.col(f"{kind}_in") + F.col(kind)).alias(kind) for kind in kinds],
        )
        .select(key, "bucket_start", F.col("bucket_start").alias("start_time"), bucket_end.alias("end_time"), *kinds)
    )
    return pieces, silent


def atomic_segments(
    robots: DataFrame, window: WindowSpec, minutes: int, intervals: dict[str, DataFrame], key: str = "robot_code"
) -> DataFrame:
    """All pieces of the window, see ``sweep``."""
    pieces, silent = sweep(robots, window, minutes, intervals, key)
    return pieces.unionByName(silent)


def _state() -> Column:
    """Executing before charging before waiting before idle; unobserved otherwise."""
    return (
        F.when(F.col("executing") > 0, F.lit("executing"))
        .when(F.col("charging") > 0, F.lit("charging"))
        .when(F.col("waiting") > 0, F.lit("waiting"))
        .when(F.col("observed") > 0, F.lit("no_task"))
        .otherwise(F.lit("data_unavailable"))
    )


def _seconds_in(name: str) -> Column:
    return F.when(F.col("_state") == name, F.col("_s")).otherwise(F.lit(0).cast("long"))


def _timed(segments: DataFrame, key: str) -> DataFrame:
    return segments.select(
        key, "bucket_start", _state().alias("_state"), seconds_between("start_time", "end_time").alias("_s")
    )


def attribute_states(segments: DataFrame, key: str = "robot_code") -> DataFrame:
    """Seconds of each state per robot and bucket."""
    return _timed(segments, key).groupBy(key, "bucket_start").agg(
        *[F.sum(_seconds_in(name)).alias(f"{name}_seconds") for name in STATES]
    )


def _event_counts() -> list[Column]:
    succeeded = lower_trim("event_status") == V.JOB_END_SUCCESS
    counts = []
    for name, event_type in V.EVENT_TYPE_COUNTS.items():
        matches = F.col("event_type") == event_type
        counts.append(count_if(matches & succeeded if name == "task_completed_count" else matches).alias(name))
    return counts


def _counted_events(events: DataFrame, window: WindowSpec) -> DataFrame:
    return in_window(events, "event_time", window).filter(F.col("event_type").isin(*V.EVENT_TYPE_COUNTS.values()))


def bucket_event_counts(events: DataFrame, minutes: int, window: WindowSpec, key: str = "robot_code") -> DataFrame:
    """Task events per robot and bucket inside the window."""
    return _counted_events(events, window).groupBy(key, bucket_start("event_time", minutes).alias("bucket_start")).agg(*_event_counts())


def event_points(events: DataFrame, window: WindowSpec, key: str = "robot_code") -> DataFrame:
    """Task events per robot and instant inside the window."""
    kept = _counted_events(events, window).filter(F.col(key).isNotNull())
    return kept.groupBy(key, F.col("event_time").alias("at")).agg(*_event_counts())


def charging_samples(battery: DataFrame) -> DataFrame:
    """Battery samples that report a charging status, as a flag."""
    return battery.filter(F.trim(F.col("charging_status")) != "").select(
        "robot_code", "sample_time", (upper_trim("charging_status") == V.CHARGING_WORD).alias("is_charging")
    )


def execution_events(events: DataFrame) -> DataFrame:
    """Events that stem from task executions."""
    return events.filter(
        (F.col("source_schema") == V.EVENT_SOURCE_SCHEMA) & (F.col("source_table") == V.EXECUTION_SOURCE_TABLE)
    )


def active_robots(robot_dim: DataFrame, robots: Sequence[str] | None = None) -> DataFrame:
    kept = robot_dim.filter(F.col("is_enabled") & (F.trim(F.col("robot_code")) != ""))
    if robots:
        kept = kept.filter(F.col("robot_code").isin(*robots))
    return kept.select("robot_code", "robot_id")


def chosen(df: DataFrame, robots: Sequence[str] | None) -> DataFrame:
    """Rows of the chosen robots; of all if none are."""
    return df.filter(F.col("robot_code").isin(*robots)) if robots else df


def state_intervals(
    events: DataFrame, battery: DataFrame, queue: DataFrame, window: WindowSpec,
    gap_seconds: int = V.BATTERY_MAX_GAP_SECONDS, merged: bool = True, robots: Sequence[str] | None = None, store=None,
) -> dict[str, DataFrame]:
    """The interval sets of a window, read from the event, battery and queue facts.

    Without a ``store`` (an ``IntervalStore``) events and queue records of all
    time before the window's end must be read, as an interval may have begun
    whenever; with one, only the days of the window are.

    ``merged`` gives the fewest, longest intervals.  State seconds do not need
    that: the sweep counts how many intervals are active, so overlapping ones
    and sample-to-sample spans give the same states.
    """
    if store is not None:
        executing, waiting = store.executing(window, robots), store.waiting(window, robots)
    else:
        executions = execution_events(events)
        executing = chosen(pair_events(executions, window=window), robots)
        starts = chosen(executions.filter(F.col("source_event_part") == V.EVENT_START), robots)
        waiting = queue_to_first_start(queue, starts, window)
    lookback = WindowSpec(window.start - timedelta(seconds=gap_seconds), window.end)
    samples = charging_samples(in_window(chosen(battery, robots), "sample_time", lookback))
    if merged:
        executing, waiting = (merge_intervals(rows, ["robot_code"]) for rows in (executing, waiting))
        observed = state_islands(samples, ["robot_code"], "sample_time", "is_charging", gap_seconds)
    else:
        observed = timeline.near_spans(samples, "robot_code", "sample_time", "is_charging", gap_seconds)
    return {"executing": executing, "waiting": waiting, "observed": observed}


def state_trend_from_events(
    robot_dim: DataFrame,
    events: DataFrame,
    battery: DataFrame,
    queue: DataFrame,
    window: WindowSpec,
    minutes: int | None = None,
    robots: Sequence[str] | None = None,
    gap_seconds: int = V.BATTERY_MAX_GAP_SECONDS,
    store=None,
) -> DataFrame:
    """Exact state seconds and task events per active robot and bucket."""
    grain = minutes or window.grain
    sets = state_intervals(events, battery, queue, window, gap_seconds, merged=False, robots=robots, store=store)
    return state_trend(active_robots(robot_dim, robots), chosen(events, robots), window, grain, sets)


def state_trend(
    scope: DataFrame, events: DataFrame, window: WindowSpec, minutes: int, sets: dict[str, DataFrame]
) -> DataFrame:
    """State seconds and task events per robot and bucket, from the interval sets of the window.

    Events are cut points too, so one sweep gives both; chunks are whole buckets.
    """
    bucket_seconds = int(minutes) * 60
    chunk_seconds = -(-DEFAULT_CHUNK_SECONDS // bucket_seconds) * bucket_seconds
    counted = event_points(events, window)
    pieces = timeline.state_pieces(scope, window, sets, chunk_seconds=chunk_seconds, counted=counted)
    return timeline.fill_buckets(pieces, minutes, counts=list(V.EVENT_TYPE_COUNTS)).withColumnRenamed("bucket_start", "stat_hour")
