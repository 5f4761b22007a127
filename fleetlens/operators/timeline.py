"""State timelines as runs: who was in which state from when to when.

Intervals are cut at chunk borders, so the states of a (robot, chunk) follow
from that chunk's own parts: no earlier step has to be carried in, and one
shuffle by (robot, chunk) serves the whole sweep.  A chunk holds some hours of
one robot, so a robot-day is several tasks and no robot is one.

The result is sparse: consecutive pieces in one state are one run, also across
chunks; a robot without any interval has a single run.  Buckets are filled from
the pieces only where a trend asks for them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import WindowSpec, lit_ts, seconds_between
from .joins import clip
from .scan import CHUNK, DEFAULT_CHUNK_SECONDS, chunk_of

# States in order of precedence; "observed" is telemetry without any of the others.
KINDS = ("executing", "charging", "waiting", "observed")
STATES = ("executing", "charging", "waiting", "no_task", "data_unavailable")
MICROSECOND = "INTERVAL 1 MICROSECOND"


def chunk_start(chunk: Column, chunk_seconds: int) -> Column:
    return F.timestamp_seconds(chunk * int(chunk_seconds))


def _chunks(first: Column, last: Column, chunk_seconds: int) -> Column:
    """Chunks from the one of ``first`` to the one of ``last``, as rows."""
    return F.explode(F.sequence(chunk_of(first, chunk_seconds), chunk_of(last, chunk_seconds))).alias(CHUNK)


def near_spans(
    samples: DataFrame, key: str, time: str, state: str, gap_seconds: int, chunk_seconds: int = DEFAULT_CHUNK_SECONDS
) -> DataFrame:
    """Sample to next sample of the key where the next one follows within the gap.

    A sample also goes to the chunks before it that lie within the gap, so each
    chunk sees every successor it may need.  Of several samples at one instant
    the largest state counts.
    """
    width = max(int(chunk_seconds), int(gap_seconds))
    earliest = F.col("at") - F.expr(f"INTERVAL {int(gap_seconds)} SECONDS")
    placed = samples.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).select(key, F.col(time).alias("at"), F.col(state).alias("_held"))
    seen = (
        placed.select(key, "at", "_held", _chunks(earliest, F.col("at"), width))
        .repartition(key, CHUNK).groupBy(key, CHUNK, "at").agg(F.max("_held").alias("_held"))
    )
    following = F.lead("at").over(Window.partitionBy(key, CHUNK).orderBy("at"))
    spans = seen.select(key, CHUNK, F.col("at").alias("start_time"), following.alias("end_time"), F.col("_held").alias(state))
    own = F.col(CHUNK) == chunk_of("start_time", width)
    return spans.filter(own & (seconds_between("start_time", "end_time") <= gap_seconds)).drop(CHUNK)


def _steps(intervals: DataFrame, key: str, kinds: Mapping[str, Column], window: WindowSpec, chunk_seconds: int, counts: Sequence[str]) -> DataFrame:
    """+1 where an interval's part of a chunk starts and -1 where it ends before the chunk does."""
    cut = clip(intervals, window).filter(F.col("start_time") < F.col("end_time"))
    parts = cut.select("*", _chunks(F.col("start_time"), F.col("end_time") - F.expr(MICROSECOND), chunk_seconds))
    opens, closes = chunk_start(F.col(CHUNK), chunk_seconds), chunk_start(F.col(CHUNK) + 1, chunk_seconds)
    zero = F.lit(0).cast("long")
    weights = [F.when(kinds[kind], F.lit(1).cast("long")).otherwise(zero) if kind in kinds else zero for kind in KINDS]

    def step(at: Column, sign: int) -> Column:
        return F.struct(at.alias("at"), *[(weight * sign).alias(kind) for kind, weight in zip(KINDS, weights)])

    start = step(F.greatest("start_time", opens), 1)
    both = F.when(F.col("end_time") < closes, F.array(start, step(F.col("end_time"), -1))).otherwise(F.array(start))
    steps = parts.select(key, CHUNK, F.explode(both).alias("_s")).select(key, CHUNK, "_s.*")
    return steps.select(key, CHUNK, "at", *KINDS, *[zero.alias(name) for name in counts], F.lit(False).alias("_known"))


def state_pieces(
    robots: DataFrame, window: WindowSpec, intervals: Mapping[str, DataFrame], key: str = "robot_code",
    chunk_seconds: int = DEFAULT_CHUNK_SECONDS, counted: DataFrame | None = None,
) -> DataFrame:
    """key, chunk, start_time, end_time and state of every piece between two cut points.

    ``intervals`` has (key, start_time, end_time) by kind; without "charging",
    "observed" tells by ``is_charging`` which of its intervals are.  Several
    active intervals of a kind count as one.  ``counted`` has (key, at) and
    counts, which the piece that starts at ``at`` carries.
    """
    counts = [name for name in counted.columns if name not in (key, "at")] if counted is not None else []
    zero = F.lit(0).cast("long")
    parts = []
    for kind, frame in intervals.items():
        held = {kind: F.lit(True)}
        if kind == "observed" and "charging" not in intervals:
            held["charging"] = F.col("is_charging")
        parts.append(_steps(frame, key, held, window, chunk_seconds, counts))
    last = lit_ts(window.end - timedelta(microseconds=1))
    spine = robots.select(key).distinct().select(key, _chunks(lit_ts(window.start), last, chunk_seconds))
    opens = F.greatest(chunk_start(F.col(CHUNK), chunk_seconds), lit_ts(window.start))
    parts.append(spine.select(key, CHUNK, opens.alias("at"), *[zero.alias(name) for name in (*KINDS, *counts)], F.lit(True).alias("_known")))
    if counted is not None:
        parts.append(counted.select(
            key, chunk_of("at", chunk_seconds), "at", *[zero.alias(kind) for kind in KINDS], *[F.col(name).cast("long").alias(name) for name in counts],
            F.lit(False).alias("_known"),
        ))
    points = reduce(DataFrame.unionByName, parts).repartition(key, CHUNK).groupBy(key, CHUNK, "at").agg(
        *[F.sum(name).alias(name) for name in (*KINDS, *counts)], F.max("_known").alias("_known")
    )
    whole = Window.partitionBy(key, CHUNK)
    ordered = whole.orderBy("at")
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    closes = F.least(chunk_start(F.col(CHUNK) + 1, chunk_seconds), lit_ts(window.end))
    active = [F.sum(kind).over(running) > 0 for kind in KINDS]
    state = F.lit(len(STATES)).cast("int")
    for code, condition in reversed(list(enumerate(active, 1))):
        state = F.when(condition, F.lit(code)).otherwise(state)
    return points.select(
        key, CHUNK, F.col("at").alias("start_time"), F.coalesce(F.lead("at").over(ordered), closes).alias("end_time"),
        state.alias("state"), *counts, F.max("_known").over(whole).alias("_known"),
    ).filter("_known").drop("_known")


def state_name(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(name) for name in STATES]), code)


def state_runs(
    robots: DataFrame, window: WindowSpec, intervals: Mapping[str, DataFrame], key: str = "robot_code",
    chunk_seconds: int = DEFAULT_CHUNK_SECONDS,
) -> DataFrame:
    """key, start_time, end_time and state of the longest runs; those of a key tile the window.

    Whether a chunk's first run goes on from the chunk before, and where its
    last one ends, is told by one row per (key, chunk).
    """
    inside = Window.partitionBy(key, CHUNK).orderBy("start_time")
    pieces = state_pieces(robots, window, intervals, key, chunk_seconds)
    changed = pieces.withColumn("_before", F.lag("state").over(inside)).filter(F.col("_before").isNull() | (F.col("_before") != F.col("state")))
    by_chunk = Window.partitionBy(key).orderBy(CHUNK)
    later = by_chunk.rowsBetween(1, Window.unboundedFollowing)
    starts_within = F.min(F.when(F.col("_before").isNotNull(), F.col("start_time")))
    chunks = changed.groupBy(key, CHUNK).agg(
        F.min("start_time").alias("_opens"), F.min(F.when(F.col("_before").isNull(), F.col("state"))).alias("_first"),
        F.max_by("state", "start_time").alias("_last"), starts_within.alias("_within"),
    )
    goes_on = F.coalesce(F.lag("_last").over(by_chunk) == F.col("_first"), F.lit(False))
    told = chunks.withColumn("_goes_on", goes_on).withColumn(
        "_opening", F.when(F.col("_goes_on"), F.col("_within")).otherwise(F.col("_opens"))
    )
    told = told.select(key, CHUNK, "_goes_on", F.first("_opening", ignorenulls=True).over(later).alias("_next"))
    runs = changed.join(told, [key, CHUNK]).filter(F.col("_before").isNotNull() | ~F.col("_goes_on"))
    end = F.coalesce(F.lead("start_time").over(inside), F.col("_next"), lit_ts(window.end))
    return runs.select(key, "start_time", end.alias("end_time"), state_name(F.col("state")).alias("state"))


def fill_buckets(pieces: DataFrame, minutes: int, key: str = "robot_code", counts: Sequence[str] = ()) -> DataFrame:
    """Seconds of each state per key and bucket, and the counts of the pieces that start in it.

    Chunks are whole buckets, so the sums need no further shuffle.
    """
    width = int(minutes) * 60
    bucket = lambda at: at - F.pmod(at, F.lit(width).cast("long"))
    opens, closes = F.unix_seconds("start_time"), F.unix_seconds("end_time")
    # A piece that ends on a bucket's border, to the microsecond, does not reach into it.
    reaches = F.unix_seconds(F.col("end_time") - F.expr(MICROSECOND))
    placed = pieces.select(key, CHUNK, "state", *counts, opens.alias("_opens"), closes.alias("_closes"), F.explode(F.sequence(bucket(opens), bucket(reaches), F.lit(width).cast("long"))).alias("_bucket"))
    seconds = F.least(F.col("_closes"), F.col("_bucket") + width) - F.greatest("_opens", "_bucket")
    parts = placed.select(key, CHUNK, "_bucket", "state", seconds.alias("_s"), *[F.when(F.col("_opens") >= F.col("_bucket"), F.col(name)).alias(name) for name in counts])
    zero = F.lit(0).cast("long")
    return parts.groupBy(key, CHUNK, "_bucket").agg(
        *[F.sum(F.when(F.col("state") == code, F.col("_s")).otherwise(zero)).alias(f"{name}_seconds") for code, name in enumerate(STATES, 1)],
        *[F.coalesce(F.sum(name), zero).alias(name) for name in counts],
    ).select(key, F.timestamp_seconds("_bucket").alias("bucket_start"), *[f"{name}_seconds" for name in STATES], *counts)
