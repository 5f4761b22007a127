"""Signal strength while tasks run: one histogram, every statistic from it.

RSSI levels are a few dozen whole numbers, so samples reduce to counts per
(robot, target, bucket, level) in one pass.  All statistics, witnesses and
timelines are exact functions of that histogram.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import vocab as V
from ..functions.scalar import percent, ratio
from ..functions.time import bucket_start, hour_start, prune_days
from .joins import attach_dim, lookup, strict_time_join


def running_samples(
    job_history: DataFrame, wifi_history: DataFrame, scope: DataFrame, start: Column, end: Column
) -> DataFrame:
    """Signal samples taken at exactly the time of a running-task row of the same robot.

    The newest row per robot and time decides on both sides; a blank target is
    dropped only after that choice.  ``[start, end)`` bounds both sources.
    """
    inside = (F.col("pc_timestamp") >= start) & (F.col("pc_timestamp") < end)
    job_history, wifi_history = (prune_days(df, start, end) for df in (job_history, wifi_history))
    robots = scope.select(F.col("master_robot_id").alias("amr_id"))
    jobs = lookup(
        job_history.filter((F.col("job_status") == V.RUNNING_JOB_STATUS) & inside).select(
            "amr_id", "pc_timestamp", "ods_row_id", "poi_target"
        ),
        robots, ["amr_id"], "left_semi",
    )
    levels = wifi_history.filter(inside).select("amr_id", "pc_timestamp", "ods_row_id", "wifi_signal_level")
    return (
        strict_time_join(
            jobs, levels, ["amr_id", "pc_timestamp"], "ods_row_id", ["poi_target"], ["wifi_signal_level"]
        )
        .withColumn("poi_target", S.blank_to_null("poi_target"))
        .filter(F.col("poi_target").isNotNull())
    )


def rssi_histogram(samples: DataFrame, scope: DataFrame, minutes: int) -> DataFrame:
    """Sample counts per robot, target, bucket and level; names come after the reduction."""
    counted = samples.groupBy(
        "amr_id", "poi_target", bucket_start("pc_timestamp", minutes).alias("bucket_start"), "wifi_signal_level"
    ).agg(
        F.count(F.lit(1)).alias("n"), F.min("pc_timestamp").alias("first_time"), F.max("pc_timestamp").alias("last_time")
    )
    return attach_dim(counted, scope, {"amr_id": "master_robot_id"}, {"robot_code": "robot_code"}, "inner")


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def _samples(condition: Column | None = None) -> Column:
    counted = F.col("n") if condition is None else F.when(condition, F.col("n"))
    return F.coalesce(F.sum(counted), _zero())


def rssi_stats(
    histogram: DataFrame,
    keys: Sequence[str],
    weak: int = V.WEAK_RSSI,
    distinct: Mapping[str, str] | None = None,
    weak_distinct: Mapping[str, str] | None = None,
    zero_rate: bool = False,
) -> DataFrame:
    """Counts, rates, mean and extremes of valid levels for any grouping."""
    level = F.col("wifi_signal_level")
    valid, zero, is_weak = S.is_valid_rssi(level), S.is_zero_rssi(level), S.is_weak_rssi(level, weak)
    stats = histogram.groupBy(*keys).agg(
        _samples().alias("sample_count"),
        *[F.count_distinct(column).alias(name) for name, column in (distinct or {}).items()],
        _samples(valid).alias("valid_signal_sample_count"),
        _samples(zero).alias("zero_signal_sample_count"),
        _samples(is_weak).alias("weak_signal_sample_count"),
        *[F.count_distinct(F.when(is_weak, F.col(column))).alias(name)
          for name, column in (weak_distinct or {}).items()],
        F.sum(F.when(valid, level * F.col("n"))).alias("_sum"),
        F.min(F.when(valid, level)).alias("minimum_valid_rssi"),
        F.max(F.when(valid, level)).alias("maximum_valid_rssi"),
        F.min("first_time").alias("first_sample_time"),
        F.max("last_time").alias("last_sample_time"),
    )
    stats = stats.withColumns({
        "weak_signal_rate": percent("weak_signal_sample_count", "valid_signal_sample_count"),
        "average_valid_rssi": ratio("_sum", "valid_signal_sample_count", 2),
    }).drop("_sum")
    return stats.withColumn("zero_signal_rate", percent("zero_signal_sample_count", "sample_count")) if zero_rate else stats


def stats_summary(histogram: DataFrame, weak: int = V.WEAK_RSSI) -> DataFrame:
    return rssi_stats(histogram, [], weak, {"robot_count": "amr_id", "target_count": "poi_target"}).withColumnRenamed(
        "sample_count", "running_matched_sample_count"
    )


def stats_trend(histogram: DataFrame, weak: int = V.WEAK_RSSI) -> DataFrame:
    keys = ["robot_code", "poi_target", "bucket_start"]
    return rssi_stats(histogram, keys, weak, {"robot_count": "amr_id"}).drop(
        "weak_signal_rate", "first_sample_time", "last_sample_time"
    ).orderBy("bucket_start", "robot_code", "poi_target")


def stats_by_target(histogram: DataFrame, weak: int = V.WEAK_RSSI) -> DataFrame:
    stats = rssi_stats(
        histogram, ["poi_target"], weak, {"robot_count": "amr_id"}, {"weak_robot_count": "amr_id"}, zero_rate=True
    )
    return stats.orderBy("average_valid_rssi", F.desc("zero_signal_rate"), F.desc("sample_count"), "poi_target")


def stats_by_robot(histogram: DataFrame, weak: int = V.WEAK_RSSI) -> DataFrame:
    stats = rssi_stats(
        histogram, ["robot_code"], weak, {"target_count": "poi_target"}, {"weak_target_count": "poi_target"}
    )
    return stats.orderBy(F.desc("sample_count"), "robot_code")


def stats_by_robot_target(histogram: DataFrame, weak: int = V.WEAK_RSSI) -> DataFrame:
    return rssi_stats(histogram, ["robot_code", "poi_target"], weak).orderBy(
        "robot_code", "average_valid_rssi", F.desc("sample_count"), "poi_target"
    )


def minimum_witness(histogram: DataFrame) -> DataFrame:
    """The sample holding the minimum for the fleet, each robot, each target and each pair.

    Newest first, then robot and target, settle equal minima.  Pairs are
    reduced first; the four scopes are then grouping sets over pairs.
    """
    candidate = F.struct(
        F.col("wifi_signal_level").alias("level"), (-F.unix_micros("last_time")).alias("recency"),
        F.col("robot_code").alias("robot"), F.col("poi_target").alias("target"),
    )
    pairs = (
        histogram.filter(S.is_valid_rssi("wifi_signal_level"))
        .groupBy("robot_code", "poi_target").agg(F.min(candidate).alias("witness"))
    )
    robot, target = F.col("robot_code"), F.col("poi_target")
    scopes = pairs.groupingSets([[], [robot], [target], [robot, target]], robot, target).agg(
        F.grouping_id(robot, target).alias("_set"), F.min("witness").alias("w")
    )
    scope_type = (
        F.when(F.col("_set") == 3, F.lit("ALL")).when(F.col("_set") == 1, F.lit("ROBOT"))
        .when(F.col("_set") == 2, F.lit("TARGET")).otherwise(F.lit("ROBOT_TARGET"))
    )
    return scopes.filter(F.col("w").isNotNull()).select(
        scope_type.alias("scope_type"), F.col("robot_code").alias("scope_robot_code"),
        F.col("poi_target").alias("scope_poi_target"), F.col("w.robot").alias("minimum_robot_code"),
        F.col("w.target").alias("minimum_poi_target"), F.timestamp_micros(-F.col("w.recency")).alias("minimum_event_time"),
        F.col("w.level").alias("minimum_rssi"),
    ).orderBy(S.rank_order("scope_type", V.WITNESS_SCOPE_RANK), "scope_robot_code", "scope_poi_target")


def weak_timeline(histogram: DataFrame, weak: int = V.WEAK_RSSI) -> DataFrame:
    """Weak samples per robot, target and bucket."""
    return (
        histogram.filter(S.is_weak_rssi("wifi_signal_level", weak))
        .groupBy("robot_code", "poi_target", "bucket_start")
        .agg(
            F.sum("n").alias("weak_signal_sample_count"),
            F.min("first_time").alias("first_weak_time"),
            F.max("last_time").alias("last_weak_time"),
            F.min("wifi_signal_level").alias("minimum_rssi"),
            F.max("wifi_signal_level").alias("maximum_rssi"),
        )
        .orderBy("bucket_start", "robot_code", "poi_target")
    )



def weak_buckets(timeline: DataFrame) -> DataFrame:
    """Weak timeline summed over robots and targets."""
    return timeline.groupBy("bucket_start").agg(
        F.sum("weak_signal_sample_count").alias("weak_signal_sample_count"),
        F.min("first_weak_time").alias("first_weak_time"), F.max("last_weak_time").alias("last_weak_time"),
        F.min("minimum_rssi").alias("minimum_rssi"), F.max("maximum_rssi").alias("maximum_rssi"),
    ).orderBy("bucket_start")


def weak_peak(timeline: DataFrame) -> DataFrame:
    """Busiest bucket, the first one on ties, and its share of all weak samples."""
    buckets = timeline.groupBy("bucket_start").agg(F.sum("weak_signal_sample_count").alias("weak_signal_sample_count"))
    total = timeline.agg(F.sum("weak_signal_sample_count")).scalar()
    return (
        buckets.orderBy(F.desc("weak_signal_sample_count"), "bucket_start").limit(1)
        .withColumn("total_weak_count", total)
        .withColumn("peak_share_percent", percent("weak_signal_sample_count", "total_weak_count"))
    )


def reaggregate_rssi(
    stats: DataFrame, keys: Sequence[str], weight: str = "valid_signal_sample_count", distinct_robots: bool = True
) -> DataFrame:
    """Grouped statistics folded to coarser keys; means weighted by ``weight``."""
    usable = (F.col(weight) > 0) & F.col("average_valid_rssi").isNotNull()
    folded = stats.groupBy(*keys).agg(
        F.sum("sample_count").alias("sample_count"),
        F.coalesce(F.sum(F.when(usable, F.col("valid_signal_sample_count"))), _zero()).alias(
            "valid_signal_sample_count"
        ),
        F.sum("zero_signal_sample_count").alias("zero_signal_sample_count"),
        F.min("minimum_valid_rssi").alias("minimum_valid_rssi"),
        F.sum(F.when(usable, F.col("average_valid_rssi") * F.col(weight))).alias("_weighted"),
        F.sum(F.when(usable, F.col(weight))).alias("_weight"),
        *([F.count_distinct("robot_code").alias("robot_count")]
          if distinct_robots and "robot_code" in stats.columns and "robot_code" not in keys else []),
    )
    mean = ratio(F.col("_weighted") * 100, F.col("_weight") * 100, 6)
    return folded.withColumn("average_valid_rssi", mean).drop("_weighted", "_weight")


def point_comparison(by_robot_target: DataFrame) -> DataFrame:
    """Robots compared over their targets, mean weighted by all samples, in natural name order."""
    return reaggregate_rssi(by_robot_target, ["robot_code"], weight="sample_count").orderBy(*S.natural_key("robot_code"))


def profile_wifi_hourly(samples: DataFrame, weak: int = V.PROFILE_WEAK_RSSI) -> DataFrame:
    """One robot's raw samples per hour; here a zero reading counts as weak."""
    level = F.col("wifi_signal_level")
    valid = S.is_valid_rssi(level)
    hours = samples.groupBy(hour_start("pc_timestamp").alias("stat_hour")).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.sum(F.when(valid, level.cast("bigint"))).alias("_sum"),
        S.count_if(valid).alias("_valid"),
        F.min(F.when(valid, level)).alias("min_rssi"),
        F.max(F.when(valid, level)).alias("max_rssi"),
        S.count_if(S.is_zero_rssi(level)).alias("zero_signal_sample_count"),
        S.count_if(S.is_profile_weak_rssi(level, weak)).alias("weak_signal_sample_count"),
        F.min("pc_timestamp").alias("first_sample_time"),
        F.max("pc_timestamp").alias("last_sample_time"),
    )
    return hours.withColumns({
        "avg_rssi": ratio("_sum", "_valid", 2),
        "zero_signal_rate": percent("zero_signal_sample_count", "sample_count"),
    }).drop("_sum", "_valid").orderBy("stat_hour")
