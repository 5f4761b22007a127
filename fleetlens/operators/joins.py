"""Joins: size-checked lookups, latest-per-key, pairing, overlays.

No operator here broadcasts data of unknown size, builds a cross join, or
relies on a key being evenly spread.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.time import ColumnOrName, WindowSpec, as_col, lit_ts

BROADCAST_BYTES_CONF = "spark.fleetlens.lookup.broadcastBytes"
SALTED_BYTES_CONF = "spark.fleetlens.lookup.saltedBytes"
SALTS_CONF = "spark.fleetlens.lookup.salts"
DEFAULT_BROADCAST_BYTES = 10 * 1024 * 1024
AUTO_BROADCAST_CONF = "spark.sql.autoBroadcastJoinThreshold"
DEFAULT_SALTED_BYTES = 0
DEFAULT_SALTS = 16


def plan_bytes(df: DataFrame) -> int:
    """Optimizer's size estimate of the plan, from file sizes times the session's factor for compressed files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _bytes(text: str) -> int:
    """Bytes of a size as sessions write it: ``10485760b``, ``256k``, ``10MB``, ``-1``."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)i?b?\s*", text.lower()).groups()
    return int(number) * 1024 ** " kmgtp".index(unit or " ")


def broadcast_limit(spark: SparkSession) -> int:
    """Bytes up to which ``lookup`` broadcasts: the user's own limit for it, else 10 MB, but no more than Spark may by itself.

    Every broadcast is built on the driver, so a session that keeps them small keeps those of ``lookup`` small too.
    """
    chosen = spark.conf.get(BROADCAST_BYTES_CONF, None)
    if chosen is not None:
        return int(chosen)
    return min(DEFAULT_BROADCAST_BYTES, _bytes(spark.conf.get(AUTO_BROADCAST_CONF)))


def lookup(
    facts: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "left", balanced: bool = False
) -> DataFrame:
    """Join ``facts`` to a smaller relation whatever the key distribution.

    Three ways, chosen by the size of ``dim``:

    * small enough by the optimizer's estimate: broadcast;
    * larger: plain shuffle join, where adaptive execution splits skewed
      partitions;
    * up to the size the session allows for it: shuffle join with the key
      salted, so that a key holding a large part of ``facts`` is spread over
      several tasks whatever follows.  Every salt is a copy of ``dim``, and the
      salt reads all columns of ``facts``.

    ``balanced`` states that no key holds many rows of ``facts``, as after an
    aggregate by that key: a plain join, whose way Spark chooses itself and
    which keeps a partitioning the facts already have.
    """
    keys = list(on)
    if balanced:
        return facts.join(dim, keys, how)
    conf = facts.sparkSession.conf
    size = plan_bytes(dim)
    if size <= broadcast_limit(facts.sparkSession):
        return facts.join(F.broadcast(dim), keys, how)
    if size > int(conf.get(SALTED_BYTES_CONF, str(DEFAULT_SALTED_BYTES))):
        return facts.join(dim, keys, how)
    salts = int(conf.get(SALTS_CONF, str(DEFAULT_SALTS)))
    # The partition number keeps identical rows of different input splits
    # apart; both parts are stable when a task is run again.
    salt = F.pmod(F.xxhash64(*facts.columns) + F.spark_partition_id(), F.lit(salts)).cast("int")
    salted = facts.withColumn("_salt", salt)
    copies = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, keys + ["_salt"], how).drop("_salt")


def keep_in_scope(
    facts: DataFrame, references: DataFrame, fact_col: str, ref_col: str, balanced: bool = False
) -> DataFrame:
    """Left-semi: fact rows whose reference occurs in ``references``."""
    wanted = references.select(F.col(ref_col).alias(fact_col)).distinct()
    return lookup(facts, wanted, [fact_col], "left_semi", balanced).select(*facts.columns)


def attach_dim(
    facts: DataFrame,
    dim: DataFrame,
    on: Mapping[str, str],
    columns: Mapping[str, str],
    how: str = "left",
    null_key: object | None = None,
    balanced: bool = False,
) -> DataFrame:
    """Bring ``columns`` (name in dim -> new name) to each fact row.

    ``on`` maps fact columns to dim columns.  ``null_key`` replaces NULL keys
    on both sides, so that "no value" joins to "no value".
    """
    left, right, names = facts, dim, []
    selected: list[Column] = []
    for index, (fact_key, dim_key) in enumerate(on.items()):
        name = f"_key{index}"
        fact_value, dim_value = F.col(fact_key), F.col(dim_key)
        if null_key is not None:
            fact_value = F.coalesce(fact_value, F.lit(null_key))
            dim_value = F.coalesce(dim_value, F.lit(null_key))
        left = left.withColumn(name, fact_value)
        selected.append(dim_value.alias(name))
        names.append(name)
    right = dim.select(*selected, *[F.col(source).alias(target) for source, target in columns.items()])
    return lookup(left, right, names, how, balanced).drop(*names)


def attach_by_reference(
    facts: DataFrame, bridge: DataFrame, ref_col: str, how: str = "inner", balanced: bool = False
) -> DataFrame:
    """Resolve a mixed name-or-id reference to its robot through the bridge.

    Equals the join ``ref = name OR ref = id``: the bridge holds one row per
    robot and distinct reference.
    """
    side = bridge.select(
        F.col("robot_reference").alias("_ref"), "master_robot_id", F.col("robot_code").alias("scope_robot_code"),
        "robot_type",
    )
    return lookup(facts.withColumn("_ref", F.col(ref_col)), side, ["_ref"], how, balanced).drop("_ref")


def latest_per_key(
    df: DataFrame, keys: Sequence[str], order_desc: Sequence[ColumnOrName], columns: Sequence[str] | None = None
) -> DataFrame:
    """Newest row of each key; ties fall to the later order columns.

    An aggregate instead of a ranked window: each task keeps one row per key
    before the shuffle, so a key with very many rows costs no more than others.
    """
    kept = [name for name in (columns or df.columns) if name not in keys]
    if len(kept) == len(order_desc) == 1:
        # Without structs the aggregate can hash fixed-width values instead of sorting.
        # Rows with a NULL order are the oldest, but still rows.
        value, order = F.col(kept[0]), as_col(order_desc[0])
        picked = F.when(F.count(order) > 0, F.max_by(value, order)).otherwise(F.max(value))
        return df.groupBy(*keys).agg(picked.alias(kept[0]))
    newest = F.max_by(F.struct(*kept), F.struct(*[as_col(order).alias(f"o{i}") for i, order in enumerate(order_desc)]))
    return df.groupBy(*keys).agg(newest.alias("_row")).select(*keys, "_row.*")


def strict_time_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    row_id: str,
    left_columns: Sequence[str],
    right_columns: Sequence[str],
) -> DataFrame:
    """Newest left row and newest right row with exactly equal keys.

    Keys are nearly unique, so reducing rows before the shuffle would sort them
    for nothing: each side is dealt out by its keys once, ranked there, and
    joined where it lies, one to one.
    """
    def newest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
        wanted = [name for name in columns if name not in keys]
        ordered = Window.partitionBy(*keys).orderBy(F.col("_id").desc_nulls_last())
        placed = df.select(*keys, F.col(row_id).alias("_id"), *wanted).repartition(*keys)
        return placed.withColumn("_rank", F.row_number().over(ordered)).filter(F.col("_rank") == 1).drop("_id", "_rank")

    return newest(left, left_columns).join(newest(right, right_columns), list(keys), "inner")


def overlay(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Columns of ``patch`` replace those of ``base`` where a patch row exists, NULLs included.

    Both hold about one row per key.
    """
    shared = [name for name in patch.columns if name in base.columns and name != key]
    added = [name for name in patch.columns if name not in base.columns]
    wrapped = patch.select(key, F.struct(*[name for name in patch.columns if name != key]).alias("_patch"))
    joined = lookup(base, wrapped, [key], "left", balanced=True)
    return joined.select(
        *[
            F.when(F.col("_patch").isNotNull(), F.col(f"_patch.{name}")).otherwise(F.col(name)).alias(name)
            if name in shared else F.col(name)
            for name in base.columns
        ],
        *[F.col(f"_patch.{name}").alias(name) for name in added],
    )


def pair_events(
    events: DataFrame,
    source_keys: Sequence[str] = ("source_schema", "source_table", "source_ods_row_id"),
    part_col: str = "source_event_part",
    time_col: str = "event_time",
    robot_col: str = "robot_code",
    start: str = V.EVENT_START,
    end: str = V.EVENT_END,
    window: WindowSpec | None = None,
) -> DataFrame:
    """START and END rows of one source row become an interval.

    One aggregate by source row replaces the self join.  A repeated END keeps
    the latest, a repeated START the earliest reading and its robot.  With a
    window, only overlapping intervals remain, clipped to it.
    """
    is_start, is_end = F.col(part_col) == start, F.col(part_col) == end
    if window is not None:
        # Neither filter can remove the earliest START or latest END of a kept pair.
        is_start = is_start & (F.col(time_col) < lit_ts(window.end))
        is_end = is_end & (F.col(time_col) > lit_ts(window.start))
    pairs = (
        events.filter(is_start | is_end)
        .groupBy(*source_keys)
        .agg(
            F.min(F.when(is_start, F.struct(F.col(time_col).alias("at"), F.col(robot_col).alias("robot")))).alias("_first"),
            F.max(F.when(is_end, F.col(time_col))).alias("end_time"),
        )
        .select(*source_keys, F.col("_first.at").alias("start_time"), "end_time", F.col("_first.robot").alias(robot_col))
        .filter(F.col("end_time") >= F.col("start_time"))
    )
    return clip(pairs, window) if window is not None else pairs


def clip(intervals: DataFrame, window: WindowSpec, start: str = "start_time", end: str = "end_time") -> DataFrame:
    """Cut intervals to the window bounds."""
    return intervals.withColumn(start, F.greatest(F.col(start), lit_ts(window.start))).withColumn(
        end, F.least(F.col(end), lit_ts(window.end))
    )


def current_sources(watermarks: DataFrame, anchors: DataFrame) -> DataFrame:
    """Watermarks that have reached the newest row of their source."""
    keys = ["source_schema", "source_table"]
    return (
        lookup(watermarks, anchors.select(*keys, "source_max_ods_row_id"), keys, "inner")
        .filter(F.col("last_ods_row_id") >= F.col("source_max_ods_row_id"))
    )


def one_row(*parts: DataFrame) -> DataFrame:
    """Side by side combination of aggregates that have exactly one row each."""
    first, *others = parts
    for index, part in enumerate(others):
        packed = part.select(F.struct(*part.columns).alias("_one")).scalar()
        first = first.select("*", packed.alias(f"_part{index}")).select(
            *first.columns, *[F.col(f"_part{index}.{name}").alias(name) for name in part.columns]
        )
    return first
