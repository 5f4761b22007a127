"""Ordered scans over one key's rows without putting the key into one task.

``lag``, ``lead`` and running aggregates by robot would send every row of a
robot to the same task.  Here each key is cut into time chunks.  Windows run
within (key, chunk); what must cross a chunk border comes from a summary with
one row per key and chunk, whose windows are short: their length is the
number of chunks in the data, not the number of rows.

Callers first reduce rows to one per key and instant, which bounds a chunk by
its length divided by the clock's resolution.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import ColumnOrName, as_col
from .joins import lookup

CHUNK = "_chunk"
DEFAULT_CHUNK_SECONDS = 6 * 3600


def chunk_of(ts: ColumnOrName, chunk_seconds: int = DEFAULT_CHUNK_SECONDS) -> Column:
    return F.floor(F.unix_seconds(as_col(ts)) / int(chunk_seconds)).alias(CHUNK)


def _chunked(df: DataFrame, keys: Sequence[str], time: str, chunk_seconds: int) -> DataFrame:
    """Rows with their chunk; rows without key or time have no place in any order.

    Saying so for all readers of ``df`` also lets them share its shuffle: the
    join below would otherwise filter NULLs on one of its sides only.  Rows
    that kept their chunk from an earlier scan are still partitioned by it.
    """
    if CHUNK in df.columns:
        return df
    placed = F.col(CHUNK).isNotNull()
    for key in keys:
        placed = placed & F.col(key).isNotNull()
    return df.withColumn(CHUNK, chunk_of(time, chunk_seconds)).filter(placed)


def _kept(df: DataFrame, keep_chunk: bool) -> list[str]:
    """Columns a scan passes on."""
    return [name for name in df.columns if name != CHUNK] + ([CHUNK] if keep_chunk else [])


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    following: Mapping[str, ColumnOrName] | None = None,
    preceding: Mapping[str, ColumnOrName] | None = None,
    key_max: Mapping[str, ColumnOrName] | None = None,
    chunk_seconds: int = DEFAULT_CHUNK_SECONDS,
    keep_chunk: bool = False,
) -> DataFrame:
    """Values of the next and previous row of the key, and maxima over the whole key.

    ``df`` must hold at most one row per key and ``time``.  ``keep_chunk``
    leaves the chunk in the result for another scan over the same time column.
    """
    keys = list(keys)
    following, preceding, key_max = following or {}, preceding or {}, key_max or {}
    rows = _chunked(df, keys, time, chunk_seconds)

    # One aggregate per value: over fixed-width values each hashes, where a struct of them would be sorted.
    by_chunk = Window.partitionBy(*keys).orderBy(CHUNK)
    inside = Window.partitionBy(*keys, CHUNK).orderBy(time)
    whole_key = Window.partitionBy(*keys)
    edge_aggregates, carried, local, out = [], [], [], []
    for side, columns, nearest, shift in (("next", following, F.min_by, F.lead), ("prev", preceding, F.max_by, F.lag)):
        if not columns:
            continue
        local.append(shift(F.lit(True)).over(inside).alias(f"_{side}"))
        for name, value in columns.items():
            held = f"_{side}_{name}"
            edge_aggregates.append(nearest(as_col(value), F.col(time)).alias(held))
            carried.append(shift(held).over(by_chunk).alias(f"{held}_beyond"))
            local.append(shift(as_col(value)).over(inside).alias(held))
            out.append(F.when(F.col(f"_{side}"), F.col(held)).otherwise(F.col(f"{held}_beyond")).alias(name))
    edge_aggregates += [F.max(as_col(value)).alias(f"_max_{name}") for name, value in key_max.items()]
    carried += [F.max(f"_max_{name}").over(whole_key).alias(name) for name in key_max]
    out += [F.col(name) for name in key_max]
    edges = rows.groupBy(*keys, CHUNK).agg(*edge_aggregates).select(*keys, CHUNK, *carried)
    joined = lookup(rows.select("*", *local), edges, [*keys, CHUNK], "left", balanced=True)
    return joined.select(*_kept(df, keep_chunk), *out)


def with_running_max(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    value: str,
    prior: str,
    overall: str,
    chunk_seconds: int = DEFAULT_CHUNK_SECONDS,
    keep_chunk: bool = False,
) -> DataFrame:
    """``prior``: largest ``value`` of all earlier rows of the key; ``overall``: of all its rows."""
    keys = list(keys)
    rows = _chunked(df, keys, time, chunk_seconds)
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    tops = (
        rows.groupBy(*keys, CHUNK)
        .agg(F.max(value).alias("_top"))
        .select(
            *keys, CHUNK,
            F.max("_top").over(before).alias("_carry"),
            F.max("_top").over(Window.partitionBy(*keys)).alias(overall),
        )
    )
    inside = Window.partitionBy(*keys, CHUNK).orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_local", F.max(value).over(inside))
    return lookup(local, tops, [*keys, CHUNK], "left", balanced=True).select(
        *_kept(df, keep_chunk), F.greatest("_local", "_carry").alias(prior), overall
    )


def _asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    time_left: str,
    time_right: str,
    value: str,
    out: str,
    forward: bool,
    chunk_seconds: int,
    ignore_nulls: bool,
) -> DataFrame:
    keys = list(keys)
    usable = F.col(time_right).isNotNull()
    for name in [*keys, *([value] if ignore_nulls else [])]:
        usable = usable & F.col(name).isNotNull()
    values = (
        right.filter(usable).groupBy(*keys, F.col(time_right).alias("_at"))
        .agg(F.max(value).alias("_value"))
        .select(*keys, "_at", "_value", F.lit(None).cast(left.schema).alias("_row"))
    )
    asked = left.select(
        *keys, F.col(time_left).alias("_at"), F.lit(None).cast(values.schema["_value"].dataType).alias("_value"),
        F.struct(*left.columns).alias("_row"),
    )
    rows = asked.unionByName(values).withColumn(CHUNK, chunk_of("_at", chunk_seconds))
    is_value = F.col("_row").isNull()
    known_at = F.when(is_value, F.col("_at"))
    nearest, reach, pick = F.max_by, (Window.unboundedPreceding, -1), F.last
    local_frame = (Window.unboundedPreceding, Window.currentRow)
    if forward:
        nearest, reach, pick = F.min_by, (1, Window.unboundedFollowing), F.first
        local_frame = (Window.currentRow, Window.unboundedFollowing)
    beyond = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(*reach)
    carry = (
        rows.groupBy(*keys, CHUNK)
        .agg(nearest("_value", known_at).alias("_nearest"), F.count(known_at).alias("_values"))
        .select(
            *keys, CHUNK,
            pick(F.when(F.col("_values") > 0, F.struct("_nearest")), ignorenulls=True).over(beyond).alias("_carry"),
        )
    )
    # At equal times questions sort before values: looking back finds strictly
    # earlier values, looking ahead finds values at or after the question.
    inside = (
        Window.partitionBy(*keys, CHUNK).orderBy(F.col("_at"), F.col("_row").isNull()).rowsBetween(*local_frame)
    )
    local = rows.withColumn("_seen", pick(F.when(is_value, F.struct("_value")), ignorenulls=True).over(inside))
    return lookup(local.filter(F.col("_row").isNotNull()), carry, [*keys, CHUNK], "left", balanced=True).select(
        "_row.*",
        F.when(F.col("_seen").isNotNull(), F.col("_seen._value")).otherwise(F.col("_carry._nearest")).alias(out),
    )


def asof_before(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    time_left: str,
    time_right: str,
    value: str,
    out: str,
    where: Column | None = None,
    chunk_seconds: int = DEFAULT_CHUNK_SECONDS,
    ignore_nulls: bool = False,
) -> DataFrame:
    """For each left row the right ``value`` at the newest time strictly before it.

    Keys match as in SQL, so a NULL key finds nothing.  The newest right row
    counts even if its value is NULL, unless ``ignore_nulls``.
    """
    source = right.filter(where) if where is not None else right
    return _asof(left, source, keys, time_left, time_right, value, out, False, chunk_seconds, ignore_nulls)


def asof_after(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    time_left: str,
    time_right: str,
    value: str,
    out: str,
    chunk_seconds: int = DEFAULT_CHUNK_SECONDS,
    ignore_nulls: bool = False,
) -> DataFrame:
    """For each left row the right ``value`` at the earliest time at or after it; see ``asof_before`` for NULLs."""
    return _asof(left, right, keys, time_left, time_right, value, out, True, chunk_seconds, ignore_nulls)
