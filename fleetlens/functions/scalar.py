"""Scalar column functions shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V
from .time import ColumnOrName, as_col


# --------------------------------------------------------------------------
# text and nulls
# --------------------------------------------------------------------------

def upper_trim(value: ColumnOrName) -> Column:
    return F.upper(F.trim(F.coalesce(as_col(value).cast("string"), F.lit(""))))


def lower_trim(value: ColumnOrName) -> Column:
    return F.lower(F.trim(F.coalesce(as_col(value).cast("string"), F.lit(""))))


def blank_to_null(value: ColumnOrName) -> Column:
    return F.nullif(F.trim(as_col(value)), F.lit(""))


def has_value(value: ColumnOrName) -> Column:
    return F.coalesce(F.trim(as_col(value).cast("string")) != "", F.lit(False))


def fallback(value: ColumnOrName, text: str) -> Column:
    return F.coalesce(as_col(value), F.lit(text))


def label(name: ColumnOrName, identifier: ColumnOrName, prefix: str) -> Column:
    """``name · #id``; without a name ``prefix`` and the id."""
    given = F.nullif(as_col(name), F.lit(""))
    number = as_col(identifier).cast("string")
    return F.when(given.isNull(), F.concat(F.lit(prefix), number)).otherwise(
        F.concat(given, F.lit(V.LABEL_SEPARATOR), number)
    )


def try_int(value: ColumnOrName) -> Column:
    """Integer key of a text reference; blank or non-numeric text gives NULL."""
    return F.trim(as_col(value)).try_cast("int")


def try_long(value: ColumnOrName) -> Column:
    return F.trim(as_col(value)).try_cast("bigint")


def one_of(value: Column, words: Iterable[str]) -> Column:
    return value.isin(*words)


def typed_null(type_name: str) -> Column:
    return F.lit(None).cast(type_name)


def row_max(*columns: ColumnOrName) -> Column:
    """Largest of several columns of a row, ignoring NULLs."""
    return F.greatest(*[as_col(column) for column in columns])


def suppress(value: ColumnOrName, gate: ColumnOrName) -> Column:
    """Keep a last-known value only while its freshness gate is CURRENT."""
    return F.when(as_col(gate) == V.CURRENT, as_col(value))


# --------------------------------------------------------------------------
# counting and exact ratios
# --------------------------------------------------------------------------

def count_if(condition: Column) -> Column:
    """Rows where ``condition`` holds, as a long that is never NULL within a group."""
    return F.count(F.when(condition, F.lit(1)))


def ratio(numerator: ColumnOrName, denominator: ColumnOrName, scale: int, factor: int = 1) -> Column:
    """``factor * numerator / denominator`` rounded half away from zero.

    Works on whole numbers, so the result is exact for any group size; a zero
    or NULL denominator gives NULL.
    """
    unit = 10 ** scale
    top = as_col(numerator).cast("decimal(38,0)") * F.lit(2 * unit * factor).cast("decimal(12,0)")
    bottom = F.nullif(as_col(denominator).cast("bigint"), F.lit(0).cast("bigint"))
    below = (bottom * 2).cast("decimal(20,0)")
    rounded = F.call_function("div", F.abs(top) + bottom, below)
    signed = F.when(top < 0, -rounded).otherwise(rounded)
    return (signed.cast("decimal(20,0)") * F.lit(f"{1 / unit:.{scale}f}").cast(f"decimal({scale + 1},{scale})")).cast(
        f"decimal(18,{scale})"
    )


def percent(part: ColumnOrName, whole: ColumnOrName, scale: int = 2) -> Column:
    return ratio(part, whole, scale, factor=100)


# --------------------------------------------------------------------------
# robots
# --------------------------------------------------------------------------

def robot_type(name: ColumnOrName) -> Column:
    cleaned = upper_trim(name)
    first, second = V.ROBOT_TYPES
    return (
        F.when(cleaned.startswith(first), F.lit(first))
        .when(cleaned.startswith(second), F.lit(second))
        .otherwise(F.lit(V.OTHER_ROBOT_TYPE))
    )


def normalize_robot_type(value: object) -> str:
    text = str(value or V.ALL_ROBOT_TYPES).strip().upper()
    return text if text in V.ROBOT_TYPES else V.ALL_ROBOT_TYPES


def of_type(name: ColumnOrName, wanted: str) -> Column:
    return F.lit(True) if wanted == V.ALL_ROBOT_TYPES else upper_trim(name).startswith(wanted)


def is_active_flag(value: ColumnOrName) -> Column:
    return upper_trim(value) == V.ACTIVE_FLAG


def is_true(value: ColumnOrName) -> Column:
    """True for boolean true, 1 and '1'."""
    return F.coalesce(F.lower(as_col(value).cast("string")).isin("true", "1"), F.lit(False))


def online_state(value: ColumnOrName) -> Column:
    text = upper_trim(value)
    return (
        F.when(one_of(text, V.ONLINE_WORDS), F.lit("online"))
        .when(one_of(text, V.OFFLINE_WORDS), F.lit("offline"))
        .otherwise(F.lit("unknown"))
    )


def has_active_job(is_active_job: ColumnOrName | None, job_id: ColumnOrName) -> Column:
    """The explicit flag decides where the source has one, else the job id text."""
    if is_active_job is not None:
        return is_true(is_active_job)
    return ~one_of(upper_trim(job_id), V.IDLE_JOB_WORDS)


def is_device_error(code: ColumnOrName, message: ColumnOrName) -> Column:
    return ~one_of(upper_trim(code), V.ERROR_CODE_NOISE) | ~one_of(upper_trim(message), V.ERROR_MESSAGE_NOISE)


def is_charging(status: ColumnOrName, mode: ColumnOrName) -> Column:
    return one_of(upper_trim(status), V.CHARGING_WORDS) | upper_trim(mode).contains(V.CHARGING_MODE_PART)


def is_low_battery(soc: ColumnOrName) -> Column:
    return F.coalesce(as_col(soc).between(*V.LOW_BATTERY_RANGE), F.lit(False))


def robot_display(code: ColumnOrName, name: ColumnOrName, master_id: ColumnOrName) -> Column:
    return F.coalesce(
        F.nullif(as_col(code), F.lit("")),
        F.nullif(as_col(name), F.lit("")),
        F.concat(F.lit("Master "), as_col(master_id).cast("string")),
        F.lit("Unknown robot"),
    )


# --------------------------------------------------------------------------
# signal strength
# --------------------------------------------------------------------------

def is_valid_rssi(level: ColumnOrName) -> Column:
    return as_col(level) < 0


def is_zero_rssi(level: ColumnOrName) -> Column:
    return as_col(level) == 0


def is_weak_rssi(level: ColumnOrName, threshold: int = V.WEAK_RSSI) -> Column:
    return (as_col(level) <= threshold) & is_valid_rssi(level)


def is_profile_weak_rssi(level: ColumnOrName, threshold: int = V.PROFILE_WEAK_RSSI) -> Column:
    return is_zero_rssi(level) | (as_col(level) <= threshold)


# --------------------------------------------------------------------------
# orderings
# --------------------------------------------------------------------------

def rank_order(value: ColumnOrName, ranks: Mapping[str, int], default: int = 0) -> Column:
    """Sort rank of a code; unknown codes get ``default``."""
    column = as_col(value)
    chain = None
    for code, rank in ranks.items():
        chain = F.when(column == code, F.lit(rank)) if chain is None else chain.when(column == code, F.lit(rank))
    return chain.otherwise(F.lit(default))


def natural_key(value: ColumnOrName) -> list[Column]:
    """Sort keys that put ``LM9`` before ``LM10``: lowered prefix, number, full text."""
    column = as_col(value)
    digits = F.regexp_extract(column, r"(\d+)\s*$", 1)
    prefix = F.lower(F.regexp_replace(column, r"\d+\s*$", ""))
    return [prefix, F.nullif(digits, F.lit("")).try_cast("decimal(38,0)"), F.lower(column), column]
