"""Newest readings of tables stored by day, found from the newest folder backwards.

A table's newest reading usually lies in its newest day, so probes read that
day first and step back, two days, four days and so on, until they find one.
Tables that are not stored by day are left as they are.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import DAY_COLUMN

_DAY_FOLDER = re.compile(rf"/{DAY_COLUMN}=(\d{{4}}-\d{{2}}-\d{{2}})/")


def stored_days(df: DataFrame) -> list[date]:
    """Days a table has folders for, newest first; none for tables not stored by day."""
    if DAY_COLUMN not in df.columns:
        return []
    found = {match.group(1) for match in map(_DAY_FOLDER.search, df.inputFiles()) if match}
    return sorted(map(date.fromisoformat, found), reverse=True)


def newest_part(df: DataFrame, time: str, kept: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``df`` without the day folders before its newest reading; ``kept`` tells which rows count.

    The day of a row is that of ``time``, as ``write_model`` lays tables out.
    Nothing is left where no row counts.
    """
    days = stored_days(df)
    if not days:
        return df
    at, width = 0, 1
    while at < len(days):
        oldest = days[min(at + width, len(days)) - 1]
        part = df.filter((F.col(DAY_COLUMN) >= F.lit(oldest)) & (F.col(DAY_COLUMN) <= F.lit(days[at])) & F.col(time).isNotNull())
        if (kept(part) if kept else part).limit(1).count():
            return df.filter(F.col(DAY_COLUMN) >= F.lit(oldest))
        at, width = at + width, width * 2
    return df.filter(F.lit(False))


def newest_time(df: DataFrame, time: str) -> Column:
    """Newest reading as a subquery that reads the newest folders only."""
    return newest_part(df, time).agg(F.max(time).alias("anchor")).scalar()
