"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_of_each(rows: DataFrame, *keys: str) -> DataFrame:
    """Of the rows that share ``keys`` the one whose text has the smallest digest, so that a bound on ids is one on rows."""
    others = [name for name in rows.columns if name not in keys]
    digest = F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_digest")
    return rows.groupBy(*keys).agg(F.min(F.struct(digest, *others)).alias("_row")).select(*keys, *[F.col(f"_row.{name}") for name in others])
