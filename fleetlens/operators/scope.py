"""Robot scope, identity bridge, optional filters, anchors and search."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as S
from ..functions import vocab as V
from .joins import keep_in_scope, lookup


def robot_scope(master: DataFrame, robot_type: str = V.ALL_ROBOT_TYPES) -> DataFrame:
    """Active robots of the wanted type."""
    wanted = S.normalize_robot_type(robot_type)
    return master.filter(S.is_active_flag("is_active") & S.of_type("name", wanted)).select(
        F.col("id").alias("master_robot_id"), F.col("name").alias("robot_code"), S.robot_type("name").alias("robot_type")
    )


def commissioned(master: DataFrame, robot_type: str = V.ALL_ROBOT_TYPES) -> DataFrame:
    """Robots assigned to a factory that are active or carry a real serial number."""
    wanted = S.normalize_robot_type(robot_type)
    real_serial = ~S.upper_trim("serial_number").isin(*V.UNSET_SERIALS)
    return master.filter(
        F.col("factory_id").isNotNull() & S.of_type("name", wanted) & (S.is_active_flag("is_active") | real_serial)
    )


def reference_bridge(scope: DataFrame) -> DataFrame:
    """Each robot's distinct references: its name and its id as text."""
    references = F.array_distinct(F.array(F.col("robot_code"), F.col("master_robot_id").cast("string")))
    return scope.select(F.explode(references).alias("robot_reference"), *scope.columns)


def in_scope(
    facts: DataFrame, bridge: DataFrame, ref_col: str = "robot_code", balanced: bool = False
) -> DataFrame:
    return keep_in_scope(facts, bridge, ref_col, "robot_reference", balanced)


def anchor(facts: DataFrame, time_col: str, bridge: DataFrame | None = None, ref_col: str = "robot_code") -> DataFrame:
    """One row: newest time of in-scope facts.

    Reduced per reference before the scope is applied, so the semi join sees
    one row per reference.
    """
    if bridge is None:
        return facts.agg(F.max(time_col).alias("anchor"))
    newest = facts.groupBy(ref_col).agg(F.max(time_col).alias(time_col))
    return in_scope(newest, bridge, ref_col, balanced=True).agg(F.max(time_col).alias("anchor"))


def parse_list(text: object, as_type: str = "string") -> list:
    """Distinct items of a comma list; blanks and, for ``int``, non-numbers are dropped."""
    seen: dict = {}
    for part in _parts(text):
        if as_type == "int":
            try:
                seen.setdefault(int(part))
            except ValueError:
                continue
        else:
            seen.setdefault(part)
    return list(seen)


class ScopeError(ValueError):
    """A project or task identifier that is not a plain integer."""

    code = "INVALID_PROJECT_SCOPE"


def parse_id_list(text: object) -> list[int]:
    """Like ``parse_list`` for integers, but anything else is an error."""
    ids: dict[int, None] = {}
    for part in _parts(text):
        if not part.lstrip("-").isdigit() or str(int(part)) != part:
            raise ScopeError("project and task identifiers must be integers")
        ids.setdefault(int(part))
    return list(ids)


def _parts(text: object) -> Iterable[str]:
    if text is None:
        return []
    items = text if isinstance(text, (list, tuple, set)) else str(text).split(",")
    return [cleaned for cleaned in (str(item).strip() for item in items) if cleaned]


def split_list(column: Column, as_type: str = "string") -> Column:
    """Column form of ``parse_list``: a comma list as a distinct array."""
    parts = F.filter(F.transform(F.split(column, ","), lambda item: F.trim(item)), lambda item: item != "")
    if as_type == "int":
        parts = F.filter(F.transform(parts, lambda item: item.try_cast("int")), lambda item: item.isNotNull())
    return F.array_distinct(parts)


def in_or_all(df: DataFrame, column: str, values: Sequence | None) -> DataFrame:
    """Keep the selected values; an empty selection keeps everything."""
    return df.filter(F.col(column).isin(*values)) if values else df


def restrict(df: DataFrame, key: str, subset: DataFrame, subset_key: str | None = None) -> DataFrame:
    return keep_in_scope(df, subset, key, subset_key or key)


SEARCH_COLUMNS = (
    "robot_code", "robot_name", "master_robot_id", "robot_serial_number", "current_status", "current_mode",
    "current_mode_id", "station_code", "target_station_code", "job_id", "current_wifi_ap", "error_code",
    "error_message",
)


def search(df: DataFrame, text: str | None, columns: Sequence[str] = SEARCH_COLUMNS) -> DataFrame:
    """Rows where any of the columns contains the text, ignoring case."""
    wanted = (text or "").strip().lower()
    if not wanted:
        return df
    found = F.lit(False)
    for name in columns:
        if name in df.columns:
            found = found | F.coalesce(F.lower(F.col(name).cast("string")).contains(wanted), F.lit(False))
    return df.filter(found)


def null_cols(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Add typed NULL columns for fields the sources cannot measure."""
    return df.select("*", *[S.typed_null(kind).alias(name) for name, kind in types.items()])


def empty(spark, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def display_robots(
    robots: DataFrame, derived: DataFrame | None, selected: Sequence[str] | None = None, name_col: str = "robot_name"
) -> DataFrame:
    """Robots of a project scope, optionally narrowed to a display selection.

    ``derived`` holds the robots that carried the selected work; None means no
    project scope, which keeps every robot.
    """
    if derived is None:
        return robots
    names = in_or_all(derived, name_col, selected).select(F.trim(F.col(name_col)).alias("_name"))
    names = names.filter(F.col("_name") != "").distinct()
    candidates = robots.withColumn(
        "_name", F.explode(F.array_distinct(F.array(F.trim("robot_code"), F.trim("robot_name"))))
    )
    hits = lookup(candidates, names, ["_name"], "left_semi").select("master_robot_id").distinct()
    return lookup(robots, hits, ["master_robot_id"], "left_semi").select(*robots.columns)
