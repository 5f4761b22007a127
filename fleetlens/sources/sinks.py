"""Sinks: CSV and JSON exports of report results."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(df: DataFrame) -> DataFrame:
    """List columns as one text cell, since CSV has no nesting."""
    return df.select(*[
        F.array_join(F.col(f.name).cast("array<string>"), "; ").alias(f.name)
        if isinstance(f.dataType, T.ArrayType) else F.col(f.name)
        for f in df.schema
    ])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header line, fields quoted where needed, quotes doubled, NULL as an empty field."""
    (
        flat(df).write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
        .option("emptyValue", "").option("nullValue", "").csv(path)
    )


def write_json(report: Mapping[str, DataFrame], folder: str, mode: str = "overwrite") -> None:
    """One folder of JSON lines per named result, NULL fields kept."""
    for name, df in report.items():
        df.write.mode(mode).option("ignoreNullFields", False).json(f"{folder.rstrip('/')}/{name}")


# --------------------------------------------------------------------------
# one file for a whole result
# --------------------------------------------------------------------------

BYTE_ORDER_MARK = "\ufeff"


class _Merged:
    """A file put together from the ordered part files of written results, streamed and never held."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._target = self._jvm.org.apache.hadoop.fs.Path(path)
        self._files = self._target.getFileSystem(self._conf)
        self._parts = f"{path}.parts-{uuid.uuid4().hex}"

    def __enter__(self) -> _Merged:
        self._out = self._files.create(self._target, True)
        return self

    def __exit__(self, *error) -> None:
        self._out.close()
        self._files.delete(self._jvm.org.apache.hadoop.fs.Path(self._parts), True)
        if error[0]:
            self._files.delete(self._target, False)

    def text(self, text: str) -> None:
        self._out.write(bytearray(text.encode()))

    def lines(self, df: DataFrame, name: str, between: str, after_last: bool) -> None:
        """The only column of ``df``, line by line in its order, with ``between`` after each one (or all but the last)."""
        folder = self._jvm.org.apache.hadoop.fs.Path(f"{self._parts}/{name}")
        df.write.option("lineSep", between).text(folder.toString())
        found = [status for status in self._files.listStatus(folder) if status.getPath().getName().startswith("part-") and status.getLen()]
        found.sort(key=lambda status: status.getPath().getName())
        for i, status in enumerate(found, 1):
            length = status.getLen() - (len(between.encode()) if i == len(found) and not after_last else 0)
            source = self._files.open(status.getPath())
            try:
                self._jvm.org.apache.commons.io.IOUtils.copyLarge(source, self._out, 0, length)
            finally:
                source.close()


def write_csv_file(df: DataFrame, path: str, byte_order_mark: bool = True, line_end: str = "\r\n") -> None:
    """One CSV file in the order of ``df``: header, quoted where needed, NULL as an empty field."""
    plain = flat(df)
    options = {"quote": '"', "escape": '"', "emptyValue": "", "nullValue": ""}
    rows = plain.select(F.to_csv(F.struct(*[F.col(f"`{name}`") for name in plain.columns]), options).alias("value"))
    quoted = ['"' + name.replace('"', '""') + '"' if any(c in name for c in '",\r\n') else name for name in plain.columns]
    with _Merged(df.sparkSession, path) as out:
        out.text((BYTE_ORDER_MARK if byte_order_mark else "") + ",".join(quoted) + line_end)
        out.lines(rows, "rows", line_end, True)


def write_document(
    report: Mapping[str, DataFrame], path: str, head: Mapping[str, object], body: str = "dashboard", single: Sequence[str] = ("summary",)
) -> None:
    """A whole report as one JSON document: the fields of ``head``, then the results under ``body``.

    Results are lists of rows in their order, NULL fields kept; those named in
    ``single`` are their only row, or null.
    """
    spark = next(iter(report.values())).sparkSession
    with _Merged(spark, path) as out:
        fields = [f"{json.dumps(name)}: {json.dumps(value, default=str)}" for name, value in head.items()]
        out.text("{" + "".join(f"{field},\n" for field in fields) + f"{json.dumps(body)}: {{")
        for i, (name, df) in enumerate(report.items()):
            rows = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))
            alone = name in single
            out.text((",\n" if i else "\n") + json.dumps(name) + (": " if alone else ": ["))
            if alone and not rows.limit(1).count():
                out.text("null")
            else:
                out.lines(rows.limit(1) if alone else rows, str(i), ",\n", False)
            out.text("" if alone else "]")
        out.text("}}\n")


def report_head(as_of: datetime, robot_type: str, window: Mapping[str, object], note: str = "") -> dict[str, object]:
    """Fields that a report's document starts with."""
    return {"exportedAt": as_of.isoformat(), "selectedRobotType": robot_type, "selectedWindow": dict(window), "sourceNote": note}
