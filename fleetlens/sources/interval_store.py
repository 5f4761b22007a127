"""Paired intervals stored by the days they touch, so that a window reads its own days alone.

Executions (START and END events of one source row) and waits (queue record to
first start) may begin long before a window.  The store pairs events once, as
days come in, and writes every closed interval to the folder of each day it
touches.  What is still open at midnight is carried: unclosed starts in one
folder per processed day, queue records in an index by the day they began.

Rows are only added, and reading settles them: an execution grows from its
earliest START to its latest END, a wait shrinks to the nearest start that follows.
So a step that is repeated after a failure changes nothing, and days can be
processed again when rows arrive late.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import date, datetime, time, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.time import DAY_COLUMN, WindowSpec, in_window, lit_ts, prune_days
from ..operators.intervals import execution_events, queue_to_first_start
from ..operators.joins import clip
from ..operators.scan import with_neighbours
from ..session import cut

SOURCE_KEYS = ("source_schema", "source_table", "source_ods_row_id")
THROUGH = "through"  # folder of what is carried past that day
EARLIEST = datetime(1000, 1, 1)

EXECUTING = "source_schema string, source_table string, source_ods_row_id bigint, robot_code string, start_time timestamp, end_time timestamp, superseded boolean"
OPEN = "source_schema string, source_table string, source_ods_row_id bigint, robot_code string, start_time timestamp"
WAITING = "robot_code string, queue_id string, start_time timestamp, end_time timestamp, repeated boolean"
QUEUED = "queue_id string, queue_start_time timestamp"


def midnight(day: date) -> datetime:
    return datetime.combine(day, time())


def _time_of(one: DataFrame) -> datetime | None:
    """A single reading, whatever zone this process is in."""
    text = one.select(F.col(one.columns[0]).cast("string")).first()[0]
    return datetime.fromisoformat(text) if text else None


def _days(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(F.to_date(start), F.to_date(end))).alias(DAY_COLUMN)


class IntervalStore:
    """Executions and waits under one folder that every executor can read."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    # -- files ---------------------------------------------------------------

    def _read(self, name: str, schema: str, partition: str = DAY_COLUMN) -> DataFrame:
        try:
            return self.spark.read.schema(f"{schema}, {partition} date").parquet(f"{self.base}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], f"{schema}, {partition} date")

    def _add(self, rows: DataFrame, name: str, order: Sequence[str]) -> None:
        """Rows to their day folders; ranges divide them, so a busy day or robot is several files."""
        keys = [DAY_COLUMN, *order]
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("append").partitionBy(DAY_COLUMN).parquet(f"{self.base}/{name}")

    def through(self) -> date | None:
        """Last day that has been processed."""
        return self._read("steps", "step string", THROUGH).agg(F.max(THROUGH)).first()[0]

    # -- building ------------------------------------------------------------

    def advance(self, events: DataFrame, queue: DataFrame, upto: date, since: date | None = None) -> None:
        """Process the days after the last one up to ``upto``.

        ``since`` processes them again from that day on, for rows that arrived
        late.  The first step takes everything up to ``upto``.
        """
        last = self.through()
        if since is not None:
            if last is not None and upto < last:
                raise ValueError(f"days through {last} are processed; what follows {upto} would rest on what it replaces")
            before = self._read("steps", "step string", THROUGH).filter(F.col(THROUGH) < F.lit(since)).agg(F.max(THROUGH)).first()[0]
        else:
            before = last
            if before is not None and before >= upto:
                raise ValueError(f"days through {before} are processed; use since= to process some again")
        first = midnight(before + timedelta(days=1)) if before else EARLIEST
        span = WindowSpec(first, midnight(upto + timedelta(days=1)))
        self._advance_executing(execution_events(events), span, before, upto)
        self._advance_waiting(execution_events(events), queue, span)
        # Written last: a step that did not get here is done again.
        step = self.spark.createDataFrame([(uuid.uuid4().hex, upto)], f"step string, {THROUGH} date")
        step.write.mode("append").partitionBy(THROUGH).parquet(f"{self.base}/steps")

    def _advance_executing(self, executions: DataFrame, span: WindowSpec, before: date | None, upto: date) -> None:
        is_start, is_end = (F.col("source_event_part") == part for part in (V.EVENT_START, V.EVENT_END))
        keys = list(SOURCE_KEYS)
        seen = cut(
            in_window(executions, "event_time", span).filter(is_start | is_end).groupBy(*keys).agg(
                F.min(F.when(is_start, F.struct("event_time", "robot_code"))).alias("_first"),
                F.max(F.when(is_end, F.col("event_time"))).alias("end_time"),
            ).select(*keys, F.col("_first.robot_code"), F.col("_first.event_time").alias("start_time"), "end_time")
        )
        carried = self._read("open", OPEN, THROUGH).filter(F.col(THROUGH) == (F.lit(before) if before else F.lit(None).cast("date")))
        known = self._stored_of(seen)
        none = F.lit(None).cast("timestamp")
        columns = [*keys, "robot_code", "start_time", "end_time"]
        new = [none.alias("_start"), none.alias("_end"), F.lit(None).cast("string").alias("_robot")]
        held = [F.col("start_time").alias("_start"), F.col("end_time").alias("_end"), F.col("robot_code").alias("_robot")]
        all_rows = seen.select(*columns, *new).unionByName(carried.withColumn("end_time", none).select(*columns, *new)).unionByName(
            known.select(*columns, *held)
        )
        met = cut(all_rows.groupBy(*keys).agg(
            F.min(F.when(F.col("start_time").isNotNull(), F.struct("start_time", "robot_code"))).alias("_first"), F.max("end_time").alias("end_time"),
            F.min("_start").alias("_start"), F.max("_end").alias("_end"), F.min("_robot").alias("_robot"),
        ).select(*keys, "_first.start_time", "_first.robot_code", "end_time", "_start", "_end", "_robot"))
        closed = F.coalesce(F.col("end_time") >= F.col("start_time"), F.lit(False))
        same = F.col("start_time").eqNullSafe(F.col("_start")) & F.col("end_time").eqNullSafe(F.col("_end")) & F.col("robot_code").eqNullSafe(F.col("_robot"))
        written = met.filter(closed & ~same)
        fresh = written.select(*columns, F.lit(False).alias("superseded"), _days(F.col("start_time"), F.col("end_time")))
        # Its former rows name another robot: say on each of their days that they no longer hold.
        renamed = written.filter(F.col("_end").isNotNull() & ~F.col("robot_code").eqNullSafe(F.col("_robot")))
        gone = renamed.select(
            *keys, F.col("_robot").alias("robot_code"), F.col("_start").alias("start_time"), F.col("_end").alias("end_time"),
            F.lit(True).alias("superseded"), _days(F.col("_start"), F.col("_end")),
        )
        self._add(fresh.unionByName(gone), "executing", ["robot_code", "start_time"])
        still_open = met.filter(~closed & F.col("start_time").isNotNull()).select(*keys, "robot_code", "start_time")
        # A repeated step replaces the folder of its day.
        still_open.sortWithinPartitions(*keys).write.mode("overwrite").parquet(
            f"{self.base}/open/{THROUGH}={upto.isoformat()}"
        )

    def _stored_of(self, seen: DataFrame) -> DataFrame:
        """Stored executions of source rows that have further events; id bounds let the scan skip files of other ids."""
        row_id = SOURCE_KEYS[-1]
        low, high = seen.agg(F.min(row_id), F.max(row_id)).first()
        stored = self._read("executing", EXECUTING)
        stored = stored.filter(F.col(row_id).between(low, high)) if low is not None else stored.limit(0)
        return _settled(stored.join(seen.select(*SOURCE_KEYS), list(SOURCE_KEYS), "left_semi"))

    def _advance_waiting(self, executions: DataFrame, queue: DataFrame, span: WindowSpec) -> None:
        known = self._read("queued", QUEUED).select("queue_id", "queue_start_time")
        placed = F.col("queue_id").isNotNull() & F.col("queue_start_time").isNotNull()
        arrived = in_window(queue, "event_time", span).unionByName(queue.filter(F.col("event_time").isNull()))
        arrived = arrived.filter(placed).select("queue_id", "queue_start_time").distinct()
        fresh = cut(arrived.join(known, ["queue_id", "queue_start_time"], "left_anti"))
        starts = executions.filter((F.col("source_event_part") == V.EVENT_START) & F.col("queue_id").isNotNull())
        # Only queues with a new start or a new record can have new waits.
        moved = in_window(starts, "event_time", span).select("queue_id").unionByName(fresh.select("queue_id")).distinct()
        records = cut(known.unionByName(fresh).join(moved, "queue_id", "left_semi"))
        oldest = _time_of(records.agg(F.min("queue_start_time")))
        if oldest is not None:
            # No wait begins before its record: earlier days are not read.
            reached = in_window(starts, "event_time", WindowSpec(oldest, span.end))
            begun = reached.select("queue_id", "robot_code", "event_time").filter(F.col("robot_code").isNotNull()).join(moved, "queue_id", "left_semi").distinct()
            first = queue_to_first_start(records, begun).withColumn("repeated", F.lit(False))
            since = records.groupBy("queue_id").agg(F.min("queue_start_time").alias("_since"))
            chained = with_neighbours(begun, ["queue_id", "robot_code"], "event_time", preceding={"start_time": "event_time"})
            chained = chained.join(since, "queue_id").filter(F.col("start_time") >= F.col("_since"))
            columns = ["robot_code", "queue_id", "start_time", "end_time", "repeated"]
            found = first.select(columns).unionByName(
                chained.withColumnRenamed("event_time", "end_time").withColumn("repeated", F.lit(True)).select(columns)
            )
            renewed = fresh.select("queue_id", F.lit(True).alias("_fresh")).distinct()
            found = found.join(renewed, "queue_id", "left").filter((F.col("end_time") >= lit_ts(span.start)) | F.col("_fresh"))
            self._add(found.select(*columns, _days(F.col("start_time"), F.col("end_time"))), "waiting", ["robot_code", "start_time"])
        self._add(fresh.withColumn(DAY_COLUMN, F.to_date("queue_start_time")), "queued", ["queue_id"])

    # -- reading -------------------------------------------------------------

    def executing(self, window: WindowSpec, robots: Sequence[str] | None = None) -> DataFrame:
        """Executions that overlap the window, clipped to it, as ``pair_events`` gives them."""
        pairs = _settled(_on_days(self._read("executing", EXECUTING), window, robots)).drop("superseded")
        return clip(_overlapping(pairs, window), window)

    def waiting(self, window: WindowSpec, robots: Sequence[str] | None = None) -> DataFrame:
        """Waits that overlap the window, clipped to it, as ``queue_to_first_start`` gives them, equal ones once.

        A wait ends at the robot's first start after the window opens, so a
        robot that starts a queue's jobs one by one waits from each to the next.
        """
        rows = _overlapping(_on_days(self._read("waiting", WAITING), window, robots), window)
        opens = lit_ts(window.start)
        rows = rows.filter(~F.col("repeated") | (F.col("start_time") <= opens))
        shown = F.greatest("start_time", opens).alias("start_time")
        # Of the starts after the one instant the nearest counts, whichever rows tell of it.
        waits = rows.groupBy("robot_code", "queue_id", shown).agg(F.min("end_time").alias("end_time"))
        return clip(waits, window)


def _on_days(rows: DataFrame, window: WindowSpec, robots: Sequence[str] | None) -> DataFrame:
    within = prune_days(rows, lit_ts(window.start), lit_ts(window.end))
    return within.filter(F.col("robot_code").isin(*robots)) if robots else within


def _overlapping(intervals: DataFrame, window: WindowSpec) -> DataFrame:
    return intervals.filter((F.col("start_time") < lit_ts(window.end)) & (F.col("end_time") > lit_ts(window.start)))


def _settled(rows: DataFrame) -> DataFrame:
    """One row per source row: earliest start, latest end; rows of a robot that no longer holds are left out."""
    return rows.groupBy(*SOURCE_KEYS, "robot_code").agg(
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.max("superseded").alias("superseded")
    ).filter(~F.col("superseded"))
