"""The benchmark tables bound to the fleet model.

``events`` become telemetry of robots, ``orders`` queue records, ``lineitem``
task runs and ``customer`` the robot master.  Everything is whole-number and
text arithmetic, so another engine can rebuild the same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import hour_start
from ..session import prepare

AS_OF = "2024-01-31 00:00:00"

# Declared, so that opening a table reads no file footers.
RAW_SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def _ts(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def _plus_minutes(time: Column, minutes: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(time) + minutes.cast("bigint") * F.lit(60_000_000).cast("bigint"))


class DriverTables:
    """Model tables over one scale-factor folder; use ``tables["name"]``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = prepare(spark), sf_dir.rstrip("/")

    def __getitem__(self, name: str) -> DataFrame:
        if name.startswith("_") or not hasattr(type(self), name):
            raise KeyError(name)
        return getattr(self, name)

    def __contains__(self, name: str) -> bool:
        return not name.startswith("_") and hasattr(type(self), name)

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(RAW_SCHEMAS[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def _events(self) -> DataFrame:
        return self._read("events").select(
            "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("int").alias("user_id"),
            "event_type", F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
        )

    @cached_property
    def _orders(self) -> DataFrame:
        return self._read("orders").select(
            "o_orderkey", F.col("o_custkey").cast("int").alias("o_custkey"), "o_orderstatus",
            F.floor(F.col("o_totalprice") / 1000).cast("int").alias("price_k"),
            F.col("o_orderdate").cast("timestamp").alias("o_orderdate"), "o_orderpriority",
        )

    # -- masters -----------------------------------------------------------

    @cached_property
    def robot_master(self) -> DataFrame:
        segment = F.col("c_mktsegment")
        prefix = (
            F.when(segment.isin("AUTOMOBILE", "MACHINERY"), F.lit("AMR_"))
            .when(segment.isin("BUILDING", "FURNITURE"), F.lit("AMB_")).otherwise(F.lit("CART_"))
        )
        key = F.col("c_custkey").cast("string")
        return self._read("customer").select(
            F.col("c_custkey").cast("int").alias("id"), F.concat(prefix, key).alias("name"),
            F.when(F.col("c_acctbal") < 0, F.lit("n")).otherwise(F.lit(" y ")).alias("is_active"),
            F.when(segment == "HOUSEHOLD", F.lit(" undefined ")).otherwise(F.concat(F.lit("SN-"), key)).alias(
                "serial_number"
            ),
            segment.alias("status"), F.nullif(F.col("c_nationkey"), F.lit(0)).alias("factory_id"),
            F.lit(95).alias("max_battery"), F.lit(20).alias("min_battery"),
            _plus_minutes(_ts("2024-01-01 00:00:00"), F.col("c_nationkey")).alias("updated_at"),
        )

    @cached_property
    def _names(self) -> DataFrame:
        return self.robot_master.select(F.col("id").alias("_id"), F.col("name").alias("robot_code"))

    def _with_name(self, df: DataFrame, key: str) -> DataFrame:
        return df.join(self._names, F.col(key) == F.col("_id")).drop("_id")

    @cached_property
    def robot_dim(self) -> DataFrame:
        """Robots that have reported telemetry."""
        reporting = self._events.select(F.col("user_id").alias("id")).distinct()
        return self.robot_master.join(reporting, ["id"], "left_semi").select(
            F.col("name").alias("robot_code"), F.col("id").cast("string").alias("robot_id"),
            (F.col("is_active") == " y ").alias("is_enabled"),
        )

    @cached_property
    def project(self) -> DataFrame:
        return self._read("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))

    @cached_property
    def project_assignment(self) -> DataFrame:
        return self._read("customer").select(F.col("c_custkey").cast("int").alias("amr_id"))

    @cached_property
    def task_dim(self) -> DataFrame:
        return self._read("nation").select(
            F.col("n_nationkey").alias("job_id"),
            F.when(F.col("n_regionkey") == 3, F.lit("")).otherwise(F.col("n_name")).alias("task_name"),
        )

    @cached_property
    def subjob(self) -> DataFrame:
        ending = F.when(F.col("n_regionkey") == 1, F.lit(" Unload")).otherwise(F.lit(""))
        return self._read("nation").select(
            F.col("n_nationkey").alias("id"), F.concat("n_name", ending).alias("name"),
            F.col("n_regionkey").alias("type_id"),
        )

    @cached_property
    def subjob_type(self) -> DataFrame:
        return self.project

    @cached_property
    def duration_limit(self) -> DataFrame:
        days = F.when(F.col("p_size") == 10, F.lit(0)).otherwise(F.floor("p_retailprice"))
        brand = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")
        return self._read("part").select(
            F.col("p_partkey").alias("id"), (F.col("p_size") % 25).cast("int").alias("job_id"),
            F.nullif(brand % 8, F.lit(0)).cast("int").alias("subjob_id"),
            (days.cast("bigint") * F.lit(86_400_000).cast("bigint")).alias("limit"),
        )

    # -- samples -----------------------------------------------------------

    @cached_property
    def wifi_history(self) -> DataFrame:
        level = F.when(F.col("event_type") == "error", F.lit(0)).otherwise(-(F.lit(40) + F.col("k") % 45))
        return self._events.select(
            F.col("event_id").alias("ods_row_id"), F.col("user_id").alias("amr_id"), F.col("ts").alias("pc_timestamp"),
            level.alias("wifi_signal_level"),
        )

    @cached_property
    def wifi_source(self) -> DataFrame:
        return self.wifi_history.drop("ods_row_id")

    @cached_property
    def job_history(self) -> DataFrame:
        """Later duplicates of error rows carry another target, blank for high k."""
        status = F.when(F.col("event_type").isin("click", "view", "error"), F.lit("Running")).otherwise(F.lit("Idle"))
        target = F.concat(F.lit(" LM"), F.floor(F.col("k") / 10).cast("string"), F.lit(" "))
        columns = [F.col("user_id").alias("amr_id"), F.col("ts").alias("pc_timestamp")]
        first = self._events.select(
            F.col("event_id").alias("ods_row_id"), *columns, status.alias("job_status"),
            F.when(F.col("k") >= 95, F.lit("  ")).otherwise(target).alias("poi_target"),
        )
        later = self._events.filter(F.col("event_type") == "error").select(
            (F.col("event_id") + 1_000_000_000_000).alias("ods_row_id"), *columns, F.lit("Running").alias("job_status"),
            F.when(F.col("k") >= 80, F.lit("")).otherwise(F.lit("LM10")).alias("poi_target"),
        )
        return first.unionByName(later)

    @cached_property
    def battery_history(self) -> DataFrame:
        return self._events.select(
            F.col("user_id").alias("amr_id"), F.col("ts").alias("pc_timestamp"), F.col("k").alias("batt_level")
        )

    @cached_property
    def battery_fact(self) -> DataFrame:
        status = (
            F.when(F.col("event_type") == "purchase", F.lit(" charging "))
            .when(F.col("event_type") == "signup", F.lit(" ")).otherwise(F.lit("discharging"))
        )
        samples = self._events.select("user_id", F.col("ts").alias("sample_time"), status.alias("charging_status"))
        return self._with_name(samples, "user_id").drop("user_id")

    @cached_property
    def operation_event(self) -> DataFrame:
        """Executions from click and view, open starts from error, queue entries from signup."""
        kind = F.col("event_type")
        executed = kind.isin("click", "view")
        start = F.struct(
            F.lit("START").alias("part"), F.col("ts").alias("at"),
            F.when(kind == "click", F.lit("JOB_STARTED")).otherwise(F.lit("SUBJOB_STARTED")).alias("type"),
            F.lit(None).cast("string").alias("status"),
        )
        end = F.struct(
            F.lit("END").alias("part"), _plus_minutes(F.col("ts"), F.col("k") * 10).alias("at"),
            F.lit("JOB_ENDED").alias("type"),
            F.when(kind == "click", F.lit(" Success ")).otherwise(F.lit("failed")).alias("status"),
        )
        entry = F.struct(
            F.lit("ENQUEUE").alias("part"), F.col("ts").alias("at"), F.lit("QUEUE_ENQUEUED").alias("type"),
            F.lit(None).cast("string").alias("status"),
        )
        parts = (
            F.when(executed, F.array(start, end)).when(kind == "error", F.array(start))
            .when(kind == "signup", F.array(entry)).otherwise(F.array().cast(
                "array<struct<part:string,at:timestamp,type:string,status:string>>"
            ))
        )
        table = F.when(kind == "signup", F.lit("AMR_Queue")).otherwise(F.lit("TA_AMR"))
        rows = self._events.select("event_id", "user_id", "ts", "k", table.alias("source_table"), F.explode(parts).alias("p"))
        return self._with_name(rows, "user_id").select(
            F.lit("ODS").alias("source_schema"), "source_table", F.col("event_id").alias("source_ods_row_id"),
            F.col("p.part").alias("source_event_part"), F.col("p.at").alias("event_time"),
            F.when(F.col("source_table") == "AMR_Queue", F.lit("QUEUE")).otherwise(F.lit("TASK")).alias("event_category"),
            F.col("p.type").alias("event_type"), F.col("p.status").alias("event_status"), "robot_code",
            F.when(F.col("k") < 90, F.col("user_id").cast("string")).alias("robot_id"),
            F.col("event_id").cast("string").alias("queue_id"),
            _plus_minutes(F.col("p.at"), F.lit(5)).alias("dwd_load_time"),
        )

    @cached_property
    def event_queue(self) -> DataFrame:
        """Queue records of the telemetry period: one per click, enqueued before it."""
        clicks = self._events.filter(F.col("event_type") == "click")
        return clicks.select(
            F.col("event_id").cast("string").alias("queue_id"),
            _plus_minutes(F.col("ts"), -F.col("k") * 3).alias("queue_start_time"),
        )

    # -- work --------------------------------------------------------------

    @cached_property
    def queue_fact(self) -> DataFrame:
        priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
        outcome = (
            F.when(status == "O", F.lit("in_progress"))
            .when((status == "F") & (priority == "5-LOW"), F.lit("COMPLEATED")).when(status == "F", F.lit("completed"))
            .when(priority == "1-URGENT", F.lit(" Aborted ")).when(priority == "2-HIGH", F.lit("cancelled"))
            .when(priority == "3-MEDIUM", F.lit("ERROR")).otherwise(F.lit("failed"))
        )
        box = F.when(priority == "4-NOT SPECIFIED", F.lit(None)).otherwise(F.floor(F.col("price_k") / 50)).cast("int")
        moment = F.timestamp_seconds(F.unix_seconds("o_orderdate") + F.col("o_orderkey") % 86400)
        rows = self._orders.select(
            F.col("o_orderkey").alias("queue_fact_id"), F.col("o_orderkey").cast("string").alias("queue_id"),
            moment.alias("event_time"), "o_custkey", outcome.alias("queue_status"),
            F.substring(priority, 1, 1).alias("project_id"),
            F.floor(F.col("price_k") / 20).cast("string").alias("job_id"), box.alias("calling_box_id"),
            F.when(box >= 8, F.lit("")).otherwise(F.concat(F.lit("Box "), box.cast("string"))).alias("calling_box_name"),
            moment.alias("queue_start_time"), F.lit(None).cast("timestamp").alias("queue_end_time"),
            F.when(status == "F", F.col("o_orderkey") % 600).alias("duration_seconds"),
            F.when(priority == "4-NOT SPECIFIED", F.lit("n/a")).otherwise(F.col("o_custkey").cast("string")).alias(
                "robot_id"
            ),
            status.alias("_status"),
        )
        named = self._with_name(rows, "o_custkey")
        by_id = F.when(F.col("_status") == "F", F.col("o_custkey").cast("string")).otherwise(F.col("robot_code"))
        return named.withColumn("robot_code", by_id).drop("o_custkey", "_status")

    @cached_property
    def _lines(self) -> DataFrame:
        return self._read("lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus",
            F.col("l_shipdate").cast("timestamp").alias("l_shipdate"),
        )

    @cached_property
    def _order_lines(self) -> DataFrame:
        return self._lines.join(self._orders, F.col("l_orderkey") == F.col("o_orderkey"))

    @cached_property
    def queue_attempts(self) -> DataFrame:
        """Several attempts per queue record, with mixed outcomes; names are attached to orders, of which there are fewer."""
        flag, line = F.col("l_returnflag"), F.col("l_linestatus")
        outcome = (
            F.when((flag == "N") & (line == "F"), F.lit("Done")).when(flag == "N", F.lit("pending"))
            .when((flag == "R") & (line == "F"), F.lit(" aborted")).when(flag == "R", F.lit("canceled"))
            .when(line == "F", F.lit("ERROR")).otherwise(F.lit("Failed"))
        )
        key = F.col("o_custkey").cast("string")
        named = self._lines.join(self._with_name(self._orders, "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        return named.select(
            F.col("l_orderkey").cast("string").alias("queue_id"),
            F.timestamp_seconds(F.unix_seconds("o_orderdate") + F.col("l_partkey")).alias("event_time"),
            outcome.alias("queue_status"), key.alias("robot_id"),
            F.when(F.col("o_orderstatus") == "F", key).otherwise(F.col("robot_code")).alias("robot_code"),
        )

    @cached_property
    def task_run(self) -> DataFrame:
        flag = F.col("l_returnflag")
        return self._order_lines.select(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("o_custkey").alias("amr_id"),
            F.col("l_orderkey").alias("queue_id"), F.floor(F.col("price_k") / 20).cast("int").alias("job_id"),
            F.when((flag == "N") & (F.col("l_linestatus") == "O"), F.lit(None)).otherwise(F.col("l_linenumber"))
            .cast("int").alias("subjob_id"),
            F.timestamp_seconds(F.unix_seconds("o_orderdate") + F.col("l_partkey")).alias("start_time"),
            F.when(flag != "R", F.timestamp_seconds(F.unix_seconds("l_shipdate") + F.col("l_suppkey"))).alias("end_time"),
            F.when(F.col("l_linestatus") == "F", F.lit("success")).otherwise(F.lit("failed")).alias("status"),
        )

    @cached_property
    def task_run_raw(self) -> DataFrame:
        return self.task_run.withColumnRenamed("id", "ods_row_id").drop("amr_id", "job_id", "subjob_id")

    @cached_property
    def queue_source(self) -> DataFrame:
        late = F.when(F.col("o_orderstatus") == "P", F.lit(1000)).otherwise(F.lit(-400))
        return self._orders.select(
            F.col("o_orderkey").alias("id"),
            F.timestamp_seconds(F.unix_seconds("o_orderdate") + late).alias("enqueued_at"),
        )

    @cached_property
    def queue_raw(self) -> DataFrame:
        return self.queue_source.withColumnRenamed("id", "ods_row_id")

    @cached_property
    def assignment_raw(self) -> DataFrame:
        return self.robot_master.select(
            F.col("id").cast("bigint").alias("ods_row_id"), F.col("updated_at").alias("start_time")
        )

    @cached_property
    def subjob_fact(self) -> DataFrame:
        return self.task_run.select(
            F.col("amr_id").cast("string").alias("robot_code"), F.col("amr_id").cast("string").alias("robot_id"),
            F.col("start_time").alias("subjob_start_time"), F.col("end_time").alias("subjob_end_time"),
            F.lit(None).cast("bigint").alias("duration_seconds"),
            F.when(F.col("status") == "success", F.lit("A")).alias("start_station_code"),
            F.lit(None).cast("string").alias("end_station_code"),
        )

    @cached_property
    def watermark(self) -> DataFrame:
        """Load positions: queue and assignment sources are current, the runs of "O" lines are not loaded."""
        def position(table: str, df: DataFrame, value: Column) -> DataFrame:
            return df.agg(F.max(value).alias("last_ods_row_id")).select(
                F.lit("ODS").alias("source_schema"), F.lit(table).alias("source_table"), "last_ods_row_id"
            )

        return (
            position("AMR_Queue", self._orders, F.col("o_orderkey"))
            .unionByName(position("TA_AMR", self.task_run, F.when(F.col("status") == "success", F.col("id")) - 1))
            .unionByName(position("MA_AMR_Project_Assignment", self.robot_master, F.col("id").cast("bigint")))
        )

    @cached_property
    def etl_batch(self) -> DataFrame:
        failed = F.col("o_orderstatus") == "P"
        return self._orders.select(
            F.col("o_orderkey").alias("batch_id"), F.col("o_orderdate").alias("batch_start_time"),
            _plus_minutes(F.col("o_orderdate"), F.col("price_k")).alias("batch_end_time"),
            F.col("o_orderstatus").alias("batch_status"), F.when(failed, F.col("o_orderpriority")).alias("error_message"),
        )

    @cached_property
    def dispatch_candidate(self) -> DataFrame:
        return self._orders.select(
            F.col("o_orderkey").alias("decision_id"), F.col("o_orderkey").alias("task_id"),
            F.col("o_custkey").cast("string").alias("robot_id"), F.col("price_k").cast("double").alias("total_score"),
            (F.col("o_orderstatus") == "F").alias("selected_flag"),
        )

    @cached_property
    def incident(self) -> DataFrame:
        return self._events.filter(F.col("event_type") == "error").select(F.col("event_id").alias("incident_id"))

    @cached_property
    def incident_evidence(self) -> DataFrame:
        return self.incident.withColumnRenamed("incident_id", "incident_evidence_id")

    # -- rollups -----------------------------------------------------------

    @cached_property
    def _hours(self) -> DataFrame:
        """Telemetry per robot and hour; the other rollups pick from it."""
        def n(kind: str) -> Column:
            return F.count(F.when(F.col("event_type") == kind, F.lit(1))).alias(f"n_{kind}")

        def total(kind: str) -> Column:
            return F.coalesce(F.sum(F.when(F.col("event_type") == kind, F.col("k"))), F.lit(0)).alias(f"k_{kind}")

        level = F.when(F.col("event_type") != "error", -(F.lit(40) + F.col("k") % 45))
        return (
            self._events.groupBy("user_id", hour_start("ts").alias("stat_hour"))
            .agg(
                F.min("event_id").alias("row_id"), F.count(F.lit(1)).alias("n"),
                *[n(kind) for kind in ("click", "view", "error", "signup", "purchase")],
                *[total(kind) for kind in ("click", "view", "purchase")],
                F.sum("k").alias("k_sum"), F.min("k").alias("k_min"), F.max("k").alias("k_max"),
                F.sum(level).alias("level_sum"), F.count(level).alias("level_n"), F.min(level).alias("level_min"),
                F.max(level).alias("level_max"), F.count(F.when(level <= -67, F.lit(1))).alias("level_weak"),
                F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
            )
            .withColumn("load_time", _plus_minutes(F.col("last_ts"), F.col("k_max") * 20))
        )

    @staticmethod
    def _scaled(total: str, count: str, unit: int) -> Column:
        """Mean cut to ``unit`` parts, as an exact decimal."""
        cut = F.floor(F.abs(F.col(total)) * unit / F.col(count)) * F.signum(F.col(total)).cast("int")
        digits = len(str(unit)) - 1
        return (cut.cast("decimal(18,0)") * F.lit(f"{1 / unit:.{digits}f}").cast(f"decimal({digits + 1},{digits})")).cast(
            "decimal(18,6)"
        )

    @cached_property
    def status_hourly(self) -> DataFrame:
        key = F.col("user_id").cast("string")
        return self._hours.select(
            F.col("row_id").alias("status_hourly_id"), key.alias("robot_code"), key.alias("robot_id"), "stat_hour",
            F.col("n").alias("sample_count"), (F.col("n") - F.col("n_error")).alias("online_sample_count"),
            F.col("n_error").alias("error_sample_count"), self._scaled("k_sum", "n", 1000).alias("avg_speed_mps"),
            F.col("k_max").cast("decimal(18,6)").alias("max_speed_mps"), F.col("first_ts").alias("first_status_time"),
            F.col("last_ts").alias("last_status_time"), F.col("load_time").alias("dws_load_time"),
        )

    @cached_property
    def battery_hourly(self) -> DataFrame:
        unknown = F.lit(None).cast("decimal(18,6)")
        rows = self._hours.select(
            F.col("row_id").alias("battery_hourly_id"), "user_id", F.col("user_id").cast("string").alias("robot_id"),
            "stat_hour", F.col("n").alias("sample_count"),
            self._scaled("k_sum", "n", 100).alias("avg_battery_soc"),
            F.col("k_min").cast("decimal(18,6)").alias("min_battery_soc"),
            F.col("k_max").cast("decimal(18,6)").alias("max_battery_soc"), unknown.alias("avg_battery_voltage"),
            unknown.alias("avg_battery_current"), unknown.alias("avg_battery_power"),
            F.col("n_purchase").alias("charging_sample_count"), F.col("first_ts").alias("first_sample_time"),
            F.col("last_ts").alias("last_sample_time"), F.col("load_time").alias("dws_load_time"),
        )
        return self._with_name(rows, "user_id").drop("user_id")

    @cached_property
    def wifi_hourly(self) -> DataFrame:
        key = F.col("user_id").cast("string")
        return self._hours.select(
            F.col("row_id").alias("wifi_hourly_id"), key.alias("robot_code"), key.alias("robot_id"), "stat_hour",
            F.col("n").alias("sample_count"),
            F.when(F.col("level_n") > 0, self._scaled("level_sum", "level_n", 100)).alias("avg_rssi"),
            F.col("level_min").cast("decimal(18,6)").alias("min_rssi"),
            F.col("level_max").cast("decimal(18,6)").alias("max_rssi"),
            F.col("level_weak").alias("weak_signal_sample_count"), F.col("last_ts").alias("last_sample_time"),
            F.col("load_time").alias("dws_load_time"),
        )

    @cached_property
    def job_daily(self) -> DataFrame:
        """Detail rows per event type beside the all-types rollup rows."""
        day = F.to_date("ts").alias("stat_date")
        done = F.count(F.when(F.col("event_type").isin("click", "view", "purchase"), F.lit(1)))
        measures = [
            F.count(F.lit(1)).alias("job_count"), F.count_distinct("k").alias("distinct_job_count"),
            done.alias("completed_status_count"),
            F.count(F.when(F.col("event_type") == "error", F.lit(1))).alias("failed_status_count"),
            F.min("ts").alias("first_job_start_time"), F.max("ts").alias("last_job_start_time"),
            F.min("event_id").alias("job_daily_id"),
        ]
        detail = self._events.groupBy("user_id", day, F.col("event_type").alias("job_type_code")).agg(*measures).select(
            "*", F.when(F.col("job_type_code") == "view", F.lit(" ")).otherwise(F.lit("AUTO")).alias("robot_mode_id"),
            F.when(F.col("job_type_code") == "click", F.lit(None)).otherwise(F.lit("Automatic")).alias("robot_mode_detail"),
        )
        rollup = self._events.groupBy("user_id", day).agg(*measures).select(
            "*", F.lit("__ALL__").alias("job_type_code"), F.lit("__ALL__").alias("robot_mode_id"),
            F.lit(None).cast("string").alias("robot_mode_detail"),
        )
        return detail.unionByName(rollup).select(
            "job_daily_id", F.col("user_id").cast("string").alias("robot_code"), "stat_date", "job_type_code",
            "robot_mode_id", "robot_mode_detail", "job_count", "distinct_job_count", "completed_status_count",
            "failed_status_count", "first_job_start_time", "last_job_start_time",
            _plus_minutes(F.col("last_job_start_time"), F.lit(30)).alias("dws_load_time"),
        )

    @cached_property
    def queue_daily(self) -> DataFrame:
        return self.queue_fact.groupBy("robot_code", F.to_date("event_time").alias("stat_date")).agg(
            F.count(F.lit(1)).alias("queue_count"), F.count_distinct("queue_id").alias("distinct_queue_count"),
            F.count(F.when(F.col("queue_status").isin("completed", "COMPLEATED"), F.lit(1))).alias(
                "completed_status_count"
            ),
            F.count(F.when(F.col("queue_status").isin("failed", "ERROR"), F.lit(1))).alias("failed_status_count"),
            F.max("duration_seconds").cast("decimal(18,2)").alias("avg_duration_seconds"),
        )

    @cached_property
    def task_hourly(self) -> DataFrame:
        def capped(total: str, per_unit: int, cap: int) -> Column:
            return F.least(F.col(total) * per_unit, F.lit(cap)).cast("bigint")

        rows = self._hours.select(
            "stat_hour", "user_id", F.col("user_id").cast("string").alias("robot_id"),
            capped("k_click", 10, 1200).alias("executing_seconds"),
            capped("k_purchase", 9, 900).alias("charging_seconds"), capped("k_view", 8, 600).alias("waiting_seconds"),
            F.when(F.col("n_signup") > 0, F.lit(900)).otherwise(F.lit(0)).cast("bigint").alias("no_task_seconds"),
            F.col("n_signup").alias("accepted_queue_count"), F.col("n_click").alias("task_started_count"),
            F.col("n_view").alias("subtask_started_count"), F.col("n_purchase").alias("task_completed_count"),
            F.col("first_ts").alias("first_source_event_time"), F.col("last_ts").alias("last_source_event_time"),
            F.col("load_time").alias("dws_load_time"),
        )
        rest = (
            F.lit(3600).cast("bigint") - F.col("executing_seconds") - F.col("charging_seconds")
            - F.col("waiting_seconds") - F.col("no_task_seconds")
        )
        return self._with_name(rows.withColumn("data_unavailable_seconds", rest), "user_id").drop("user_id")

    @cached_property
    def calling_box_hourly(self) -> DataFrame:
        label = F.concat(F.lit("Box "), F.floor(F.col("k") / 10).cast("string"))
        rows = self._events.groupBy("user_id", hour_start("ts").alias("stat_hour"), label.alias("calling_box_label")).agg(
            F.count(F.lit(1)).alias("calling_box_count"), F.min("ts").alias("first_called_at"),
            F.max("ts").alias("last_called_at"),
        )
        return self._with_name(rows, "user_id").drop("user_id")

    @cached_property
    def assigned_task_hourly(self) -> DataFrame:
        label = F.concat(F.lit("Task "), F.floor(F.col("k") / 5).cast("string"))
        rows = self._events.groupBy("user_id", hour_start("ts").alias("stat_hour"), label.alias("task_label")).agg(
            F.count(F.lit(1)).alias("assigned_task_count"),
            F.count(F.when(F.col("event_type").isin("click", "purchase"), F.lit(1))).alias("completed_task_count"),
            F.min("ts").alias("first_assigned_at"), F.max("ts").alias("last_assigned_at"),
        )
        return self._with_name(rows, "user_id").drop("user_id")
