"""Reports end to end on the benchmark tables bound to the fleet model."""

import csv
import glob
import json

import pytest

from fleetlens.functions.time import WindowError, WindowSpec
from fleetlens.operators import intervals, joins
from fleetlens.operators.scope import ScopeError
from fleetlens.plans.dashboard import dashboard
from fleetlens.plans.export import EXPORTS, export_dataset
from fleetlens.plans.project_analytics import diagnostics_of_project, project_analytics
from fleetlens.plans.readiness import readiness_profile
from fleetlens.plans.robot_profile import RobotError, robot_profile
from fleetlens.plans.task_analytics import task_analytics
from fleetlens import session
from fleetlens.sources import profile, sinks, tables as model
from fleetlens.sources.driver_tables import DriverTables
from helpers import one, rows
from datetime import datetime

AS_OF = datetime(2024, 1, 31)


@pytest.fixture(scope="module")
def tables(spark, data_dir):
    return DriverTables(spark, data_dir)


@pytest.fixture(scope="module")
def board(tables):
    return dashboard(tables, AS_OF, hours=720, days=90, timeout=1440)


@pytest.fixture(scope="module")
def project(tables):
    return project_analytics(tables, "1998-01-01T00:00", "1998-03-31T00:00")


def test_every_dashboard_result_evaluates(board):
    counts = {name: df.count() for name, df in board.items()}
    assert counts["access_point_risk"] == 0 and counts["measurement_gaps"] == 8
    assert counts["summary"] == counts["assessment"] == counts["wifi_running_summary"] == 1
    empty = {name for name, n in counts.items() if n == 0}
    assert empty <= {"access_point_risk", "failure_outcomes"}, empty


def test_dashboard_parts_agree(board):
    summary = one(board["summary"])
    robots = rows(board["robots"])
    assert summary["total_robot_count"] == len(robots)
    assert summary["current_data_robot_count"] == sum(r["online_status"] == "ONLINE" for r in robots)
    assert all(r["speed_mps"] is None for r in robots if r["online_status"] == "TIMEOUT")
    running = one(board["wifi_running_summary"])
    assert running["running_matched_sample_count"] == sum(r["sample_count"] for r in rows(board["wifi_running_by_robot"]))
    assert running["weak_signal_sample_count"] == sum(
        r["weak_signal_sample_count"] for r in rows(board["wifi_running_weak_timeline"]))
    assert running["bucket_minutes"] == 1440


def test_dashboard_without_materializing(tables, board):
    lazy = dashboard(tables, AS_OF, hours=720, days=90, timeout=1440, materialize=None)
    for name in ("summary", "diagnostics", "wifi_running_by_target"):
        assert sorted(map(str, rows(lazy[name]))) == sorted(map(str, rows(board[name])))


def test_rollup_choice_changes_daily_jobs(tables, board):
    doubled = dashboard(tables, AS_OF, hours=720, days=90, timeout=1440, rollup="as_is", materialize=None)["job_trend"]
    single = {r["stat_date"]: r["job_count"] for r in rows(board["job_trend"])}
    assert all(r["job_count"] == 2 * single[r["stat_date"]] for r in rows(doubled))


def test_custom_signal_window(tables):
    report = dashboard(tables, AS_OF, wifi_start="2024-01-10T00:00", wifi_end="2024-01-10T06:00", timeout=1440,
                       materialize=None)
    summary = one(report["wifi_running_summary"])
    assert summary["is_custom_window"] and summary["bucket_minutes"] == 5
    with pytest.raises(WindowError):
        dashboard(tables, AS_OF, wifi_start="2024-01-10T00:00")


def test_task_sample_limit_marks_truncation(tables):
    report = dashboard(tables, AS_OF, days=90, task_sample_limit=5, materialize=None)
    assert sum(r["task_execution_count"] for r in rows(report["task_timing"])) <= 5


@pytest.mark.parametrize("start, end, grain", [
    ("2024-01-10T00:00", "2024-01-10T05:00", 5), ("2024-01-10T00:00", "2024-01-10T20:00", 15),
    ("2024-01-05T00:30", "2024-01-08T00:00", 60), ("2024-01-02T00:00", "2024-01-30T00:00", 1440),
])
def test_task_analytics_routes_by_grain(tables, start, end, grain):
    report = task_analytics(tables, start, end)
    summary = one(report["trend_summary"])
    assert summary["bucket_minutes"] == grain
    for name, df in report.items():
        df.count()
    totals = one(report["summary"])
    if grain >= 60:
        assert sum(r["executing_seconds"] for r in rows(report["state_trend"])) == (totals["executing_seconds"] or 0)


def test_task_analytics_default_window_and_selection(tables):
    everything = task_analytics(tables)
    names = [r["robot_code"] for r in rows(everything["robots"])][:2]
    chosen = task_analytics(tables, "2024-01-02T00:00", "2024-01-30T00:00", ",".join(names), per_robot=True)
    assert one(chosen["summary"])["selected_robot_count"] == 2
    assert {r["robot_code"] for r in rows(chosen["state_trend"])} <= set(names)
    assert {r["series"] for r in rows(chosen["usage_trend"])} <= set(names)
    with pytest.raises(WindowError):
        task_analytics(tables, "2024-01-10T00:10", "2024-01-10T00:50")


def test_project_analytics(tables, project):
    summary, projects = one(project["summary"]), rows(project["projects"])
    assert summary["queue_count"] == sum(r["queue_count"] for r in projects) > 0
    assert {r["project_name"] for r in projects} >= {"Unmapped project"}
    narrowed = project_analytics(tables, "1998-01-01T00:00", "1998-03-31T00:00", projects="1", jobs="3,4")
    assert {r["project_id"] for r in rows(narrowed["tasks"])} == {1}
    assert one(narrowed["summary"])["selected_job_count"] == 2
    assert narrowed["projects"].count() == len(projects)
    for df in narrowed.values():
        df.count()


def test_project_analytics_rejects(tables):
    with pytest.raises(ScopeError):
        project_analytics(tables, "1998-01-01T00:00", "1998-03-31T00:00", robots="AMR_1")
    with pytest.raises(ScopeError):
        project_analytics(tables, "1998-01-01T00:00", "1998-03-31T00:00", projects="1;2")
    with pytest.raises(WindowError):
        project_analytics(tables, "1998-01-01T00:00", "1998-06-30T00:00")


def test_project_scope_restricts_diagnoses(board, project):
    members = {r["robot_name"] for r in rows(project["robots"])}
    found = rows(diagnostics_of_project(board["diagnostics"], board["robots"], project))
    assert {r["robot_id"] for r in found} <= members


def test_robot_profile(tables):
    report = robot_profile(tables, "1", AS_OF, hours=720, days=90)
    for df in report.values():
        df.count()
    assert one(report["robot"])["master_robot_id"] == 1
    assert one(report["anchors"])["wifi_window_hours"] == 24
    assert sum(r["job_count"] for r in rows(report["job_trend"])) == sum(
        r["job_count"] for r in rows(report["task_breakdown"]))
    for bad, code in (("0", "INVALID_ROBOT_ID"), ("1.5", "INVALID_ROBOT_ID"), ("99999999", "ROBOT_NOT_FOUND")):
        with pytest.raises(RobotError) as error:
            robot_profile(tables, bad, AS_OF)
        assert error.value.code == code


def test_readiness_profile(spark, tables):
    names = ["task_run", "queue_fact", "duration_limit", "dispatch_candidate"]
    report = readiness_profile(spark, tables, names)
    for df in report.values():
        df.count()
    assert {r["column_name"] for r in rows(report["keyword_columns"])} == {"total_score"}
    assert report["recent_tasks"].count() == 20


def test_all_exports(tables, board, project):
    profiled = robot_profile(tables, "1", AS_OF, hours=720, days=90)
    assert len(EXPORTS) == 25  # 24 exports and the full lists behind the overview
    for name in EXPORTS:
        if name.startswith("profile-"):
            df = export_dataset(profiled, name)
        elif name == "project-analytics":
            df = export_dataset(project, name, projects="1")
        elif name == "robot-profile":
            df = export_dataset(board, name, robot_id=1)
        else:
            df = export_dataset(board, name)
        assert df.columns and all(c == c.strip("_") for c in df.columns), name
        df.count()
    overview = one(export_dataset(board, "overview", window_label="24 hours"))
    assert len(overview["Offline_Robot_IDs"].split(", ")) == overview["Offline_Robots"]
    assert export_dataset(board, "robots", search="amr_1").count() < export_dataset(board, "robots").count()
    with pytest.raises(KeyError):
        export_dataset(board, "nothing")


def test_csv_quotes_and_blanks(spark, tmp_path):
    df = spark.createDataFrame([('say "hi", twice', None, ["a", "b"])], "Text string, Gap string, List array<string>").coalesce(1)
    sinks.write_csv(df, str(tmp_path / "out"))
    part, = glob.glob(str(tmp_path / "out" / "part-*.csv"))
    with open(part, newline="") as handle:
        assert list(csv.reader(handle)) == [["Text", "Gap", "List"], ['say "hi", twice', "", "a; b"]]


def test_json_keeps_nulls_and_lists(spark, tmp_path):
    df = spark.createDataFrame([("x", None, ["a"])], "t string, gap string, l array<string>").coalesce(1)
    sinks.write_json({"part": df}, str(tmp_path))
    part, = glob.glob(str(tmp_path / "part" / "part-*.json"))
    with open(part) as handle:
        assert json.loads(handle.read()) == {"t": "x", "gap": None, "l": ["a"]}


def test_csv_file_in_one_piece(spark, tmp_path):
    data = [(i, 'say "hi", twice\r\nbye' if i % 3 else None, ["a", "b"]) for i in range(500)]
    df = spark.createDataFrame(data, "`N, o` int, Text string, List array<string>").repartition(7).orderBy("`N, o`")
    path = tmp_path / "out.csv"
    sinks.write_csv_file(df, str(path))
    raw = path.read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf\"N, o\",Text,List\r\n") and raw.endswith(b"\r\n")
    with open(path, newline="", encoding="utf-8-sig") as handle:
        assert list(csv.reader(handle)) == [["N, o", "Text", "List"]] + [[str(n), text or "", "a; b"] for n, text, _ in data]
    sinks.write_csv_file(df.limit(0), str(path), byte_order_mark=False, line_end="\n")
    assert path.read_bytes() == b'"N, o",Text,List\n' and [p.name for p in tmp_path.iterdir() if "parts" in p.name] == []


def test_document_with_its_envelope(spark, tmp_path):
    df = spark.createDataFrame([(i, None, ["a"]) for i in range(300)], "n int, gap string, l array<string>").repartition(5).orderBy("n")
    report = {"summary": spark.createDataFrame([(1, None)], "a int, b string"), "rows": df, "none": df.limit(0), "status": df.limit(0)}
    path = tmp_path / "report.json"
    head = sinks.report_head(AS_OF, "AMR", {"key": "24h", "label": "24 hours"}, 'quoted "note"')
    sinks.write_document(report, str(path), head, single=("summary", "status"))
    found = json.loads(path.read_text())
    assert list(found) == ["exportedAt", "selectedRobotType", "selectedWindow", "sourceNote", "dashboard"]
    assert found["selectedWindow"] == {"key": "24h", "label": "24 hours"} and found["exportedAt"] == AS_OF.isoformat()
    assert found["dashboard"] == {
        "summary": {"a": 1, "b": None}, "rows": [{"n": i, "gap": None, "l": ["a"]} for i in range(300)], "none": [], "status": None,
    }


def test_a_document_that_fails_leaves_nothing(spark, tmp_path):
    broken = spark.range(3).select(sinks.F.raise_error(sinks.F.lit("broken")).cast("string").alias("x"))
    with pytest.raises(Exception, match="broken"):
        sinks.write_document({"rows": broken}, str(tmp_path / "report.json"), {})
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == []


def test_exports_say_when_they_were_made(board, project):
    made = datetime(2026, 7, 1, 8)
    assert {r["Analysis_Generated_At"] for r in rows(export_dataset(board, "analysis", generated_at=made))} <= {made}
    assert one(export_dataset(board, "overview", generated_at=made))["Dashboard_Generated_At"] == made
    assert "Identity_Rule" in export_dataset(project, "project-analytics").columns


def test_model_tables_roundtrip(spark, tables, tmp_path):
    base = str(tmp_path / "model")
    written = {name: tables[name] for name in ("robot_dim", "operation_event", "battery_fact")}
    for name, df in written.items():
        model.write_model(df, base, name, "robot_code" if name != "robot_dim" else None)
    loaded = model.load_parquet(spark, base, written)
    for name, df in written.items():
        assert loaded[name].count() == df.count()
        assert set(loaded[name].columns) - {"day"} <= set(df.columns)
    window = WindowSpec(datetime(2024, 1, 10), datetime(2024, 1, 12))
    counted = intervals.bucket_event_counts(loaded["operation_event"], 60, window)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "GreaterThanOrEqual(event_time,2024-01-10" in plan
    direct = intervals.bucket_event_counts(tables["operation_event"], 60, window)
    assert sorted(map(str, rows(counted))) == sorted(map(str, rows(direct)))
    assert "nothing" not in loaded
    with pytest.raises(KeyError):
        loaded["nothing"]


def test_missing_columns_are_reported(spark):
    with pytest.raises(ValueError, match="is_enabled"):
        model.to_model(spark.createDataFrame([("a", "1")], "robot_code string, robot_id string"), "robot_dim")


def test_jdbc_options():
    options = model.jdbc_options("task_run", "jdbc:x", {"user": "u"}, ("id", 0, 100, 8))
    assert options["dbtable"] == "[dbo].[TA_AMR]" and options["numPartitions"] == "8" and options["user"] == "u"
    assert "partitionColumn" not in model.jdbc_options("project", "jdbc:x", {})


@pytest.mark.parametrize("hot_by", ["n", None])
def test_splits_of_a_skewed_key_are_even(spark, hot_by):
    # Ids bunch at one end, one value holds half of all rows, some are NULL.
    ids = [7] * 5000 + [10**9 + i for i in range(3000)] + [i * i for i in range(1990)] + [None] * 10
    df = spark.createDataFrame([(v, i - 300 if i % 9 else None) for i, v in enumerate(ids)], "id bigint, n int")
    points = model.split_points(df, "id", 10)
    found = model.split_predicates("id", points, hot_by, quotes="`")
    counts = df.agg(*[joins.F.count_if(joins.F.expr(p)).alias(str(i)) for i, p in enumerate(found)]).first()
    met = sum(joins.F.when(joins.F.expr(p), 1).otherwise(0) for p in found)
    assert sum(counts) == len(ids) and df.select(met.alias("m")).distinct().collect() == [(1,)]
    assert max(counts) <= (1700 if hot_by else 5000)
    even = model.jdbc_options("task_run", "u", {}, ("id", 0, 10**9 + 3000, 10))
    assert even["lowerBound"] == "0"  # by value alone, nearly all rows would be in two of ten parts


def test_splits_of_nothing_and_of_texts(spark):
    empty = spark.createDataFrame([], "id bigint")
    assert model.split_points(empty, "id", 8) == [] and model.split_predicates("id", []) == ["1 = 1"]
    assert model.split_points(empty, "id", 1) == []
    assert model.split_predicates("id", [5, 5, 9], "n") == [
        "([id] < 5 OR [id] IS NULL)", "[id] = 5 AND (ABS([n] % 2) = 0 OR [n] IS NULL)", "[id] = 5 AND ABS([n] % 2) = 1",
        "[id] > 5 AND [id] < 9", "[id] >= 9",
    ]
    assert model.split_predicates("d", [datetime(2026, 7, 1)], quotes='"') == [
        "(\"d\" < '2026-07-01 00:00:00' OR \"d\" IS NULL)", "\"d\" >= '2026-07-01 00:00:00'",
    ]


def test_cut_writes_to_the_checkpoint_folder(spark):
    folder = session.checkpoint_dir(spark)
    df = session.cut(spark.range(5).withColumnRenamed("id", "n"))
    assert df.count() == 5 and "RDD" in df._jdf.queryExecution().optimizedPlan().toString()
    assert folder and spark.sparkContext.getCheckpointDir()


def test_checkpoint_folder_must_be_named_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())


def test_health_and_contract(spark, tables):
    tables["robot_dim"].createOrReplaceTempView("status_hourly")
    found = {r["table_name"]: r["table_exists"] for r in rows(profile.health(spark))}
    assert found == {"status_hourly": True, "battery_hourly": False, "wifi_hourly": False}
    spark.catalog.dropTempView("status_hourly")
    assert profile.required_field_count(tables["dispatch_candidate"]) == 5
    assert profile.required_field_count(None) == 0
