from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import time as T
from fleetlens.operators.scope import ScopeError, parse_id_list, parse_list, split_list


@pytest.mark.parametrize("minutes, grain", [
    (1, 5), (360, 5), (361, 15), (1440, 15), (1441, 60), (10080, 60), (10081, 1440), (0, 15), (-5, 15), (None, 15),
    (float("inf"), 15), ("x", 15),
])
def test_grain(minutes, grain):
    assert T.grain_minutes(minutes) == grain


def test_describe_grain():
    assert T.describe_grain(60) == {"bucket_minutes": 60, "label": "Hour", "bucket_label": "hourly buckets"}
    assert T.describe_grain(7)["label"] == "7 Minutes"


def test_wifi_window_defaults_to_trailing_hours():
    window = T.parse_wifi_window(None, " ", 24)
    assert (window.is_custom, window.start, window.end, window.hours) == (False, None, None, 24)


def test_wifi_window_is_read_without_conversion():
    window = T.parse_wifi_window("2026-07-30T08:15", "2026-07-31T08:15", 24)
    assert window.is_custom and window.hours == 24
    assert window.start == datetime(2026, 7, 30, 8, 15) and window.end == datetime(2026, 7, 31, 8, 15)


@pytest.mark.parametrize("start, end", [
    ("2026-07-30T08:15", None), ("2026-07-31T08:15", "2026-07-30T08:15"), ("2026-02-30T08:15", "2026-03-01T08:15"),
    ("2026-06-01T00:00", "2026-07-30T00:00"), ("2026-07-30 08:15", "2026-07-31 08:15"),
])
def test_wifi_window_rejects(start, end):
    with pytest.raises(T.WindowError) as error:
        T.parse_wifi_window(start, end, 24)
    assert error.value.code == "INVALID_WIFI_ANALYSIS_WINDOW"


def test_report_windows():
    anchor = datetime(2026, 7, 30, 12)
    assert T.parse_window(None, None, anchor, T.TASK_WINDOW).start == datetime(2026, 7, 29, 12)
    for start, end, code in [("2026-07-30T08:00", "", "51001"), ("2026-05-01T00:00", "2026-07-30T00:00", "51002")]:
        with pytest.raises(T.WindowError) as error:
            T.parse_window(start, end, anchor, T.TASK_WINDOW)
        assert error.value.code == code
    T.parse_window("2026-05-01T00:00", "2026-07-30T00:00", anchor, T.PROJECT_WINDOW)
    with pytest.raises(T.WindowError):
        T.parse_window("2026-04-01T00:00", "2026-07-30T01:00", anchor, T.PROJECT_WINDOW)


def test_snap_to_hours():
    window = T.WindowSpec(datetime(2026, 7, 30, 8, 15), datetime(2026, 7, 30, 10, 5))
    snapped = T.snap_to_hours(window)
    assert (snapped.start, snapped.end) == (datetime(2026, 7, 30, 9), datetime(2026, 7, 30, 10))
    short = T.WindowSpec(datetime(2026, 7, 30, 8, 15), datetime(2026, 7, 30, 8, 45))
    with pytest.raises(T.WindowError) as error:
        T.snap_to_hours(short, T.TASK_WINDOW)
    assert error.value.code == "51003"


def test_clamps():
    assert [T.clamp_hours(v) for v in (None, "0", "12h", 9999, "x")] == [24, 1, 12, 720, 24]
    assert [T.clamp_days(v) for v in (None, -3, 500)] == [7, 1, 90]


def test_lists():
    assert parse_list(" a, b ,,a") == ["a", "b"]
    assert parse_list("3, x, 3, 4", "int") == [3, 4]
    assert parse_id_list("7,8,7") == [7, 8]
    for bad in ("1.5", "07", "x"):
        with pytest.raises(ScopeError):
            parse_id_list(bad)


def test_split_list_column(spark):
    df = spark.createDataFrame([(" 3, x,3 , 4,",)], "t string")
    row = df.select(split_list(F.col("t")).alias("s"), split_list(F.col("t"), "int").alias("i")).first()
    assert row.s == ["3", "x", "4"] and row.i == [3, 4]


def test_minutes_count_boundaries(spark):
    df = spark.createDataFrame([(datetime(2026, 1, 1, 0, 0, 59), datetime(2026, 1, 1, 0, 1, 0))], "a timestamp, b timestamp")
    row = df.select(
        T.minutes_between("a", "b").alias("m"), T.seconds_between("a", "b").alias("s"),
        T.age_minutes("b", "a").alias("clamped"), T.age_minutes(F.lit(None).cast("timestamp"), "b").alias("missing"),
    ).first()
    assert (row.m, row.s, row.clamped, row.missing) == (1, 1, 0.0, float("inf"))


@pytest.mark.parametrize("minutes, expected", [
    (5, datetime(2026, 7, 30, 8, 15)), (15, datetime(2026, 7, 30, 8, 15)), (60, datetime(2026, 7, 30, 8)),
    (1440, datetime(2026, 7, 30)),
])
def test_bucket_start(spark, minutes, expected):
    df = spark.createDataFrame([(datetime(2026, 7, 30, 8, 19, 59, 999),)], "t timestamp")
    assert df.select(T.bucket_start("t", minutes).alias("b")).first().b == expected
