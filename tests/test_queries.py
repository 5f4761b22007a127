"""Registered queries against their SQL counterparts."""

import pytest

import __spark_entry__ as entry
from checks import oracles as registry_sql
from checks import queries as registry
from checks.compare import compare, open_tables

NAMES = sorted(registry.QUERIES)


@pytest.fixture(scope="module")
def connection(data_dir):
    return open_tables(data_dir)


def test_every_query_has_its_sql():
    assert set(registry.QUERIES) == set(registry_sql.ORACLES)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, connection, data_dir, name):
    frame = entry.queries()[name](spark, data_dir)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not any(node in plan for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython"))
    assert compare(frame, connection, entry.oracle_sql()[name]) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name, column, kinds", [
    ("robot_diagnosis_every_rule", "rule_id", 12), ("alert_causes_every_kind", "type", 5), ("workload_every_class", "classification", 7),
    ("exception_every_type", "exception_type", 4),
])
def test_every_kind_occurs(spark, data_dir, name, column, kinds):
    found = entry.queries()[name](spark, data_dir.replace("0.001", "0.01"))
    assert found.select(column).distinct().count() == kinds


def test_no_column_of_the_assessment_is_always_zero(spark, data_dir):
    row = entry.queries()["fleet_assessment_every_rule"](spark, data_dir.replace("0.001", "0.01")).first()
    assert row["rssi_measurement_unavailable_robot_count"] > 0 and row["unresolved_disconnect_count"] > 0
